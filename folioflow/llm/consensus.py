"""Problem 5: consensus from several annotators' labels.

Spectral reliability (after Ghosh, Kale and McAfee, 2011, and Dalvi et al., 2013).
Ratings are centred by each annotator's own mean and divided by the own spread, which
takes out agreement by chance and strictness. The agreement of two annotators is the
sum of the products of their centred ratings over shared items; the leading
eigenvector of that matrix, its diagonal left out and each row divided by the
annotator's overlaps, is the reliability: how far the ratings rise with those of the
others, as these can be relied on. (The rows' overlaps are taken, not those of each
pair: pairs share one or two items, whose means are noise, and an item of many
annotators would have to be written out in pairs.) The matrix is never made: a power
step sums per item, then per annotator, joined to the ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.sparse import Joined
from folioflow.plans.lineage import cut
from folioflow.sources.tables import table

#: The power iteration ends when no reliability moves by more than this; labels that take more rounds are an error.
TOLERANCE, ROUNDS = 1e-6, 1000
#: Items an annotator must have rated to be judged, and the reliability, as a share of the root mean square, under which the ratings don't rise with quality.
LEAST_ITEMS, CUTOFF = 20, 0.55
# The levels of a rating and of a confidence.
RATINGS, CONFIDENCES = (1, 3, 5, 6, 8, 10), (1, 2, 3, 4, 5)


def score_of(text: Column, levels: tuple[int, ...]) -> Column:
    """The first number of a score text if it is one of the levels, else null."""
    number = F.regexp_extract(text, "(?:^|[^0-9.])([0-9]+(?:\\.[0-9]+)?)", 1)
    value = F.when(number != "", number).cast("double")
    return F.when(value.isin(*[float(x) for x in levels]), value)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``(item, annotator, rating, confidence)``: of a redelivered review the latest, of two reviews of one paper by one reviewer the mean."""
    t = table(spark, folder, "review_scores").filter("review_id is not null and paper_id is not null and reviewer_id is not null")
    said = F.struct("paper_id", "reviewer_id", score_of(F.col("rating"), RATINGS).alias("rating"), score_of(F.col("confidence"), CONFIDENCES).alias("confidence"))
    kept = t.groupBy("review_id").agg(F.max_by(said, F.struct("received_at", said)).alias("r")).select("r.*").filter("rating is not null")
    return kept.groupBy(F.col("paper_id").alias("item"), F.col("reviewer_id").alias("annotator")).agg(F.avg("rating").alias("rating"), F.avg("confidence").alias("confidence"))


def spectral_reliability(labels: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The centred labels ``(item, annotator, rating, mean, z, w)`` and ``(annotator, n, reliability)``.

    labels: ``item``, ``annotator`` and numeric ``rating``, one row per item and
    annotator; rows with a null are left out. Reliabilities have a root mean square
    of 1 over all labels and a positive sum; ``w`` is the voting weight, the
    reliability or 0. An annotator whose labels are all alike has 0; so has one whose
    items nobody else labelled. An empty table gives empty results. The labels meet the
    vectors by a broadcast of a counted size, else by salted keys, and each sum is
    combined before the shuffle, so that no annotator and no item is one task.
    """
    rows = cut(labels.filter("item is not null and annotator is not null and rating is not null").select("item", "annotator", "rating"))
    own = cut(rows.groupBy("annotator").agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("spread"), F.count("*").alias("n")))
    sizes = cut(rows.groupBy("item").agg((F.count("*") - 1).alias("others")))
    annotators, items = own.count(), sizes.count()
    centred = F.col("rating") - F.col("mean")
    known = Joined(rows, "annotator", "item", annotators).with_vector(own).select("item", "annotator", "rating", "mean", centred.alias("c"), F.when(F.col("spread") > 1e-9, centred / F.col("spread")).otherwise(0.0).alias("z"))
    matrix = cut(Joined(cut(known), "item", "annotator", items).with_vector(sizes))
    own = cut(matrix.groupBy("annotator").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum("others").alias("overlaps"), F.count("*").alias("n")))
    by_annotator, by_item = Joined(matrix.select("item", "annotator", "z"), "annotator", "item", annotators), Joined(matrix.select("item", "annotator", "z"), "item", "annotator", items)
    v = own.select("annotator", "n", "zz", "overlaps", F.lit(1.0).alias("v"))
    for _ in range(rounds):
        per_item = by_annotator.with_vector(v.select("annotator", "v")).groupBy("item").agg(F.sum(F.col("z") * F.col("v")).alias("s"))
        back = by_item.with_vector(per_item).groupBy("annotator").agg(F.sum(F.col("z") * F.col("s")).alias("zs"))
        step = cut(back.join(v, "annotator").select("annotator", "n", "zz", "overlaps", "v", ((F.col("zs") - F.col("v") * F.col("zz")) / F.greatest("overlaps", F.lit(1))).alias("raw")))
        norm = step.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw") * F.col("n")) / F.sum("n")).alias("length"), F.signum(F.sum(F.col("raw") * F.col("n"))).alias("sign")).first()
        if not norm.length:
            v = step.withColumn("v", F.lit(0.0)).drop("raw")
            break
        scaled = F.col("raw") / F.lit(norm.length * (norm.sign or 1.0))
        moved = step.agg(F.max(F.abs(scaled - F.col("v")))).first()[0]
        v = step.withColumn("v", scaled).drop("raw")
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"the reliabilities have not settled after {rounds} rounds")
    weights = v.select("annotator", F.greatest("v", F.lit(0.0)).alias("w"))
    weighted = Joined(matrix, "annotator", "item", annotators).with_vector(weights).select("item", "annotator", "rating", "mean", F.col("c").alias("z"), "w")
    return weighted, v.select("annotator", "n", F.col("v").alias("reliability"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewers of enough papers whose ratings don't rise with the papers' quality: the reliability decides."""
    _, judged = spectral_reliability(ratings(spark, folder))
    return judged.filter((F.col("n") >= LEAST_ITEMS) & (F.col("reliability") < CUTOFF)).select(F.col("annotator").alias("reviewer_id"))


def reviewers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers rated and reliability of every reviewer."""
    _, judged = spectral_reliability(ratings(spark, folder))
    return judged.select(F.col("annotator").alias("reviewer_id"), "n", F.round("reliability", 4).alias("reliability"))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Per paper the consensus rating, how far its reviewers agree, and the stale or missing mean it had.

    The consensus is the mean of the ratings, each less its reviewer's strictness,
    weighted by reliability; plain if no reviewer has a weight. The agreement is 1
    less the spread of the centred ratings over that of all ratings (1: of one mind,
    0: as far apart as any two ratings are on average); null for a single rating.
    """
    weighted, _ = spectral_reliability(ratings(spark, folder))
    level = weighted.agg(F.avg("rating").alias("mean"), F.var_samp("z").alias("var")).first()
    level_mean, level_var = level["mean"] or 0.0, level["var"] or 1.0
    per = weighted.groupBy("item").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum("w").alias("w"), F.avg("z").alias("z"), F.var_samp("z").alias("var"))
    deviation = F.when(F.col("w") > 1e-9, F.col("wz") / F.col("w")).otherwise(F.col("z"))
    given = table(spark, folder, "proreview").filter("paper_id is not null").groupBy(F.col("paper_id").alias("item")).agg(F.max("scores.rating_avg").alias("given_avg"))
    return per.join(given, "item", "left").select(F.col("item").alias("paper_id"), "n", F.round(F.lit(level_mean) + deviation, 4).alias("consensus"), F.round(1 - F.col("var") / F.lit(level_var), 4).alias("agreement"), "given_avg")


QUERIES = {"p5_found": found, "p5_reviewers": reviewers, "p5_papers": papers}
ORACLE: dict[str, str] = {}
