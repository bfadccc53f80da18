"""Ranking, classification and calibration metrics of a table of labels and scores.

Everything rests on counts per distinct score, added up in the order of the scores
without a single-task sort (:func:`folioflow.operators.ranks.running_totals`). Labels
are 1, 0 or null; rows with a null label or score count for nothing. A metric that
isn't defined, as for one class alone, is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.numbers import ratio
from folioflow.operators.ranks import average_ranks, running_totals
from folioflow.plans.sizes import bounded_rows


def _classes(df: DataFrame, label: str, score: str, descending: bool = False) -> DataFrame:
    known = df.filter(F.col(label).isin(0, 1)).select(F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("pos"), (1 - F.col(label)).cast("bigint").alias("neg"))
    return running_totals(known, "score", ["pos", "neg"], descending)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(auc, positives, negatives)``: the share of pairs of both classes in the right order, ties as a half."""
    t = _classes(df, label, score)
    return t.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).select(ratio(F.col("u"), F.col("positives") * F.col("negatives")).alias("auc"), "positives", "negatives")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(average_precision)``: the steps of recall times the precision there, a group of tied scores at once."""
    t = _classes(df, label, score, descending=True).withColumn("tp", F.col("pos_before") + F.col("pos"))
    total = t.agg(F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("neg_before") + F.col("neg"))).alias("s"))
    return total.select(ratio(F.col("s"), F.col("positives")).alias("average_precision"))


def threshold_sweep(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(goal, threshold, precision, recall, f1, accuracy)`` of the best F1 and the best accuracy over all scores as thresholds and infinity; of equals the highest threshold."""
    t = _classes(df, label, score, descending=True)
    sums = t.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    rows = t.select("score", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    nothing = sums.select(F.lit(float("inf")).alias("score"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"))
    at = rows.unionByName(nothing).crossJoin(F.broadcast(sums)).filter("p + n > 0")
    precision, recall = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("p")), F.lit(0.0))
    at = at.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), F.coalesce(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0)).alias("f1"), ((F.col("tp") + F.col("n") - F.col("fp")) / (F.col("p") + F.col("n"))).alias("accuracy"))
    row = F.struct("threshold", "precision", "recall", "f1", "accuracy")
    best = at.agg(*[F.max_by(row, F.struct(F.round(m, 12), "threshold")).alias(m) for m in ("f1", "accuracy")])
    return best.select(F.explode(F.array(*[F.struct(F.lit(m).alias("goal"), F.col(m).alias("r")) for m in ("f1", "accuracy")])).alias("x")).select("x.goal", "x.r.*").filter("threshold is not null")


def probability_metrics(df: DataFrame, label: str, p: str, epsilon: float = 1e-12) -> DataFrame:
    """``(brier, log_loss, accuracy, n)`` of probabilities; the threshold is one half."""
    y, q = F.col(label).cast("double"), F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), F.col(p)))
    known = df.filter(F.col(label).isin(0, 1) & F.col(p).isNotNull())
    return known.agg(F.avg((F.col(p) - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(((F.col(p) >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def calibration_bins(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_p, positives_share)``: half-open bins of equal width, the last with its end."""
    known = df.filter(F.col(label).isin(0, 1) & F.col(p).isNotNull())
    at = F.greatest(F.lit(0), F.least(F.floor(F.round(F.col(p) * bins, 9)), F.lit(bins - 1))).cast("int")
    return known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("positives_share"))


def expected_calibration_error(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, label, p, bins)
    return b.agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("positives_share"))), F.sum("n")).alias("ece"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(spearman, n)``: the correlation of average ranks; 0 where a side doesn't vary."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    return pearson(ranked, "rx", "ry", "spearman")


def pearson(df: DataFrame, x: str, y: str, name: str = "pearson") -> DataFrame:
    t = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.count("*").alias("n"))
    return t.select(F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(0.0).alias(name), "n")


def ndcg(df: DataFrame, gain: str, score: str, k: int = 20) -> DataFrame:
    """``(ndcg)`` at k with linear gains; tied scores share the discounts of their places, and so does the ideal order."""

    def dcg(value: str) -> DataFrame:
        t = running_totals(df.filter(F.col(gain).isNotNull() & F.col(score).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(gain).cast("double").alias("g"), F.lit(1).alias("n")), "v", ["g", "n"], descending=True)
        head = t.filter(F.col("n_before") < k)
        # Only places up to k count, however many are tied.
        last = F.least(F.col("n_before") + F.col("n"), F.lit(float(k)))
        discounts = F.aggregate(F.sequence(F.col("n_before").cast("int") + 1, last.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        return head.agg(F.sum(F.col("g") / F.col("n") * discounts).alias("d"))

    return dcg(score).withColumnRenamed("d", "a").crossJoin(dcg(gain).withColumnRenamed("d", "b")).select(ratio(F.col("a"), F.col("b")).alias("ndcg"))


def pair_outcomes(predicted: Column, actual: Column, tie: float = 0.0) -> Column:
    """correct, incorrect or tie, for signed differences."""
    return F.when(F.abs(predicted) <= tie, "tie").when(F.signum(predicted) == F.signum(actual), "correct").otherwise("incorrect")


def concordance(df: DataFrame, group: list[str], target: str, score: str, most_levels: int = 64) -> DataFrame:
    """Per group the pairs whose targets differ, and how many of them the scores order rightly, wrongly or not.

    No pair is made. Rows are counted per group, score and level of the target, and
    added up in the order of group and score, so that each score meets the counts
    below it. Targets must have at most ``most_levels`` levels; null groups are a
    group; rows with a null target or score are not counted.
    """
    rows = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    levels = sorted(r[0] for r in bounded_rows(rows.select(target).distinct(), most_levels, "levels of the target"))
    names = [f"l{i}" for i in range(len(levels))]
    if not levels:
        return rows.select(*group, *[F.lit(0).cast("bigint").alias(c) for c in ("pairs", "right", "wrong", "ties")]).limit(0)
    at = rows.select(F.struct(*group, F.col(score).alias("_s")).alias("at"), *[(F.col(target) == F.lit(v)).cast("bigint").alias(n) for v, n in zip(levels, names, strict=True)])
    totals = running_totals(at, "at", names).select(*[F.col(f"at.{g}").alias(g) for g in group], *names, *[F.col(f"{n}_before").alias(f"{n}_b") for n in names])
    # What lies before a group's first score belongs to other groups.
    per = totals.groupBy(*group).agg(
        *[F.sum(n).alias(f"{n}_n") for n in names],
        *[F.min(f"{n}_b").alias(f"{n}_start") for n in names],
        *[F.sum(F.col(h) * F.col(f"{low}_b")).alias(f"{h}_{low}_below") for k, h in enumerate(names) for low in names[:k]],
        *[F.sum(F.col(h) * F.col(low)).alias(f"{h}_{low}_tied") for k, h in enumerate(names) for low in names[:k]],
    )
    pairs, right, ties = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k, h in enumerate(names):
        for low in names[:k]:
            pairs = pairs + F.col(f"{h}_n") * F.col(f"{low}_n")
            right = right + F.col(f"{h}_{low}_below") - F.col(f"{h}_n") * F.col(f"{low}_start")
            ties = ties + F.col(f"{h}_{low}_tied")
    out = per.select(*group, pairs.cast("bigint").alias("pairs"), right.cast("bigint").alias("right"), ties.cast("bigint").alias("ties"))
    return out.select(*group, "pairs", "right", (F.col("pairs") - F.col("right") - F.col("ties")).alias("wrong"), "ties").filter("pairs > 0")


def paired_bootstrap(df: DataFrame, a: str, b: str, iterations: int = 1000, seed: int = 42, state: int = 2**32) -> DataFrame:
    """``(difference, low, high)``: the mean difference of two paired columns with its 95 % bootstrap interval.

    Rows are not drawn: each row's multiplicity in each resample is Poisson with mean 1
    by a generator seeded by the row's values, so that resamples are sums over the
    table, combined before the shuffle, and any partitioning gives the same result.
    Rows alike in both columns share their stream of draws per count of such rows.
    """
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy((F.col(a) - F.col(b)).cast("double").alias("d")).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((iterations, 2))
        for batch in batches:
            for d, n in zip(batch["d"], batch["n"], strict=True):
                rng = np.random.default_rng([seed, abs(hash(float(d))) % state])
                times = rng.poisson(n, iterations)
                total[:, 0] += times * d
                total[:, 1] += times
        yield pd.DataFrame({"iteration": np.arange(iterations), "s": total[:, 0], "n": total[:, 1]})

    means = counts.mapInPandas(draw, "iteration int, s double, n double").groupBy("iteration").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    mean = counts.agg(ratio(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("difference"))
    return mean.crossJoin(interval)
