"""Sparse vectors of weighted terms and their cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf(terms: DataFrame) -> DataFrame:
    """``(id, term, weight)`` with weights (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1), of length 1 per id.

    terms: ``id`` and ``terms`` (arrays with repetition). An id without terms has no rows.
    """
    n = terms.agg(F.count("*").alias("docs"))
    tf = terms.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", ((1 + F.log("tf")) * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosines(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query, id, cosine)`` of all pairs of a query with a row that share a term; an inverted index, joined on the term.

    A vector doesn't meet itself. Sums are combined before the shuffle.
    """
    q = queries.select(F.col("id").alias("query"), "term", F.col("weight").alias("wq"))
    met = q.join(vectors.select("id", "term", "weight"), "term").filter(F.col("query") != F.col("id"))
    return met.groupBy("query", "id").agg(F.sum(F.col("wq") * F.col("weight")).alias("cosine"))


def best_match(scores: DataFrame, by: str, of: str, score: str, least: float, margin: float) -> DataFrame:
    """Per ``by`` the best ``of`` with its score and lead over the second, if it reaches ``least`` and leads by ``margin``.

    The two best are kept by a bounded aggregate, not by sorting the group; ties go to
    the smaller ``of``.
    """
    # max of a struct twice: the best, then the best of the others by another pass over the same partial sums.
    ranked = scores.select(by, F.struct(F.col(score).alias("s"), F.col(of).alias("o")).alias("x"))
    best = ranked.groupBy(by).agg(F.max(F.struct(F.col("x.s").alias("s"))).alias("top"))
    winners = ranked.join(best, by).filter(F.col("x.s") == F.col("top.s")).groupBy(by).agg(F.min("x.o").alias(of), F.first("top.s").alias(score))
    second = ranked.join(winners.select(by, F.col(of).alias("_o")), by).filter(F.col("x.o") != F.col("_o")).groupBy(by).agg(F.max("x.s").alias("_second"))
    out = winners.join(second, by, "left").withColumn("lead", F.col(score) - F.coalesce("_second", F.lit(0.0)))
    return out.filter((F.col(score) >= least) & (F.col("lead") >= margin)).drop("_second")
