"""Calibration against reference scores, and logistic models fitted by distributed gradients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.numbers import sigmoid
from folioflow.operators.ranks import running_totals


def mid_rank_percentile(df: DataFrame, value: str, reference: DataFrame, ref_value: str, name: str = "percentile") -> DataFrame:
    """``df`` with the percentile of ``value`` among the reference scores: 100 * (below + at or below - 1) / 2 / (n - 1), within 0 and 100, one digit.

    Both tables are added up in one order of values, so that the reference is never
    broadcast. A single reference score gives 50, none gives null.
    """
    marks = reference.filter(F.col(ref_value).isNotNull()).select(F.col(ref_value).cast("double").alias("v"), F.lit(1).alias("r"))
    asked = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.lit(0).alias("r"))
    totals = running_totals(marks.unionByName(asked), "v", ["r"])
    n = marks.agg(F.count("*").alias("_n"))
    raw = 100 * (F.col("r_before") + F.col("r_before") + F.col("r") - 1) / 2 / F.greatest(F.col("_n") - 1, F.lit(1))
    score = F.when(F.col("_n") == 1, 50.0).when(F.col("_n") > 1, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1))
    ranked = totals.crossJoin(F.broadcast(n)).select(F.col("v").alias("_v"), score.alias(name))
    return df.join(ranked, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def column_scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; the deviation is 1 where the variance is at most 1e-12. One row comes to the driver."""
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]).first()
    return {c: (row[f"m_{c}"] or 0.0, float(np.sqrt(row[f"v_{c}"])) if row[f"v_{c}"] and row[f"v_{c}"] > 1e-12 else 1.0) for c in columns}


def standardised(df: DataFrame, columns: list[str], scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - scales[c][0]) / scales[c][1] for c in columns})


def linear(columns: list[str], weights: list[float], bias: float) -> Column:
    out = F.lit(float(bias))
    for c, w in zip(columns, weights, strict=True):
        out = out + F.col(c) * float(w)
    return out


def logistic_regression(df: DataFrame, columns: list[str], label: str, l2: float = 0.02, tolerance: float = 1e-9, passes: int = 100) -> tuple[list[float], float]:
    """Weights and bias that minimise the mean log loss plus ``l2 / 2`` times the squared weights (the bias is free), by Newton's method.

    This is the point that gradient descent with that penalty tends to, in some ten
    passes in place of a thousand. Each pass is one aggregation to a single row of
    gradients and curvatures; rows with a null are left out. Without rows or with one
    class the weights stay 0 and the bias is the prior's logit. A fit that does not
    settle is an error.
    """
    rows = df.filter(F.col(label).isin(0, 1)).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y")).dropna().persist()
    try:
        head = rows.agg(F.avg("_y").alias("p"), F.count("*").alias("n")).first()
        p, width = min(max(head.p or 0.5, 1e-6), 1 - 1e-6), len(columns) + 1
        at = np.append(np.zeros(len(columns)), np.log(p / (1 - p)))
        if not head.n or head.p in (0.0, 1.0):
            return at[:-1].tolist(), float(at[-1])
        penalty, names = np.append(np.full(len(columns), l2), 0.0), [*columns, "_one"]
        for _ in range(passes):
            chance = sigmoid(linear(columns, at[:-1].tolist(), at[-1]))
            known = rows.select(F.lit(1.0).alias("_one"), *columns, (chance - F.col("_y")).alias("_e"), (chance * (1 - chance)).alias("_h"))
            both = [(i, j) for i in range(width) for j in range(i, width)]
            r = known.agg(*[F.avg(F.col("_e") * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)], *[F.avg(F.col("_h") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in both]).first()
            gradient = np.array([r[f"g{i}"] for i in range(width)]) + penalty * at
            if np.abs(gradient).max() < tolerance:
                return at[:-1].tolist(), float(at[-1])
            curvature = np.diag(penalty + 1e-12)
            for i, j in both:
                curvature[i, j] += r[f"h{i}_{j}"]
                curvature[j, i] = curvature[i, j]
            step = np.linalg.solve(curvature, gradient)
            at = at - step / max(1.0, float(np.abs(step).max()) / 4)
        raise RuntimeError(f"the logistic model has not settled after {passes} passes")
    finally:
        rows.unpersist()


def platt(df: DataFrame, score: str, label: str, least: int = 10, l2: float = 0.005) -> tuple[float, float]:
    """Slope and intercept that calibrate a score; the identity for fewer than ``least`` rows or one class."""
    known = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    r = known.agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).first()
    if r.n < least or r.classes < 2:
        return 1.0, 0.0
    w, b = logistic_regression(known, [score], label, l2)
    return w[0], b


def confidence_tier(support: Column, n: Column, error: Column) -> Column:
    """How far a calibration can be relied on, by its support, sample and expected calibration error; low where the error is null."""
    high = (support >= 100) & (n >= 200) & (error <= 0.05)
    return F.when(high, "high").when((support >= 30) & (n >= 50) & (error <= 0.12), "medium").otherwise("low")


def decision(p: Column, accept: float = 0.65, reject: float = 0.35) -> Column:
    return F.when(p >= accept, "accept").when(p <= reject, "reject").otherwise("borderline")
