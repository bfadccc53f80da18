"""Joining the rows of a sparse matrix with a vector, however often one key stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.sizes import BROADCAST_ROWS, bounded_rows

#: Rows of one key from which they are spread, and the most keys that can have a share large enough to be.
HOT_ROWS, HOT_KEYS = 100_000, 1000


class Joined:
    """The rows of a matrix, to be joined with vectors on ``key``.

    entries: a table that is cut off its lineage, since it is read for every vector;
    ``other`` is a column that spreads the rows of one key evenly. size: rows of the
    vectors. A vector of at most ``most`` rows is broadcast, so that the matrix is not
    shuffled. A larger one meets it by a shuffle on the key, of which keys of more than
    HOT_ROWS rows (and of a thousandth of all: at most HOT_KEYS) are salted, with the
    vector's row of such a key once per salt. Null keys meet nothing.
    """

    def __init__(self, entries: DataFrame, key: str, other: str, size: int, most: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS):
        self.key, self.small = key, size <= most
        self.entries, self.hot = entries.filter(F.col(key).isNotNull()), None
        if self.small:
            return
        counts = self.entries.groupBy(key).agg(F.count("*").alias("_n"))
        least = max(hot_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
        hot = bounded_rows(counts.filter(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")), HOT_KEYS, "hot keys")
        if hot:
            self.hot = entries.sparkSession.createDataFrame(hot, counts.select(key, F.lit(0).alias("_parts")).schema)
            parts = F.coalesce("_parts", F.lit(1))
            self.entries = self.entries.join(F.broadcast(self.hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), parts)).drop("_parts")

    def with_vector(self, vector: DataFrame) -> DataFrame:
        """Every row of the matrix with the vector's row of its key; rows without one are left out."""
        if self.small:
            return self.entries.join(F.broadcast(vector), self.key)
        if self.hot is None:
            return self.entries.join(vector, self.key)
        salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1)
        spread = vector.join(F.broadcast(self.hot), self.key, "left").withColumn("_salt", F.explode(salts)).drop("_parts")
        return self.entries.join(spread, [self.key, "_salt"]).drop("_salt")
