"""Guards on what may be broadcast or brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast, and that the driver may take at once.
BROADCAST_ROWS = 200_000
DRIVER_ROWS = 100_000


def bounded_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of ``df``, which by construction are at most ``most``; more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows one, else as it is."""
    return F.broadcast(df) if small_enough(df, most) else df
