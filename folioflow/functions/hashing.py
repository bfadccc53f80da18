"""Numbers out of hashes: reproducible splits, orders, ids and mock scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _bits(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(c, 256), 1, digits), 16, 10).cast("decimal(20,0)").cast("double")


def stable_unit(c: Column, seed: str, parity: bool = False) -> Column:
    """A number out of the first 52 bits of a seeded hash, from [0, 1).

    parity: divided by 2^53 - 1 as older splits were, which leaves all numbers below
    one half and so doubles small shares; for repeating those splits only.
    """
    value = _bits(F.concat(F.lit(seed), F.char(F.lit(0)), c), 13)
    return value / F.lit(9007199254740991.0 if parity else float(2**52))


def ratio_unit(c: Column, seed: str) -> Column:
    """A number from [0, 1) out of the first 64 bits of the hash of ``seed:value``."""
    return _bits(F.concat(F.lit(f"{seed}:"), c), 16) / F.lit(float(2**64))


def coin(c: Column, seed: str) -> Column:
    """0 or 1 by the first byte of the hash of ``seed:value``."""
    return (_bits(F.concat(F.lit(f"{seed}:"), c), 2) % 2).cast("int")


def mock_score(c: Column) -> Column:
    """A score from [-4, 4] by the first 32 bits of a hash, to six digits: a stand-in for a model."""
    return F.round(_bits(c, 8) / F.lit(float(2**32 - 1)) * 8 - 4, 6)


def hash_order(*parts: Column) -> Column:
    """A hash to sort by; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def short_id(c: Column, prefix: str, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, digits))


def set_digest(h: Column, size: int = 16) -> Column:
    """An aggregate: a digest of a group of distinct SHA-256 texts, the same in any order; its count, ends and sum are hashed, so that nothing is gathered."""
    total = F.sum(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.min(h), F.max(h), total), 256), 1, size)
