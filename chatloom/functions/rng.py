"""Content-derived randomness: a draw depends on the seed and the row's own key, never on partitioning or on
the attempt, so a lost executor recomputes the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(parts) -> list[Column]:
    return [(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]


def hash_hex(seed, *parts) -> Column:
    """md5 of ``seed:part:part…`` as 32 hex digits."""
    return F.md5(F.concat_ws(":", *_strings((seed, *parts))))


def u32(seed, *parts) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, 8), 16, 10).cast("bigint")


def u60(seed, *parts) -> Column:
    """Uniform integer in [0, 2**60), for draws from more rows than 32 bits can tell apart."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, 15), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return u32(seed, *parts) / F.lit(float(2**32))


def above(p: float, seed, *parts) -> Column:
    """``uniform(seed, …) > p``, decided on the digits."""
    limit = int(p * 2**32)
    if limit >= 2**32:
        return F.lit(False)
    return F.substring(hash_hex(seed, *parts), 1, 8) > F.lit(f"{limit:08x}")


def index_below(n, seed, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(u32(seed, *parts), n if isinstance(n, Column) else F.lit(n)).cast("int")


def key_columns(key: str | Sequence[str]) -> list[Column]:
    return [F.col(k) for k in ([key] if isinstance(key, str) else key)]
