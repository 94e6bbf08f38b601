"""Random numbers as pure functions of a seed and integer keys, so that results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A double in [0, 1) from the first 32 bits of the MD5 of seed|key|..."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def below(seed: int, n: Column | int, *keys) -> Column:
    """A whole number in 0 .. n - 1."""
    return F.floor(uniform(seed, *keys) * n).cast("int")


def uniform_sql(seed: int, *keys: str) -> str:
    """The same for DuckDB."""
    text = "||'|'||".join(["'" + str(seed) + "'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x'||substr(md5({text}),1,8))::UBIGINT::DOUBLE/4294967296.0)"
