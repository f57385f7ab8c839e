"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    """x ln x, 0 where x is not positive."""
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log10_or_none(p: Column) -> Column:
    """log10 of a probability; null for 0."""
    return F.when(p > 0, F.log10(p))


def uniform32(*parts: Column | str | int) -> Column:
    """A hash of the parts, joined by '|', as an integer in [0, 2**32): the same in any partitioning."""
    joined = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def truncated(ctx: Column, n: int) -> Column:
    """The n newest words of a context, which has the newest first."""
    return F.slice(ctx, 1, n)
