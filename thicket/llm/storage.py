"""Tables in the folder that all executors share, and what of them may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, recorded, shared_dir, written

__all__ = ["discard", "recorded", "shared_dir", "small", "written"]

#: Rows up to which `small` lets a narrow table be broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """`df`, a written table of a few narrow columns, marked for broadcasting if it is counted to be small.

    Beyond the bound it stays unmarked and joins by shuffle.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
