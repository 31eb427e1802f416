"""Size-checked broadcast.

A side is broadcast only after a bounded probe proves it holds at most
``max_rows`` rows (``limit(max_rows + 1).count()`` stops reading once the
bound is passed). Beyond the bound the plain DataFrame is returned and
Spark plans a shuffle join instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Probed at every call, as
    the files behind a plan may have been rewritten since the last one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows) else df
