"""Queries behind the dashboard views. The UI is not built;
each view is a function (extract, filter state, options) -> DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions import features as fx
from tipscope.operators import filters as flt
from tipscope.operators.sampling import page

# Dashboard level orders
WEEKDAY_LEVELS = fx.WEEKDAY_ABBR_MON_FIRST
MONTH_LEVELS = fx.MONTH_ABBR
SEASON_LEVELS = ("No", "Yes")


@dataclass
class FilterState:
    months: Sequence[str] = field(default_factory=lambda: list(MONTH_LEVELS))
    weekdays: Sequence[str] = field(default_factory=lambda: list(WEEKDAY_LEVELS))


def recode(extract: DataFrame) -> DataFrame:
    """Start-up recoding: month number -> Jan..Dec, season 0/1 -> No/Yes,
    payment type as text, with level-rank columns for ordering (ft_month_name,
    ft_season_label, ft_level_order, proj_cast_factor)."""
    out = extract.withColumns({
        "month": fx.month_name(F.col("month")),
        "tourist_season": fx.season_label("tourist_season"),
        "payment_type": F.col("payment_type").cast("string"),
    })
    return out.withColumns({
        "month_level": fx.level_rank("month", MONTH_LEVELS),
        "pickup_weekday_level": fx.level_rank("pickup_weekday_name", WEEKDAY_LEVELS),
    })


def load(spark, path: str, schema, store_path: str | None = None) -> DataFrame:
    """Start-up: read the extract CSV with its schema, recode it and keep the
    recoded table as parquet (``store_path``, default next to the shared
    checkpoint folder) so every view reads columnar data (SURVEY §3 B)."""
    from tipscope.sources import files
    recoded = recode(files.extract_csv(spark, path, schema))
    target = store_path or files.scratch_path(spark, "dashboard_recoded")
    return files.cached_table(spark, target, lambda: recoded, force_rebuild=True)


def filtered(df: DataFrame, state: FilterState) -> DataFrame:
    """The filtered_data() view (flt_dashboard)."""
    return flt.dashboard(df, state.months, state.weekdays)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None,
            log_scale: bool = False) -> DataFrame:
    """Point table with tooltip text ``name: value`` parts joined by <br>
    (scat_dashboard, flt_pair_not_null, flt_log_positive)."""
    d = flt.pair_not_null(df, x, y)
    d = flt.log_positive(d, x, y, log_scale, log_scale)
    parts = [F.concat(F.lit(f"{x}: "), F.col(x).cast("string")),
             F.concat(F.lit(f"{y}: "), F.col(y).cast("string"))]
    col = F.lit("All")
    if color:
        col = F.col(color).cast("string")
        parts.append(F.concat(F.lit(f"{color}: "), col))
    return d.select(F.col(x).alias("x"), F.col(y).alias("y"), col.alias("color"),
                    F.concat_ws("<br>", *parts).alias("tooltip"))


def bar(df: DataFrame, x: str, fill: str | None = None, percent: bool = False) -> DataFrame:
    """Bar heights: counts by x (and fill); ``percent`` gives each fill level's
    share inside its bar (agg_bar_count, agg_bar_count_fill, win_pct_share).
    The share window runs over the aggregated counts only."""
    keys = [x] + ([fill] if fill else [])
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if fill and percent:
        c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(x)))
    return c


def table_page(df: DataFrame, key: Sequence[str], search: str | None = None,
               page_no: int = 1, page_size: int | None = 10) -> DataFrame:
    """One page of the searchable data table (flt_table_search, lim_page)."""
    d = flt.table_search(df, search) if search else df
    return page(d, page_no, page_size, key)
