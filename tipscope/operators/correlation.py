"""Pairwise-complete Pearson correlation.

Each pair uses only rows where both values are present; a constant column
yields NULL instead of the divide-by-zero error ``corr`` raises under ANSI mode
(trap T5). The cross-products of all pairs come from one pass over the columns
(``moments.pairwise``). Results are in long form (var_x, var_y, r).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.operators.factors import levels
from tipscope.operators.moments import pairwise
from tipscope.operators.profile import column_types

# The numeric columns of the final notebook's matrix
COR_VARS = ("fare_amount", "trip_distance", "extra", "pickup_hour", "dropoff_hour",
            "trip_minutes", "trip_speed_mph", "tip_amount", "pickup_weekday_num",
            "total_amount")
# Of a categorical column with more levels no indicator columns are made
MAX_LEVELS = 20
# A column whose spread is below this share of its size is constant but for rounding
FLAT = 1e-13


def _flat(m2: str, mean: str) -> Column:
    return F.col(m2) <= F.lit(FLAT * FLAT) * F.col("n") * F.col(mean) * F.col(mean)


def _r() -> Column:
    """Pearson r of a pair's moments; NULL where a side is constant."""
    r = F.try_divide(F.col("c_xy"), F.sqrt("m2_x") * F.sqrt("m2_y"))
    return F.when(~_flat("m2_x", "mean_x") & ~_flat("m2_y", "mean_y"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def matrix(df: DataFrame, cols: Sequence[str] = COR_VARS, upper: bool = False,
           exprs: Sequence[Column] | None = None) -> DataFrame:
    """Full (or upper-triangle, i <= j) correlation matrix in long form
    (cor_matrix, cor_upper), any number of columns; ``exprs`` are the columns'
    values where they are not plain columns. A pair without a common row, and an
    empty table, have NULL."""
    cols = list(cols)
    m = pairwise(df, list(exprs or cols), cols)
    if upper:
        at = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
        m = m.where(F.element_at(at, F.col("var_x")) <= F.element_at(at, F.col("var_y")))
    return m.select("var_x", "var_y", _r().alias("r"))


def dummy_terms(df: DataFrame, exclude: Sequence[str] = (), most: int = MAX_LEVELS) -> dict[str, Column]:
    """Name and value of every numeric column and of a 0/1 indicator ``col_level``
    of every level of every string or boolean column; dates and times are left
    out, as are columns with more than ``most`` levels."""
    fam = column_types(df, exclude)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {c: F.col(c).cast("double") for c in fam["numeric"]}
    categorical = fam["string"] + [c for c in fam["other"] if isinstance(kinds[c], T.BooleanType)]
    for c, found in levels(df, categorical, most).items():
        for lv in found:
            out[f"{c}_{lv}"] = (F.col(c).cast("string") == F.lit(lv)).cast("double")
    return out


def with_dummies(df: DataFrame, exclude: Sequence[str] = (), most: int = MAX_LEVELS) -> DataFrame:
    """The correlation matrix of the whole frame, indicator columns of all
    categorical levels included (cor_dummies); levels come from the data."""
    terms = dummy_terms(df, exclude, most)
    return matrix(df, list(terms), upper=True, exprs=list(terms.values()))


def rank_target(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Predictors ordered by |r| with the target (cor_rank_target)."""
    lg = matrix(df, [*cols, target]).where((F.col("var_y") == target) & (F.col("var_x") != target))
    lg = lg.select(F.col("var_x").alias("variable"), "r", F.abs("r").alias("abs_r"))
    # one row per predictor: the window orders p rows, not the data
    return lg.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("abs_r").desc_nulls_last(), "variable")).cast("long"))
