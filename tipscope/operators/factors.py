"""Categorical columns: their levels, and indicator terms for models."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.operators.moments import Indicator

# A factor with more levels is refused: a fit solves a matrix of that size on the driver
MAX_FACTOR_LEVELS = 1000


def levels(df: DataFrame, cols: Sequence[str], most: int) -> dict[str, list]:
    """The sorted levels, as text, of each column that has at most ``most`` (NULL
    is no level); other columns are left out. A sketch leaves out columns with far
    more, so only few distinct values are shuffled; the driver gets at most
    ``most + 1`` of a column."""
    if not cols:
        return {}
    about = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if about[i] <= 2 * most + 10]
    if not cols:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    seen = df.select(F.explode(cells).alias("v")).select("v.*").where("level IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("variable").orderBy("level"))
    found = seen.withColumn("nth", nth).where(F.col("nth") <= most + 1).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in sorted(found, key=lambda r: r.nth):
        out[r.variable].append(r.level)
    return {c: v for c, v in out.items() if len(v) <= most}


def terms(df: DataFrame, predictors: Sequence[str], factors: Sequence[str],
          orders: dict[str, Sequence[str]] | None = None) -> tuple[list[tuple[str, Column]], dict[str, list[str]]]:
    """(terms, blocks): a numeric predictor is one term; a factor has an indicator
    ``name_level`` for every level in the data but the first (treatment contrasts).
    Levels are sorted as text, or as ``orders`` lists them. A NULL stays NULL, so
    the row is not complete. Indicators name their factor, so that a fit can read
    one column for all of them."""
    found = levels(df, [c for c in predictors if c in factors], MAX_FACTOR_LEVELS)
    out, blocks = [], {}
    for c in predictors:
        if c not in factors:
            out.append((c, F.col(c)))
            blocks[c] = [c]
            continue
        if c not in found:
            raise ValueError(f"{c} has more than {MAX_FACTOR_LEVELS} levels")
        order = list((orders or {}).get(c, []))
        own = sorted(found[c], key=lambda lv: (order.index(lv) if lv in order else len(order), lv))
        blocks[c] = [f"{c}_{lv}" for lv in own[1:]]
        out += [Indicator(f"{c}_{lv}", c, lv) for lv in own[1:]]
    return out, blocks
