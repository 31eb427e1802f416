"""Sampling, ordering, limits and sets.

Random draws are hash-ordered (``md5(seed|key)``) so a sample is the same
on every run, after executor loss and in the SQL oracle. The stratified
sample is ``row_number() <= n`` per stratum: Spark plans a
``WindowGroupLimit`` before the shuffle, so every map task forwards at
most ``n`` rows per stratum and a hot stratum costs no more shuffle than
a cold one.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators.ranges import directory

DEFAULT_SEED = 123


def hash_key(key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Reproducible pseudo-random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def per_stratum(target_n: int, n_strata: int) -> int:
    """ceil(target / strata), the reference's per-file quota."""
    return int(math.ceil(target_n / max(n_strata, 1)))


def stratified(df: DataFrame, strata: str | Sequence[str], n_per: int,
               key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly min(rows, n_per) rows per stratum, without replacement (smp_stratified)."""
    strata = [strata] if isinstance(strata, str) else list(strata)
    w = Window.partitionBy(*strata).orderBy(hash_key(key_cols, seed), *key_cols)
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n_per).drop("_rn"))


def fixed_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """n pseudo-random rows of the whole table (smp_fixed_n); a bounded top-n."""
    return (df.withColumn("_h", hash_key(key_cols, seed))
              .orderBy("_h", *key_cols).limit(n).drop("_h"))


def topk(df: DataFrame, score: str | Column, k: int, tiebreak: Sequence[str] = (),
         descending: bool = True) -> DataFrame:
    """k best rows by a score with a stable tiebreak (srt_topk_desc, T21)."""
    s = F.col(score) if isinstance(score, str) else score
    order = [s.desc_nulls_last() if descending else s.asc_nulls_last()]
    return df.orderBy(*order, *[F.col(c).asc() for c in tiebreak]).limit(k)


def topk_abs(df: DataFrame, col: str, k: int, key: Sequence[str]) -> DataFrame:
    """k rows with the largest |col| (srt_topk_abs)."""
    return df.orderBy(F.abs(F.col(col)).desc_nulls_last(), *key).limit(k)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """Union of several row sets without duplicates (set_union_distinct)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def head(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """First n rows in key order (lim_head)."""
    return df.orderBy(*key).limit(n)


def page(df: DataFrame, page_no: int, page_size: int | None, key: Sequence[str]) -> DataFrame:
    """One page (1-based) of a key-ordered table; page_size None = all (lim_page).
    For many pages of a table keep ``ranges.directory(df, key)`` and slice it."""
    if page_size is None:
        return df.orderBy(*key)
    return directory(df, key).slice((page_no - 1) * page_size, page_size)


def row_lookup(df: DataFrame, keys: DataFrame, key_cols: Sequence[str],
               max_keys: int = 1_000_000) -> DataFrame:
    """Rows whose key is in ``keys`` (lim_row_lookup); semi join on the trip key."""
    k = broadcast_if_small(keys.select(*key_cols).distinct(), max_keys)
    return df.join(k, list(key_cols), "left_semi")


def pct_share(counts: DataFrame, x: str, n: str = "n", name: str = "share") -> DataFrame:
    """n / sum(n) within each x (win_pct_share). Runs on an aggregated count
    table, so the window partitions hold one row per fill level."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(x)))
