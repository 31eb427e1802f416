"""Influence and residual diagnostics of a least-squares fit.

All measures are closed forms of the residual, the leverage and the fit's
scalars, so they are row expressions over the model frame: no row is
collected and no refit is run.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions.distributions import normal_quantile
from tipscope.operators.regression import OlsFit, Terms, with_fit
from tipscope.operators.ranges import directory


def influence(df: DataFrame, y: Column, terms: Terms, f: OlsFit,
              keep: Sequence[str] = ()) -> DataFrame:
    """Model frame plus fitted, resid, leverage, std_resid, rstudent, cooks_d,
    sqrt_abs_std_resid (dia_leverage, dia_rstudent, dia_cooks,
    dia_scale_location, dia_resid_leverage, dia_resid_fitted)."""
    s2 = f.sigma2
    P = f.n_params
    dfr = f.df_resid
    d = with_fit(df, y, terms, f, keep).withColumn("leverage", f.leverage())
    e, h = F.col("resid"), F.col("leverage")
    d = d.withColumn("std_resid", e / F.sqrt(F.lit(s2) * (1 - h)))
    s_i2 = (F.lit(dfr * s2) - e * e / (1 - h)) / F.lit(dfr - 1)
    d = d.withColumn("rstudent", e / F.sqrt(s_i2 * (1 - h)))
    d = d.withColumn("cooks_d", e * e * h / (F.lit(P * s2) * (1 - h) * (1 - h)))
    return d.withColumn("sqrt_abs_std_resid", F.sqrt(F.abs(F.col("std_resid"))))


def flags(infl: DataFrame, f: OlsFit, resid_cut: float = 3.0, lev_mult: float = 3.0,
          cook_cut: float = 1.0) -> DataFrame:
    """Rows flagged by |rstudent| > 3, leverage > 3p/n or Cook's D > 1 (dia_flags)."""
    lev_cut = lev_mult * f.n_params / f.n
    return (infl.withColumns({
        "flag_rstudent": F.abs("rstudent") > resid_cut,
        "flag_leverage": F.col("leverage") > lev_cut,
        "flag_cooks": F.col("cooks_d") > cook_cut})
        .where(F.col("flag_rstudent") | F.col("flag_leverage") | F.col("flag_cooks")))


def top_by_measure(infl: DataFrame, key: Sequence[str], k: int = 10,
                   measures: Sequence[str] = ("cooks_d", "rstudent", "leverage")) -> DataFrame:
    """(measure, key, value): the k rows with the largest |value| of each measure
    from one pass (srt_topk_abs). A row is unfolded to its key and one value for
    each measure, and the group limit before the shuffle leaves k rows for each
    measure and task. Missing values come last; ties go by key."""
    key = list(key)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                                for m in measures])).alias("c")
    r = infl.select(*key, cells).select("c.measure", *key, "c.value")
    size = F.when(~F.isnan("value"), F.abs("value")).desc_nulls_last()
    nth = F.row_number().over(Window.partitionBy("measure").orderBy(size, *key))
    return r.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def top_influential(infl: DataFrame, key: Sequence[str], k: int = 10) -> DataFrame:
    """Keys of the top-k rows by Cook's D, by |rstudent| and by leverage,
    de-duplicated (set_union_distinct): at most 3 k rows."""
    return top_by_measure(infl, key, k).select(*key).distinct()


def qq(infl: DataFrame, col: str = "std_resid") -> DataFrame:
    """Normal Q-Q table, one row per residual: its rank ``i``, plotting position
    ``p``, value ``sample`` and the normal quantile ``theoretical`` (dia_qq).
    Ranks are places in key order, counted over ranges of rows, so neither all
    values nor all ties of one meet in a task; missing residuals have no row."""
    x = infl.select(F.col(col).cast("double").alias("sample")).where(F.col("sample").isNotNull() & ~F.isnan("sample"))
    d = directory(x, ["sample"])
    n = d.ranges.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))
    a = F.when(F.col("n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    p = (F.col("i") - a) / (F.col("n") + 1 - 2 * a)
    ranked = d.positions().select((F.col("_pos") + 1).alias("i"), "sample")
    return ranked.crossJoin(F.broadcast(n)).select("i", p.alias("p"), "sample").withColumn(
        "theoretical", normal_quantile(F.col("p")))
