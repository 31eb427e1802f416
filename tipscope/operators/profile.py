"""Column profiles.

Distinct values with their counts, of all columns at once, are made by one pass
over the table (``value_counts``) and serve every profile: moments, quantiles,
extremes, distinct counts and bins are aggregates of that index. Missing counts
alone are one wide aggregate. No row is collected.
"""

from __future__ import annotations

import functools
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.functions.features import epoch_seconds
from tipscope.functions.shipping import ship
from tipscope.operators.ranges import directory
from tipscope.sources import files

ship(__name__)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def column_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns by family: numeric / string / time / other (proj_numeric_cols)."""
    out = {"numeric": [], "string": [], "time": [], "other": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, NUMERIC):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            out["string"].append(f.name)
        elif isinstance(f.dataType, TIMES):
            out["time"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def select_by_type(df: DataFrame, family: str = "numeric", exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the columns of one type family minus a list (proj_numeric_cols)."""
    return df.select(*[F.col(c) for c in column_types(df, exclude)[family]])


# ------------------------------------------------------------------ value counts
COUNT_FIELDS = "variable string, num double, text string, n long"


def _counted(names: Sequence[str], numbers: int):
    """Per batch the distinct values of every column with their counts; the first
    ``numbers`` columns are numbers. Missing is a row without a value."""
    def run(batches):
        for b in batches:
            rows = []
            for i, c in enumerate(b.columns):
                if i < numbers:
                    x = c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    there = x[~np.isnan(x)]
                    v, n = np.unique(there, return_counts=True)
                    num, text = pa.array(v, pa.float64()), pa.nulls(len(v), pa.string())
                    gone = len(x) - len(there)
                else:
                    vc = pc.value_counts(c.drop_null().cast(pa.string()))
                    text, n = vc.field(0), vc.field(1).to_numpy()
                    num, gone = pa.nulls(len(text), pa.float64()), c.null_count
                if gone:
                    num, text = pa.concat_arrays([num, pa.nulls(1, pa.float64())]), pa.concat_arrays([text, pa.nulls(1, pa.string())])
                    n = np.append(n, gone)
                rows.append((pa.array([names[i]] * len(text), pa.string()), num, text, pa.array(n, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(a) for a in zip(*rows)], names=["variable", "num", "text", "n"])
    return run


def value_counts(df: DataFrame) -> DataFrame:
    """The value index of a whole frame, from one pass, written: (variable, num,
    text, n) for every distinct value of every column. Numbers, and dates and
    times as epoch seconds, are in ``num``, other types as text. NULL and NaN are
    missing: a row with neither. Batches are counted in the scan, then by value
    over all tasks."""
    fam = column_types(df)
    numbers = fam["numeric"] + fam["time"]
    others = fam["string"] + fam["other"]
    cells = [F.col(f"`{c}`").cast("double") for c in fam["numeric"]]
    cells += [epoch_seconds(F.col(f"`{c}`")).cast("double") for c in fam["time"]]
    cells += [F.col(f"`{c}`").cast("string") for c in others]
    values = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    counted = values.mapInArrow(_counted(numbers + others, len(numbers)), COUNT_FIELDS)
    return files.stored(counted.groupBy("variable", "num", "text").agg(F.sum("n").alias("n")), "value-counts")


def _rows(index: DataFrame, names: Sequence[str]) -> DataFrame:
    return index.where(F.col("variable").isin(list(names)))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _moments(index: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, rows, there, lo, hi, mean, sd) of number columns. Squares are
    taken about the mean in a second pass over the index."""
    x = _rows(index, names)
    some = F.col("num").isNotNull()
    m = x.groupBy("variable").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("there"),
                                  F.min("num").alias("lo"), F.max("num").alias("hi"),
                                  F.sum(F.col("num") * F.col("n")).alias("total"))
    m = m.withColumn("mean", F.when(F.col("there") > 0, F.col("total") / F.col("there"))).drop("total")
    mean = m.select(F.col("variable").alias("_v"), F.col("mean").alias("_mean"))
    d = F.col("num") - F.col("_mean")
    # one row per column, so the broadcast is bounded by the schema
    sd = (x.join(F.broadcast(mean), F.col("variable") == F.col("_v")).groupBy(F.col("variable").alias("_w"))
          .agg(F.sum(d * d * F.col("n")).alias("_ss")))
    return (m.join(F.broadcast(sd), F.col("variable") == F.col("_w"), "left")
            .withColumn("sd", F.when(F.col("there") > 1, F.sqrt(F.col("_ss") / (F.col("there") - 1)))).drop("_w", "_ss"))


def _index_quantiles(index: DataFrame, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(variable, q0, q1, ...): exact quantiles (linear interpolation) by running
    sums of the counts, over ranges of the index."""
    x = _rows(index, names).where(F.col("num").isNotNull()).select("variable", "num", "n")
    total = x.groupBy(F.col("variable").alias("_v")).agg(F.sum("n").alias("_all"))
    base = F.coalesce(F.sum("_all").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.withColumn("_base", base)  # one row per column
    r = directory(x, ["variable", "num"], "n").running("n").join(F.broadcast(total), F.col("variable") == F.col("_v"))
    first = F.col("_offset") - F.col("_base")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("n")), F.col("num")))

    pos = [(F.col("_all") - 1) * F.lit(float(p)) for p in probs]
    found = r.groupBy("variable", "_all").agg(*[at(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(pos)],
                                              *[at(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(pos)])
    return found.select("variable", *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p))).alias(f"q{i}")
                                      for i, p in enumerate(pos)])


def _cells(wide: DataFrame, kinds: dict[str, str], stats: dict[str, Column]) -> DataFrame:
    """(skim_variable, skim_type, stat, value) from one row per column."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.cast("double").alias("value")) for k, v in stats.items()]))
    return wide.select(F.col("variable").alias("skim_variable"), F.element_at(_map(kinds), F.col("variable")).alias("skim_type"),
                       cells.alias("c")).select("skim_variable", "skim_type", "c.*")


def skim(df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """skim-like profile of every column: (skim_variable, skim_type, stat, value)
    (prof_skim), all from the value index (``value_counts(df)``, made here if not
    given). Columns that are no numbers, texts, dates or times have missing
    counts and distinct values only. A column without values has NULL statistics;
    an empty table gives no rows."""
    fam = column_types(df)
    index = value_counts(df) if index is None else index
    out = []
    rate = {"n_missing": F.col("rows") - F.col("there"), "complete_rate": F.col("there") / F.col("rows")}
    if fam["numeric"] or fam["time"]:
        names = fam["numeric"] + fam["time"]
        m = _moments(index, names)
        q = _index_quantiles(index, names, [0.25, 0.5, 0.75])
        unique = _rows(index, fam["time"]).groupBy(F.col("variable").alias("_u")).agg(F.count("num").alias("n_unique"))
        q = q.withColumnRenamed("variable", "_q")
        w = (m.join(F.broadcast(q), F.col("variable") == F.col("_q"), "left")
             .join(F.broadcast(unique), F.col("variable") == F.col("_u"), "left"))
        if fam["numeric"]:
            out.append(_cells(_rows(w, fam["numeric"]), dict.fromkeys(fam["numeric"], "numeric"), rate | {
                "mean": F.col("mean"), "sd": F.col("sd"), "p0": F.col("lo"), "p25": F.col("q0"), "p50": F.col("q1"),
                "p75": F.col("q2"), "p100": F.col("hi")}))
        if fam["time"]:
            kinds = {f.name: "Date" if isinstance(f.dataType, T.DateType) else "POSIXct" for f in df.schema.fields}
            out.append(_cells(_rows(w, fam["time"]), {c: kinds[c] for c in fam["time"]}, rate | {
                "min": F.col("lo"), "max": F.col("hi"), "median": F.col("q1"), "n_unique": F.col("n_unique")}))
    texts = fam["string"] + fam["other"]
    if texts:
        x, t = _rows(index, texts), F.col("text")
        size = F.length(t)
        w = x.groupBy("variable").agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(t.isNotNull(), F.col("n"))), F.lit(0)).alias("there"),
            F.min(size).alias("lo"), F.max(size).alias("hi"), F.count(t).alias("n_unique"),
            F.coalesce(F.sum(F.when(size == 0, F.col("n"))), F.lit(0)).alias("empty"),
            F.coalesce(F.sum(F.when(t.rlike(r"^\s+$"), F.col("n"))), F.lit(0)).alias("whitespace"))
        if fam["string"]:
            out.append(_cells(_rows(w, fam["string"]), dict.fromkeys(fam["string"], "character"), rate | {
                "min": F.col("lo"), "max": F.col("hi"), "empty": F.col("empty"), "n_unique": F.col("n_unique"),
                "whitespace": F.col("whitespace")}))
        if fam["other"]:
            out.append(_cells(_rows(w, fam["other"]), dict.fromkeys(fam["other"], "other"), rate | {"n_unique": F.col("n_unique")}))
    return functools.reduce(DataFrame.unionByName, out)


def skim_hist(df: DataFrame, bins: int = 8, index: DataFrame | None = None) -> DataFrame:
    """skim's inline histogram: ``bins`` equal-width bins of every numeric column
    between its min and max, empty bins included (prof_skim_hist), from the value
    index. A constant column has all its values in bin 0; a column without values,
    or with an infinite one, has no bins."""
    names = column_types(df)["numeric"]
    index = value_counts(df) if index is None else index
    x = _rows(index, names).where(F.col("num").isNotNull())
    rng = x.groupBy(F.col("variable").alias("_v")).agg(F.min("num").alias("_lo"), F.max("num").alias("_hi"))
    rng = rng.where((F.abs("_lo") < float("inf")) & (F.abs("_hi") < float("inf")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("num") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    # one row per column, and one per column and bin: bounded by the schema
    n = x.join(F.broadcast(rng), F.col("variable") == F.col("_v")).groupBy("variable", b.alias("bin")).agg(F.sum("n").alias("n"))
    every = rng.select(F.col("_v").alias("variable"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(F.broadcast(n), ["variable", "bin"], "left").select("variable", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def summary(df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Of every column (variable, stat, value) (prof_summary): min, Q1, median,
    mean, Q3, max and NA count of numbers, dates and times (as epoch seconds),
    length and NA count of the others, from the value index."""
    fam = column_types(df)
    names, texts = fam["numeric"] + fam["time"], fam["string"] + fam["other"]
    index = value_counts(df) if index is None else index
    out = []
    if names:
        q = _index_quantiles(index, names, [0.25, 0.5, 0.75]).withColumnRenamed("variable", "_q")
        w = _moments(index, names).join(F.broadcast(q), F.col("variable") == F.col("_q"), "left")
        out.append(_cells(w, dict.fromkeys(names, ""), {
            "min": F.col("lo"), "q1": F.col("q0"), "median": F.col("q1"), "mean": F.col("mean"), "q3": F.col("q2"),
            "max": F.col("hi"), "nas": F.col("rows") - F.col("there")}))
    if texts:
        w = _rows(index, texts).groupBy("variable").agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("nas"))
        out.append(_cells(w, dict.fromkeys(texts, ""), {"length": F.col("rows"), "nas": F.col("nas")}))
    return functools.reduce(DataFrame.unionByName, out).select(F.col("skim_variable").alias("variable"), "stat", "value")


def _gone(df: DataFrame, c: str) -> Column:
    """Whether a value is missing: NULL, or NaN in a floating column."""
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x.isNull()


def intro(df: DataFrame) -> DataFrame:
    """Rows, columns, discrete/continuous/all-missing columns, missing cells,
    complete rows, total observations (prof_intro). One pass."""
    fam = column_types(df)
    cols = df.columns
    nulls = [F.count_if(_gone(df, c)).alias(f"_m_{c}") for c in cols]
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | _gone(df, c)
    w = df.agg(F.count(F.lit(1)).alias("rows"), *nulls,
               F.count_if(~any_null).alias("complete_rows"))
    missing_cells = sum((F.col(f"_m_{c}") for c in cols), F.lit(0))
    all_missing = sum(((F.col(f"_m_{c}") == F.col("rows")).cast("long") for c in cols), F.lit(0))
    return w.select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(len(cols)).cast("long").alias("columns"),
        F.lit(len(fam["string"]) + len(fam["other"])).cast("long").alias("discrete_columns"),
        F.lit(len(fam["numeric"]) + len(fam["time"])).cast("long").alias("continuous_columns"),
        all_missing.cast("long").alias("all_missing_columns"),
        missing_cells.cast("long").alias("total_missing_values"),
        F.col("complete_rows").cast("long").alias("complete_rows"),
        (F.col("rows") * F.lit(len(cols))).cast("long").alias("total_observations"))


def missing(df: DataFrame) -> DataFrame:
    """Missing count and share per column, most missing first (prof_missing)."""
    cols = df.columns
    w = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.count_if(_gone(df, c)).alias(c) for c in cols])
    lg = w.unpivot(["_n"], cols, "variable", "n_missing")
    return (lg.select("variable", F.col("n_missing").cast("long").alias("n_missing"),
                      (F.col("n_missing") / F.col("_n")).alias("pct_missing"))
              .orderBy(F.col("n_missing").desc(), "variable"))


def structure(df: DataFrame, n_values: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """Column name, type and the first values (prof_structure). Reads only
    a bounded ``limit`` of rows (the first ones in ``order_by`` order when
    given, which makes the output deterministic)."""
    head = (df.orderBy(*order_by) if order_by else df).limit(n_values)
    cols = df.columns
    if order_by:
        # a window over the n_values limited rows only
        head = head.withColumn("_pos", F.row_number().over(Window.orderBy(*order_by)))
        w = head.agg(*[F.transform(F.array_sort(F.collect_list(F.struct(
            "_pos", F.col(c).cast("string").alias("v")))), lambda t: t["v"]).alias(c)
            for c in cols])
    else:
        w = head.agg(*[F.collect_list(F.col(c).cast("string")).alias(c) for c in cols])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lg = w.unpivot([], cols, "variable", "values")
    tmap = F.create_map(*[x for k, t in types.items() for x in (F.lit(k), F.lit(t))])
    return lg.select("variable", F.element_at(tmap, F.col("variable")).alias("type"),
                     F.array_join("values", ", ").alias("first_values"))
