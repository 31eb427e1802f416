"""Tables behind the charts: histograms, box plots, densities, point sets
(SURVEY §2.5).

Ranges and quantiles are one-row (or one-row-per-group) aggregates joined
back to the rows; bins are plain arithmetic, counted with one grouped
aggregate. The density never crosses rows with the grid: values are
counted first, and batches of counted values give their sums of kernels.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.functions.shipping import ship
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators.quantiles import exact_quantiles

ship(__name__)

MAX_GROUPS_BROADCAST = 1_000_000
#: Kernel values held at a time.
KERNELS = 1 << 20


def _groups(group: str | Sequence[str] | None) -> list[str]:
    if group is None:
        return []
    return [group] if isinstance(group, str) else list(group)


def _number(col: str) -> Column:
    """The column as a double; NaN counts as missing."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def _attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-group statistics back to the rows (broadcast after a size
    check); a NULL key is a group of its own."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    mark = [f"_k{i}" for i in range(len(keys))]
    stats = broadcast_if_small(stats.withColumnsRenamed(dict(zip(keys, mark))), MAX_GROUPS_BROADCAST)
    same = F.lit(True)
    for k, m in zip(keys, mark):
        same = same & F.col(k).eqNullSafe(F.col(m))
    return df.join(stats, same).drop(*mark)


def hist_equal(df: DataFrame, col: str, bins: int = 30,
               view: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram from min to max (hist_equal).

    Returns (bin, xmin, xmax, n) for every bin, empty ones with n = 0; a
    constant column has one bin. The last bin is closed on the right. A
    ``view`` range only filters the output bins, as a zoomed chart does.
    """
    x = _number(col)
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    counted = (df.where(x.isNotNull()).select(x.alias("_x"))
                 .crossJoin(F.broadcast(rng))
                 .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    last = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.lit(bins - 1))
    every = rng.where(F.col("_lo").isNotNull()).select("_lo", "_hi", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    out = every.join(counted, "bin", "left").select(
        "bin", (F.col("_lo") + F.col("bin") * w).alias("xmin"),
        (F.col("_lo") + (F.col("bin") + 1) * w).alias("xmax"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    if view is not None:
        out = out.where((F.col("xmax") >= view[0]) & (F.col("xmin") <= view[1]))
    return out


def _pretty_unit(cell: Column) -> Column:
    """Nice step for a cell width, after R's ``pretty`` (units 1, 2, 5, 10 x 10^k,
    high-unit bias h = 1.5, h5 = 0.5 + 1.5 h)."""
    h, h5 = 1.5, 0.5 + 1.5 * 1.5
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    u = base
    u = F.when(F.lit(2) * base - cell < h * (cell - u), F.lit(2) * base).otherwise(u)
    u = F.when(F.lit(5) * base - cell < h5 * (cell - u), F.lit(5) * base).otherwise(u)
    u = F.when(F.lit(10) * base - cell < h * (cell - u), F.lit(10) * base).otherwise(u)
    return u


def hist_pretty(df: DataFrame, col: str) -> DataFrame:
    """Base-R style histogram: Sturges class count, rounded breaks, right-closed
    bins with the lowest break included (hist_pretty). Returns
    (bin, break_lo, break_hi, n) for every bin up to the maximum's."""
    x = _number(col)
    st = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    k = F.ceil(F.log2(F.col("_n")) + 1)
    cell = F.greatest((F.col("_hi") - F.col("_lo")) / k, F.lit(1e-12))
    st = st.withColumn("_u", _pretty_unit(cell))
    st = st.withColumn("_b0", F.floor(F.col("_lo") / F.col("_u")) * F.col("_u"))
    b = F.greatest(F.ceil((F.col("_x") - F.col("_b0")) / F.col("_u")), F.lit(1)).cast("int")
    counted = (df.where(x.isNotNull()).select(x.alias("_x")).crossJoin(F.broadcast(st))
                 .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    last = F.greatest(F.ceil((F.col("_hi") - F.col("_b0")) / F.col("_u")), F.lit(1)).cast("int")
    every = st.where(F.col("_n") > 0).select("_b0", "_u", F.explode(F.sequence(F.lit(1), last)).alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.col("_b0") + (F.col("bin") - 1) * F.col("_u")).alias("break_lo"),
        (F.col("_b0") + F.col("bin") * F.col("_u")).alias("break_hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def hist_median_line(df: DataFrame, col: str, bins: int = 100,
                     view: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram plus the median marker and its cent label
    (hist_median_line)."""
    med = df.agg(F.percentile(F.col(col), F.lit(0.5)).alias("median"))
    med = med.withColumn("median_label", F.format_number(F.round("median", 2), 2))
    return hist_equal(df, col, bins, view).crossJoin(F.broadcast(med))


def _quartiles(base: DataFrame, keys: list[str], probs, names, method: str) -> DataFrame:
    if method == "bracket":
        return exact_quantiles(base, "_x", probs, keys, names)
    q = base.groupBy(*keys).agg(F.percentile("_x", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    return q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def box_stats(df: DataFrame, value: str, group: str | Sequence[str] | None = None,
              coef: float = 1.5, method: str = "bracket") -> DataFrame:
    """Box-plot statistics per group: quartiles, whisker ends (most extreme
    values inside the 1.5 IQR fences), outlier count (box_stats).

    method='bracket' (default) computes the exact quartiles with bounded
    memory per group (see operators.quantiles); 'map' uses Spark's exact
    percentile, which holds every distinct value of a group in one task."""
    keys = _groups(group)
    x = _number(value)
    base = df.where(x.isNotNull()).select(*keys, x.alias("_x"))
    q = _quartiles(base, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], method)
    q = q.withColumn("lower_fence", F.col("q1") - coef * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper_fence", F.col("q3") + coef * (F.col("q3") - F.col("q1")))
    j = _attach(base, q, keys)
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    return j.groupBy(*keys, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def box_outliers(df: DataFrame, value: str, group: str | Sequence[str] | None = None,
                 coef: float = 1.5, method: str = "bracket") -> DataFrame:
    """The rows outside the 1.5 IQR fences of their group (box_outliers)."""
    keys = _groups(group)
    x = _number(value)
    base = df.where(x.isNotNull()).select(*keys, x.alias("_x"))
    q = _quartiles(base, keys, [0.25, 0.75], ["_q1", "_q3"], method)
    q = q.select(*keys, (F.col("_q1") - coef * (F.col("_q3") - F.col("_q1"))).alias("_lf"),
                 (F.col("_q3") + coef * (F.col("_q3") - F.col("_q1"))).alias("_uf"))
    return (_attach(df, q, keys).where((x < F.col("_lf")) | (x > F.col("_uf")))
              .drop("_lf", "_uf"))


def _bandwidth() -> Column:
    """nrd0: 0.9 times the smaller of sd and IQR / 1.34, or where that is 0 the sd,
    else |min|, else 1, times n^-1/5."""
    sd, iqr = F.coalesce("_sd", F.lit(0.0)), (F.col("_q3") - F.col("_q1")) / 1.34
    spread = F.least(sd, iqr)
    for other in (sd, F.abs("_min"), F.lit(1.0)):
        spread = F.when(spread > 0, spread).otherwise(other)
    return 0.9 * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))


def _smoothed(keys: int, n_grid: int, step: int):
    """Of one group's bins the density at every ``step``-th node: one convolution
    of the weights with the kernel."""
    nodes = (n_grid - 1) * step + 1
    size = 1 << (2 * nodes - 1).bit_length()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi, n, bw = (group[c].iloc[0] for c in ("_glo", "_ghi", "_n", "bw"))
        at = group["_bin"].to_numpy(np.int64)
        weight = np.zeros(nodes + 1)
        np.add.at(weight, at, group["_left"].to_numpy())
        np.add.at(weight, at + 1, group["_right"].to_numpy())
        width = (hi - lo) / (nodes - 1)
        lag = np.arange(nodes) * width / bw
        kernel = np.zeros(size)
        kernel[:nodes] = np.exp(-0.5 * lag * lag)
        kernel[size - nodes + 1:] = kernel[nodes - 1:0:-1]
        s = np.fft.irfft(np.fft.rfft(weight[:nodes], size) * np.fft.rfft(kernel), size)[:nodes:step]
        i = np.arange(n_grid)
        out = pd.DataFrame({"i": i.astype(np.int32), "x": lo + i * (hi - lo) / (n_grid - 1),
                            "density": np.maximum(s, 0) / (n * bw * math.sqrt(2 * math.pi)), "bw": bw})
        for k in range(keys):
            out.insert(k, f"_g{k}", group[f"_g{k}"].iloc[0])
        return out
    return run


def _kernel_sums(keys: int, n_grid: int):
    """Per batch of counted values the sum of kernels at every point of the grid,
    one row for each group that the batch has."""
    points = np.arange(n_grid)[:, None]
    step = max(1, KERNELS // n_grid)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            group = np.zeros(b.num_rows, np.int64)
            for c in b.columns[:keys]:
                code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
                group = np.unique(np.stack([group, code]), axis=1, return_inverse=True)[1].ravel()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
            n, bw, lo, hi, x, times = (c.to_numpy() for c in b.columns[keys:])
            sums = np.zeros((len(first), n_grid))
            for i, rows in enumerate(np.split(order, first[1:])):
                at = rows[0]
                grid = lo[at] + points * (hi[at] - lo[at]) / (n_grid - 1)
                for j in range(0, len(rows), step):
                    part = rows[j:j + step]
                    z = (grid - x[part]) / bw[at]
                    sums[i] += np.exp(-0.5 * z * z) @ times[part]
            heads = pa.array(order[first])
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * n_grid, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([c.take(heads) for c in b.columns[:keys + 4]] + [each], names=[*b.schema.names[:keys + 4], "_s"])
    return run


def kde(df: DataFrame, value: str, group: str | Sequence[str] | None = None,
        n_grid: int = 512, cut: float = 3.0, bw: float | None = None, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on an ``n_grid`` grid from min - cut*bw to
    max + cut*bw, nrd0 bandwidth (dens_kde).

    The exact sum over all values: equal values are counted, and batches of
    (value, count) give their sums at every point of the grid, which are added up.
    Work is grid times distinct values, spread over tasks that hold a batch.

    ``bins`` gives a near result in work of rows plus grid: values are shared out
    linearly to the two nearest nodes of a grid of at least ``bins`` cells that
    holds the output's points, counted by one grouped aggregate; each group's nodes
    are then convolved with the kernel once. This differs from the exact sum by at
    most ``(cell / bw)^2 / 8 / (bw * sqrt(2 pi))``.

    NULL and NaN are left out, a NULL key is a group of its own, a group without
    values has no row.
    """
    keys = _groups(group)
    x = _number(value)
    names = [f"_g{i}" for i in range(len(keys))]
    base = df.where(x.isNotNull()).select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, names)], x.alias("_x"))
    st = base.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    st = _attach(st, exact_quantiles(base, "_x", [0.25, 0.75], names, ["_q1", "_q3"]), names)
    st = st.where("_n > 0").withColumn("bw", F.lit(float(bw)) if bw is not None else _bandwidth())
    st = st.select(*names, "_n", "bw", (F.col("_min") - cut * F.col("bw")).alias("_glo"), (F.col("_max") + cut * F.col("bw")).alias("_ghi"))
    if bins is None:
        counted = base.groupBy(*names, "_x").agg(F.count(F.lit(1)).cast("double").alias("_times"))
        j = _attach(counted, st, names).select(*names, F.col("_n").cast("double").alias("_n"), "bw", "_glo", "_ghi", "_x", "_times")
        fields = T.StructType([*j.schema.fields[:-2], T.StructField("_s", T.ArrayType(T.DoubleType()))])
        sums = j.mapInArrow(_kernel_sums(len(names), n_grid), fields)
        g = sums.select(*j.columns[:-2], F.posexplode("_s").alias("i", "_s"))
        g = g.groupBy(*j.columns[:-2], "i").agg(F.sum("_s").alias("_s"))
        return g.select(*[F.col(a).alias(k) for a, k in zip(names, keys)], "i",
                        (F.col("_glo") + F.col("i") * (F.col("_ghi") - F.col("_glo")) / (n_grid - 1)).alias("x"),
                        (F.col("_s") / (F.col("_n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"), "bw")
    step = -(-bins // (n_grid - 1))
    cells = (n_grid - 1) * step
    j = _attach(base, st, names)
    at = (F.col("_x") - F.col("_glo")) / ((F.col("_ghi") - F.col("_glo")) / cells)
    j = j.select(*names, "_n", "bw", "_glo", "_ghi", F.floor(at).cast("long").alias("_bin"), at.alias("_at"))
    part = F.col("_at") - F.col("_bin")
    w = j.groupBy(*names, "_n", "bw", "_glo", "_ghi", "_bin").agg(F.sum(1 - part).alias("_left"), F.sum(part).alias("_right"))
    kinds = [f"{g} {base.schema[g].dataType.simpleString()}" for g in names]
    out = w.groupBy(*names).applyInPandas(_smoothed(len(names), n_grid, step), ", ".join([*kinds, "i int, x double, density double, bw double"]))
    return out.withColumnsRenamed(dict(zip(names, keys)))


def scatter(df: DataFrame, x: str, y: str, color: str | Column | None = None,
            view: dict[str, tuple[float, float]] | None = None,
            max_points: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Point set (x, y[, color]) inside an optional view window (scat_points,
    scat_zero_flag). ``max_points`` draws a hash-ordered sample of that size
    for drawing; by default every point is returned."""
    cols = [F.col(x).alias("x"), F.col(y).alias("y")]
    if color is not None:
        cols.append((F.col(color) if isinstance(color, str) else color).alias("color"))
    out = df.select(*[F.col(k) for k in key], *cols)
    for c, (lo, hi) in (view or {}).items():
        name = "x" if c == x else "y" if c == y else c
        out = out.where(F.col(name).between(lo, hi))
    if max_points is not None:
        h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
        out = out.orderBy(h).limit(max_points)
    return out


def zero_flag(col: str = "tip_amount") -> Column:
    """Colour flag: tip equals zero (scat_zero_flag)."""
    return F.col(col) == 0
