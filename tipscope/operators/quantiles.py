"""Exact quantiles with bounded memory (R type 7 / linear interpolation).

Spark's exact ``percentile`` keeps a value->count map per group, and the
final merge of a group happens in one task: fine for cent-quantised money
(few distinct values), unbounded for continuous columns such as tip
percentages, durations or speeds when one group holds a third of the rows.

``exact_quantiles`` works on counts of values instead, never on rows:

1. a mergeable sketch (``percentile_approx``) gives, per group, values a
   little below and above each wanted rank; they cut the group into ranges;
2. the rows of each range are counted, and the prefix sums of those counts
   say exactly which range holds a wanted rank;
3. the values of those ranges alone are counted by (group, value), with
   map-side sums, and a running sum of the counts within the range finds the
   two order statistics around rank h = (n - 1) p + 1.

A value that is tied over most rows is one counted row. The cuts only decide
how much step 3 reads, never the answer: a range holds about 6 / ACCURACY of
its group's distinct values, and its running sum spills.

Defined cases: NULL and NaN values are left out; a NULL key is a group of its
own; a group without values has no row; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions.sizing import fits

#: Of the sketch, at every size of input.
ACCURACY = 100_000
MAX_GROUPS_BROADCAST = 1_000_000


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def exact_quantiles(df: DataFrame, col: str | Column, probs: Sequence[float],
                    keys: Sequence[str] = (), names: Sequence[str] | None = None,
                    max_groups: int | None = None) -> DataFrame:
    """keys + one column per probability (default names q0, q1, ...).
    ``max_groups``: the number of groups where the caller knows a bound."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    if not keys:  # one global group, carried as a constant key
        out = exact_quantiles(df.withColumn("_all", F.lit(0)), x, probs, ["_all"], names, 1)
        return out.drop("_all")
    g = [f"_g{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(a) for k, a in zip(keys, g)], x.alias("_x"))
    base = base.where(F.col("_x").isNotNull() & ~F.isnan("_x"))

    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-3 / ACCURACY, 3 / ACCURACY)})
    cuts = base.groupBy(*g).agg(F.percentile_approx("_x", F.array(*[F.lit(p) for p in near]), F.lit(ACCURACY)).alias("_cuts"))
    c = [f"_c{a}" for a in g]
    small = (max_groups is not None and max_groups <= MAX_GROUPS_BROADCAST) or fits(
        base.select(*g).distinct(), MAX_GROUPS_BROADCAST)

    def side(t: DataFrame) -> DataFrame:
        """A table with a bounded number of rows for each group."""
        return F.broadcast(t) if small else t

    ranged = base.join(side(cuts.withColumnsRenamed(dict(zip(g, c)))), _same(g, c)).select(
        *g, "_x", F.size(F.filter("_cuts", lambda v: v < F.col("_x"))).alias("_range"))

    per_group = Window.partitionBy(*g)
    sizes = ranged.groupBy(*g, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(per_group.orderBy("_range")),
                               "_total": F.sum("_n").over(per_group)})
    # 1-based ranks of the order statistics below and above each quantile
    pos = [(F.col("_total") - 1) * F.lit(p) for p in probs]
    lower = [(F.floor(p) + 1).cast("long") for p in pos]
    upper = [(F.ceil(p) + 1).cast("long") for p in pos]
    wanted = F.exists(F.array(*lower, *upper), lambda r: (r > F.col("_upto") - F.col("_n")) & (r <= F.col("_upto")))
    need = sizes.where(wanted).select(*[F.col(a).alias(b) for a, b in zip(g, c)], F.col("_range").alias("_r"),
                                      (F.col("_upto") - F.col("_n")).alias("_before"), "_total")

    values = (ranged.join(side(need), _same([*g, "_range"], [*c, "_r"]))
              .groupBy(*g, "_range", "_before", "_total", "_x").agg(F.count(F.lit(1)).alias("_n")))
    along = Window.partitionBy(*g, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(along))

    def at(rank: Column) -> Column:
        here = (rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto"))
        return F.max(F.when(here, F.col("_x")))

    found = values.groupBy(*g, "_total").agg(
        *[at(r).alias(f"_lo{i}") for i, r in enumerate(lower)], *[at(r).alias(f"_hi{i}") for i, r in enumerate(upper)])
    out = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p))).alias(name)
           for i, (p, name) in enumerate(zip(pos, names))]
    return found.select(*[F.col(a).alias(k) for k, a in zip(keys, g)], *out)


def multi_quantiles(df: DataFrame, cols: Sequence[str | Column], probs: Sequence[float],
                    keys: Sequence[str] = (), var_names: Sequence[str] | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of several columns at once: the columns are stacked
    into (variable, value) rows on the map side and counted together, so
    the cost is that of one column's passes for all of them.
    Returns keys + ``variable`` + one column per probability; a variable
    without any value has a row with NULL quantiles."""
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    var_names = list(var_names or [c if isinstance(c, str) else f"v{i}" for i, c in enumerate(cols)])
    exprs = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols]
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), e.alias("_v")) for v, e in zip(var_names, exprs)]))
        .alias("_s")).select(*keys, "_s.variable", "_s._v")
    by = [*keys, "variable"]
    q = exact_quantiles(stacked, "_v", probs, by, names, None if keys else len(var_names))
    mark = [f"_k{i}" for i in range(len(by))]
    q = q.withColumnsRenamed(dict(zip(by, mark)))
    present = stacked.select(*by).distinct()
    return present.join(q, _same(by, mark), "left").select(*by, *names)


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with ``{col}__q{i}`` for every column and probability."""
    q = multi_quantiles(df, cols, probs)
    return q.agg(*[F.max(F.when(F.col("variable") == c, F.col(f"q{i}"))).alias(f"{c}__q{i}")
                   for c in cols for i in range(len(probs))])
