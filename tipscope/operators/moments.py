"""Counts, means and cross-products of many columns in one pass.

A task reads Arrow batches and multiplies each batch's matrix with itself
(X'X), so a row is never unfolded into pairs of columns; it gives one row with
its sums. Those rows are merged in two steps, first by ``FAN`` groups, then in
one task, which reads them one by one: what a task holds depends on the number
of columns alone, for any number of rows. Sums are taken about the batch's own
means and merged by the update rule for means and co-moments, so large values
with a small spread keep their digits.

Missing are NULL and NaN. ``pairwise`` takes for each pair of columns the rows
that have both (presence masks multiplied like values); ``listwise`` takes for
each group of columns the rows that have all of them, for several groups in the
same pass.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.functions.shipping import ship

ship(__name__)

#: Groups of the first merge.
FAN = 64
#: Rows multiplied at a time.
BLOCK = 8192
PAIR_FIELDS = ("var_x string, var_y string, n long, mean_x double, mean_y double, m2_x double, m2_y double, c_xy double")


def blocks(batches):
    """Float matrices of at most ``BLOCK`` rows; NULL becomes NaN."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in part.columns])


def tree_reduce(df: DataFrame, add: Callable, merge: Callable, finish: Callable, schema: str) -> DataFrame:
    """``add`` makes a state from a matrix, ``merge`` one of two, ``finish`` gives
    the record batch of the last one, or of None for no rows."""
    def state(rows):
        total = None
        for s in rows:
            total = s if total is None else merge(total, s)
        return total

    def stored(rows):
        for b in rows:
            for s in b.column("state"):
                yield pickle.loads(s.as_py())

    def out(s):
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(s)], pa.binary())], names=["state"])

    def first(batches):
        yield from out(state(add(x) for x in blocks(batches)))

    def then(batches):
        yield from out(state(stored(batches)))

    def last(batches):
        yield finish(state(stored(batches)))

    per_task = df.mapInArrow(first, "state binary").withColumn("slot", F.monotonically_increasing_id() % FAN)
    merged = per_task.repartition("slot").select("state").mapInArrow(then, "state binary")
    # one row of a size fixed by the number of columns from each of the FAN tasks
    return merged.repartition(1).mapInArrow(last, schema)


# ------------------------------------------------------------------ pairs of columns
def _pairs(x):
    """(n, mean, m2, c): for columns i and j over rows that have both, the count,
    the mean of i, its sum of squares and the co-moment, about the means."""
    seen = ~np.isnan(x)
    mask = seen.astype(np.float64)
    some = seen.any(0)
    center = np.zeros(x.shape[1])
    center[some] = np.nansum(x[:, some], 0) / seen[:, some].sum(0)
    z = np.where(seen, x - center, 0.0)
    n = mask.T @ mask
    s = z.T @ mask
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, s / n, 0.0)
    return [n, center[:, None] + mean, (z * z).T @ mask - s * mean, z.T @ z - s * mean.T]


def _merge_pairs(a, b):
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    gap = np.where(a[0] * b[0] > 0, b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    weight = a[0] * share
    return [n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight]


def pairwise(df: DataFrame, cols: Sequence[str | Column], names: Sequence[str] | None = None) -> DataFrame:
    """One row per ordered pair of columns: n, both means, both sums of squares
    and the co-moment over the rows that have both; means are NULL for n = 0."""
    names = list(names or cols)
    p = len(names)

    def finish(s):
        s = s if s is not None else [np.zeros((p, p))] * 4
        n, mean, m2, c = (np.asarray(a) for a in s)
        none = (n == 0).ravel()
        x, y = np.repeat(np.arange(p), p), np.tile(np.arange(p), p)
        column = [mean.ravel(), mean.T.ravel(), np.maximum(m2, 0).ravel(), np.maximum(m2.T, 0).ravel(), c.ravel()]
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in x], pa.string()), pa.array([names[i] for i in y], pa.string()),
             pa.array(n.ravel().astype(np.int64)), *[pa.array(v, pa.float64(), mask=none) for v in column]],
            names=["var_x", "var_y", "n", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy"])

    values = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return tree_reduce(values, _pairs, _merge_pairs, finish, PAIR_FIELDS)


# ------------------------------------------------------------------ groups of columns
class Indicator(tuple):
    """A term (name, column) that is 1 where the column ``factor`` has ``level`` as
    text, else 0; NULL for a NULL."""

    def __new__(cls, name: str, factor: str, level: str):
        out = super().__new__(cls, (name, (F.col(factor).cast("string") == F.lit(level)).cast("double")))
        out.factor, out.level = factor, level
        return out


@dataclass
class Moments:
    """Of the rows that have all columns of a group."""
    n: int
    mean: np.ndarray
    sxx: np.ndarray  # centred cross-products


def _merge_group(a, b):
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return [n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)]


def listwise(df: DataFrame, columns: dict[str, Column | Indicator], groups: Sequence[Sequence[str]]) -> list[Moments]:
    """Moments of each group of ``columns`` over its complete rows: one pass for
    all groups, one row to the driver. The indicators of a factor leave Spark as one
    column, the number of the row's level, and are unfolded a block at a time."""
    names = list(columns)
    index = [[names.index(c) for c in g] for g in groups]
    plain = [n for n in names if not isinstance(columns[n], Indicator)]
    levels: dict[str, list[str]] = {}
    for c in columns.values():
        if isinstance(c, Indicator) and c.level not in levels.setdefault(c.factor, []):
            levels[c.factor].append(c.level)
    first, width = {}, len(plain)  # of each factor's levels
    for f, own in levels.items():
        first[f] = width
        width += len(own)
    place = [plain.index(n) if n in plain else first[c.factor] + levels[c.factor].index(c.level) for n, c in columns.items()]
    at_most = [len(own) for own in levels.values()]

    def unfolded(x):
        if not at_most:
            return x
        parts = [x[:, :len(plain)]]
        for code, n in zip(x[:, len(plain):].T, at_most):
            part = (code[:, None] == np.arange(1, n + 1)).astype(np.float64)
            part[np.isnan(code)] = np.nan
            parts.append(part)
        return np.concatenate(parts, 1)

    def add(x):
        out, x = [], unfolded(x)
        for at in index:
            z = x[:, [place[i] for i in at]]
            z = z[~np.isnan(z).any(1)]
            mean = z.mean(0) if len(z) else np.zeros(len(at))
            z -= mean
            out.append([len(z), mean, z.T @ z])
        return out

    def merge(a, b):
        return [_merge_group(u, v) for u, v in zip(a, b)]

    def finish(s):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(s)], pa.binary())], names=["state"])

    cells = [columns[n] for n in plain]
    cells += [F.array_position(F.array(*[F.lit(v) for v in own]), F.col(f).cast("string")) for f, own in levels.items()]
    values = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cells)])
    row = tree_reduce(values, add, merge, finish, "state binary").first()
    state = pickle.loads(row.state) if row else None
    if state is None:
        return [Moments(0, np.zeros(len(g)), np.zeros((len(g), len(g)))) for g in groups]
    return [Moments(int(n), mean, sxx) for n, mean, sxx in state]
