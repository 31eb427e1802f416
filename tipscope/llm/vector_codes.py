"""Operator 12, vector codes by an integer Walsh-Hadamard transform.

Components become ``floor(256 * x)``; a vector is cut into ``parts`` equal
consecutive parts, and each part is written as the index of the nearest entry
of its position's codebook. The codebook starts as the parts of the ``entries``
smallest ids and is fitted in rounds: assign, then replace each entry by the
componentwise ``floor(sum / count)`` of its parts.

Method: parts and entries are padded with zeros to a power of two and
transformed by the Walsh-Hadamard matrix in integers. It keeps distances up to
the factor of its size, so squared differences of coefficients, summed in order
of sequency (sign changes), grow to the scaled squared distance. After the
first coefficients the entry that leads gets its whole distance; any entry
whose sum is above that can't be the nearest and is dropped, then tested again
after each further coefficient. Sums are integers, so ties are exact and go to
the lower index.

Spark adds the parts of each entry up per task, then by entry; the driver gets
one codebook, ``entries`` times the vector's length, whatever the rows.

Defined cases: rows whose vector is NULL or holds a NULL or non-finite
component are left out. A shorter vector is padded with zeros to the longest
one, and that to a multiple of ``parts``. An id that stands in several rows
starts one entry, with its smallest vector; NULL ids start none unless there is
no other. Fewer ids than ``entries`` make a smaller codebook. Components too
large for 64-bit sums are taken as Python integers; an error beyond a long is
NULL. NULL labels are one label. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import maybe_broadcast, ship, stored

ship(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances are held at a time.
BLOCK = 2048
#: Components from 2**SAFE up may pass 64 bits in a sum of squares, as may parts
#: of more than WIDEST components.
SAFE, WIDEST = 20, 1024
LIMB = 30
LONG = 1 << 63


def sequency(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix in order of their sign changes."""
    h = transform(np.eye(size, dtype=np.int64))
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis, whose size is a power of two."""
    size, half = x.shape[-1], 1
    while half < size:
        y = x.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        half *= 2
    return x


def spectrum(x: np.ndarray) -> np.ndarray:
    """Zero-pad the last axis to a power of two, transform, order by sequency."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    wide = np.zeros((*x.shape[:-1], size), x.dtype)
    wide[..., :x.shape[-1]] = x
    return transform(wide)[..., sequency(size)]


def nearest(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``t`` the index of the nearest row of ``c`` (both spectra)
    and the squared distance, scaled by the size of the transform."""
    size = t.shape[1]
    head = max(1, size // 4)
    partial = np.zeros((len(t), len(c)), t.dtype)
    for s in range(head):
        d = t[:, s, None] - c[None, :, s]
        partial += d * d
    lead = partial.argmin(1)
    d = t - c[lead]
    most = (d * d).sum(1)
    row, entry = np.nonzero(partial <= most[:, None])
    total = partial[row, entry]
    for s in range(head, size):
        d = t[row, s] - c[entry, s]
        total = total + d * d
        near = total <= most[row]
        row, entry, total = row[near], entry[near], total[near]
    start = np.searchsorted(row, np.arange(len(t)))  # the leader stays, so each row has an entry
    least = np.minimum.reduceat(total, start)
    at = np.flatnonzero(total == least[row])
    return entry[at[np.searchsorted(row[at], np.arange(len(t)))]], least


def integers(values: np.ndarray, scale=SCALE) -> np.ndarray:
    """floor(scale * x) of finite floats; ``scale`` is a power of two, so the
    product is exact. Values of 2**SAFE and more give Python integers."""
    x = values.astype(np.float64)
    if not len(x) or np.abs(x).max() < 2.0 ** (SAFE - 1) / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0 ** 53 else math.floor(v * scale) for v in x.tolist()], object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as integer rows of ``width`` components."""
    flat = integers(column.flatten().to_numpy(zero_copy_only=False))
    n = np.asarray(pa.compute.list_value_length(column), np.int64)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


class Codebook:
    """The entries of each part as integers: ``entries[part][index]`` is a tuple."""

    def __init__(self, entries):
        big = any(abs(v) >= 1 << SAFE or len(e) > WIDEST for part in entries for e in part for v in e)
        self.entries = np.array(entries, object if big else np.int64)
        self.spectra = spectrum(self.entries)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part of the rows ``x``."""
        parts, _, width = self.entries.shape
        if object in (x.dtype, self.entries.dtype):
            x = x.astype(object)
        code = np.zeros((len(x), parts), np.int64)
        error = np.zeros((len(x), parts), x.dtype)
        size = self.spectra.shape[2]
        for at in range(0, len(x), BLOCK):
            t = spectrum(x[at:at + BLOCK].reshape(-1, parts, width))
            for p in range(parts):
                code[at:at + BLOCK, p], scaled = nearest(t[:, p], self.spectra[p].astype(t.dtype, copy=False))
                error[at:at + BLOCK, p] = scaled // size
        return code, error


def _sums(book: Codebook, width: int):
    """Per task: for each part, entry and position the parts' count and sum, the
    sum in limbs of LIMB bits, as it may pass a long over all rows."""
    def run(batches):
        parts, k, m = book.entries.shape
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, m), object)
        for b in batches:
            x = matrix(b.column(0), width)
            code, _ = book.codes(x)
            x = x.reshape(-1, parts, m)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                for e in np.unique(code[:, p]):
                    total[p, e] += x[code[:, p] == e, p].sum(0)
        rows = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count))]
        for p, e, j in zip(*np.nonzero(total)):
            v, limb = int(total[p, e, j]), 0
            while v not in (0, -1):
                rows.append((p, e, j, limb, v & ((1 << LIMB) - 1)))
                v, limb = v >> LIMB, limb + 1
            if v:
                rows.append((p, e, j, limb, v))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(map(int, c), pa.int64()) for c in columns],
                                         names=["part", "entry", "position", "limb", "v"])
    return run


def refit(kept: DataFrame, book: Codebook, width: int) -> Codebook:
    """One round: the entries become the floored means of their parts."""
    rows = (kept.select("v").mapInArrow(_sums(book, width), "part long, entry long, position long, limb long, v long")
            .groupBy("part", "entry", "position", "limb").agg(F.sum("v").alias("v")).collect())
    parts, k, m = book.entries.shape
    count, total = np.zeros((parts, k), object), np.zeros((parts, k, m), object)
    for r in rows:
        if r.position < 0:
            count[r.part, r.entry] += r.v
        else:
            total[r.part, r.entry, r.position] += r.v << (LIMB * r.limb)
    new = [[[int(total[p, e, j]) // int(count[p, e]) for j in range(m)] if count[p, e]
            else [int(v) for v in book.entries[p, e]] for e in range(k)] for p in range(parts)]
    return Codebook(new)


def vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """(id, label, v) of the rows whose vector is whole and finite."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                       v.cast("array<double>").alias("v")).where(v.isNotNull() & whole)


def first_codebook(kept: DataFrame, width: int, parts=PARTS, entries=ENTRIES) -> Codebook | None:
    """Parts of the smallest ids. Ids are chosen before vectors are read."""
    ids = [r.id for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return None
    own = [i for i in ids if i is not None]
    at = kept.where(F.col("id").isin(own) if own else F.col("id").isNull())
    first = sorted(at.groupBy("id").agg(F.min("v").alias("v")).collect(), key=lambda r: r.id or 0)
    x = matrix(pa.array([r.v for r in first], pa.list_(pa.float64())), width)
    return Codebook(x.reshape(len(x), parts, -1).swapaxes(0, 1).tolist())


def _encode(book: Codebook, width: int, names):
    def run(batches):
        for b in batches:
            code, error = book.codes(matrix(b.column(2), width))
            total = [int(e) for e in error.sum(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string()),
                 pa.array([e if e < LONG else None for e in total], pa.int64())], names=names)
    return run


def fit(kept: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS) -> tuple[Codebook | None, int]:
    """The codebook and the padded vector length."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = -(-max(1, longest or 0) // parts) * parts
    book = first_codebook(kept, width, parts, entries)
    for _ in range(rounds if book else 0):
        book = refit(kept, book, width)
    return book, width


def encode(kept: DataFrame, book: Codebook, width: int) -> DataFrame:
    """(id, label, code, error) of each vector; at most 256 entries a part."""
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(_encode(book, width, ["id", "label", "code", "error"]),
                           f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def report(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """The query's rows: code and error, the errors of each label added up and
    the hash of the codebooks."""
    kept = vectors(rows, id_col, vector_col, label_col)
    book, width = fit(kept)
    if book is None:
        coded = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = stored(encode(kept, book, width), "vector-codes")
    said = ",".join(str(v) for v in book.entries.ravel()) if book else ""
    by_label = (coded.groupBy(F.col("label").alias("__label"))
                .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")))
    by_label = maybe_broadcast(by_label, 100_000)
    total = F.when(F.col("label_error") <= LONG - 1, F.col("label_error").cast("long"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        F.col("id").alias(id_col), "code", "error", total.alias("label_error"),
        F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))
