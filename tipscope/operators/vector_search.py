"""Exact cosine top-k that skips what cannot win (vec_topk, vec_topk_batch).

The stored vectors are cut once into coarse partitions around centroids and
written as blocks of rows of one partition, each block with the widest angle of
its rows to the centroid. By the triangle inequality of angles no row of a
partition is nearer to a query than the query's angle to the centroid less that
radius. A search first scores the partitions that promise most until each query
has k rows; the k-th score is a floor. Then only partitions, and within them
only blocks, whose bound reaches the floor are scored. The floor only decides
what is skipped: results equal those of a full scan, ties included.

Pairs of partition and query come from the centroids; blocks and queries meet by
an equi-join on the partition, packed, so a pair of packs is one matrix product.

Stored vectors reach their blocks without their zeros. Matrices of blocks and packs, and the vector of each pair of partition and query,
are compressed where they leave a Python worker, and Arrow batches are read and
written in pieces: neither a worker nor the JVM holds the pairs of a batch of
queries, or the blocks of a file, at full width.

Defined cases: a NULL vector counts as zeros; a vector of zeros, stored or asked,
has the score ``zero`` with all others (a query of zeros visits every
partition). Shorter vectors are padded with zeros, stored ones to
the longest query too. Scores are rounded to
``score_places`` before they are ranked; ties go to the lower id. Fewer than k
stored rows give as many hits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.functions.shipping import ship
from tipscope.functions.sizing import broadcast_if_small, fits
from tipscope.sources import files

ship(__name__)

#: Rows of a block of vectors, queries of a pack.
BLOCK_ROWS = 512
#: Partitions: twice the root of the rows, at most so many; each is fitted on SAMPLE vectors.
MAX_PARTITIONS, SAMPLE, FIT_ROUNDS = 4096, 8, 3
#: Rows of an Arrow batch that a worker handles at once; pairs of part and query bounded at once, or sent at once.
PIECE_ROWS, PIECE_CELLS, PIECE_PAIRS = 1024, 1 << 18, 1024
#: Pairs up to this many (counted) are broadcast to the blocks.
BROADCAST_PAIRS = 2048
#: Slack of angles, for the rounding of cosines near 1.
SLACK = 1e-6
ZERO_PART = -1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, or more if one is longer; NULL and
    missing ends are zeros."""
    column = column.cast(pa.list_(pa.float64()))
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    width = max(width, n.max(initial=0))
    out = np.zeros((len(column), width))
    out[np.arange(width) < n[:, None]] = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
    return out


def _dropped(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A row's numbers without its zeros, and a bit for each place that has one."""
    held = x.view(np.int64) != 0
    bits = np.packbits(held, axis=1)

    def binary(ends, data):
        return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])
    return binary(np.arange(1, len(x) + 1) * bits.shape[1], bits), binary(held.sum(1).cumsum() * 8, x[held])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and how many each has."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8), np.diff(ends)


def _restored(bits: pa.Array, numbers: pa.Array, width: int) -> np.ndarray:
    flat, n = _bytes(bits)
    held = np.zeros((len(n), -(-width // 8)), np.uint8)
    held[np.arange(held.shape[1]) < n[:, None]] = flat
    x = np.zeros((len(n), width))
    x[np.unpackbits(held, axis=1, count=width).astype(bool)] = np.frombuffer(_bytes(numbers)[0].tobytes())
    return x


def _pieces(batches, rows: int = PIECE_ROWS):
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _packed(x: np.ndarray) -> bytes:
    """Rows by column, as the numbers of a column are alike, compressed."""
    return pa.compress(np.ascontiguousarray(x.T), codec="zstd", asbytes=True)


def _unpacked(blob: pa.Scalar, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob.as_buffer(), rows * width * 8, codec="zstd")).reshape(width, rows).T


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid of the largest cosine for each unit row, and that cosine."""
    part, cos = np.zeros(len(x), np.int32), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ centroids.T
        part[at:at + 1024] = s.argmax(1)
        cos[at:at + 1024] = s.max(1)
    return part, cos


def fit_centroids(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows (spherical k-means from evenly spaced rows)."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        part, _ = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, part, x)
        c = np.where((total * total).sum(1, keepdims=True) > 0, _unit(total), c)
    return c


def _fitted(k: int, most: int):
    """The centroids of a sample of at most ``most`` rows, fitted on its unit rows,
    and their width; none for no rows."""
    def run(batches):
        x, n = np.zeros((most, 1)), 0
        for b in _pieces(batches):
            u = _unit(_matrix(b.column(0), x.shape[1]))
            if u.shape[1] > x.shape[1]:
                wider = np.zeros((most, u.shape[1]))
                wider[:n, :x.shape[1]] = x[:n]
                x = wider
            u = u[(u * u).sum(1) > 0]
            x[n:n + len(u)] = u
            n += len(u)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([fit_centroids(x[:n], k).tobytes()], pa.binary())],
                                             names=["width", "centroids"])
    return run


@dataclass
class VectorIndex:
    blocks: DataFrame          # part, ids, mat (compressed), angle
    centroids: np.ndarray      # unit rows; the part is the row number
    counts: dict[int, int]     # rows of each part
    angles: dict[int, float]   # widest angle of each part
    id_type: T.DataType
    width: int

    @property
    def rows(self) -> int:
        return sum(self.counts.values())


def build_index(store: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding",
                partitions: int | None = None) -> VectorIndex:
    """Partition the vectors and write them as blocks. Centroids are fitted on a
    sample of at most ``SAMPLE`` rows for each; every row is indexed."""
    v = store.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    n = v.count()  # of rows alone: vectors that are made by a plan are not made for it
    k = partitions or max(1, min(MAX_PARTITIONS, math.ceil(2 * math.sqrt(n))))
    # a share of the ids by hash: about SAMPLE * k rows, cut at that number
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, 1.2 * SAMPLE * k / max(n, 1))))
    # the sample is fitted in a task; the driver gets the centroids alone
    fitted = (v.where(share).select("v").limit(SAMPLE * k).coalesce(1)
              .mapInArrow(_fitted(k, SAMPLE * k), "width int, centroids binary").first())
    near = np.frombuffer(fitted.centroids).reshape(-1, fitted.width) if fitted else np.zeros((1, 1))
    rows = BLOCK_ROWS

    def assign(batches):
        for b in _pieces(batches):
            v = _matrix(b.column(1), near.shape[1])
            x = _unit(v)
            part, cos = _nearest(x[:, :near.shape[1]], near)
            part[(x * x).sum(1) == 0] = ZERO_PART
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *_dropped(v), pa.array(part, pa.int32()), pa.array(np.arccos(np.clip(cos, -1, 1))),
                 pa.array(np.full(len(v), v.shape[1], np.int32))], names=["id", "bits", "numbers", "part", "angle", "size"])

    kind = v.schema["id"].dataType
    assigned = files.stored(v.mapInArrow(assign, T.StructType([
        T.StructField("id", kind), T.StructField("bits", T.BinaryType()), T.StructField("numbers", T.BinaryType()),
        T.StructField("part", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("size", T.IntegerType())])), "vectors")
    width = max(near.shape[1], assigned.agg(F.max("size")).first()[0] or 0)
    centroids = np.pad(near, ((0, 0), (0, width - near.shape[1])))

    def pack(batches):
        for b in batches:  # sorted by part
            part = b.column(3).to_numpy()
            edges = np.flatnonzero(np.diff(part)) + 1
            for at, stop in zip([0, *edges], [*edges, len(part)]):
                for a in range(at, stop, rows) if stop > at else ():
                    s = b.slice(a, min(rows, stop - a))
                    order = pc.sort_indices(s.column(0))
                    x = _restored(s.column(1).take(order), s.column(2).take(order), width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part[a])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), s.column(0).take(order)),
                         pa.array([_packed(x)], pa.binary()), pa.array([float(s.column(4).to_numpy().max())])],
                        names=["part", "ids", "mat", "angle"])

    # cut by part and id, so a part with most of the rows is spread over tasks
    cut = assigned.drop("size").repartitionByRange("part", "id").sortWithinPartitions("part", "id")
    blocks = files.stored(cut.mapInArrow(pack, T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("mat", T.BinaryType()),
        T.StructField("angle", T.DoubleType())])), "vector-blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.size("ids")).alias("n"), F.max("angle").alias("angle")).collect()
    return VectorIndex(blocks, centroids, {r.part: r.n for r in parts}, {r.part: r.angle for r in parts}, kind, width)


def _bounds(index: VectorIndex, zero: float):
    """Function of queries: parts, their counts, and for each query the highest
    score that a part can hold."""
    width = index.width
    parts = np.array(sorted(index.counts), np.int32)
    counts = np.array([index.counts[p] for p in parts.tolist()], np.int64)
    angles = np.array([index.angles[p] for p in parts.tolist()])
    c = np.stack([index.centroids[p] if p >= 0 else np.zeros(index.width) for p in parts.tolist()]) if len(parts) else np.zeros((0, index.width))

    def of(q: np.ndarray) -> np.ndarray:
        q = _unit(q)
        gap = np.arccos(np.clip(q[:, :width] @ c.T, -1, 1)) - angles - SLACK
        best = np.cos(np.clip(gap, 0, np.pi))
        best[:, parts == ZERO_PART] = zero
        best[(q * q).sum(1) == 0] = zero
        return best
    return parts, counts, of


def _asked(index: VectorIndex, queries: DataFrame, k: int, zero: float, seeds: bool) -> DataFrame:
    """(part, q_id, q_vec, q_width, floor): the pairs to score, with the vector's
    numbers compressed. ``seeds``: the parts of the highest bounds that hold k rows;
    else all others whose bound reaches the query's floor."""
    parts, counts, bounds = _bounds(index, zero)
    width = index.width

    at_once = max(1, PIECE_CELLS // max(1, len(parts)))

    def run(batches):
        for b in _pieces(batches, at_once) if len(parts) else ():
            x = _matrix(b.column(1), width)
            best = bounds(x)
            order = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(counts[order], axis=1) - counts[order]
            first = np.zeros(best.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            floor = b.column(2).to_numpy(zero_copy_only=False)
            q, p = np.nonzero(first if seeds else ~first & (best >= floor[:, None] - SLACK))
            vec = pa.array([_packed(row[None]) for row in x], pa.binary())
            for at in range(0, len(q), PIECE_PAIRS):
                some = pa.array(q[at:at + PIECE_PAIRS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[p[at:at + PIECE_PAIRS]]), b.column(0).take(some), vec.take(some),
                     pa.array(np.full(len(some), x.shape[1], np.int32)), b.column(2).take(some)],
                    names=["part", "q_id", "q_vec", "q_width", "floor"])

    return queries.mapInArrow(run, T.StructType([
        T.StructField("part", T.IntegerType()), queries.schema["q_id"], T.StructField("q_vec", T.BinaryType()),
        T.StructField("q_width", T.IntegerType()), queries.schema["floor"]]))


def _scored(index: VectorIndex, pairs: DataFrame, k: int, zero: float, places: int | None) -> DataFrame:
    """(id, q_id, score): the best k rows per query of each pair of packs."""
    width, rows, centroids = index.width, BLOCK_ROWS, index.centroids
    q_type = pairs.schema["q_id"].dataType

    def pack(batches):
        for b in batches:  # sorted by part
            part = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(part)) + 1
            for at, stop in zip([0, *edges], [*edges, len(part)]):
                for a in range(at, stop, rows) if stop > at else ():
                    s = b.slice(a, min(rows, stop - a))
                    wide = s.column(3).to_numpy()
                    q = np.zeros((s.num_rows, wide.max()))
                    for i, w in enumerate(wide.tolist()):
                        q[i, :w] = _unpacked(s.column(2)[i], 1, w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part[a])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, s.num_rows], pa.int32()), s.column(1)),
                         pa.array([_packed(q)], pa.binary()), pa.array([q.shape[1]], pa.int32()),
                         pa.array([s.column(4).to_numpy(zero_copy_only=False).tobytes()], pa.binary())],
                        names=["q_part", "q_ids", "q_mat", "q_width", "floors"])

    def score(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, sid, qid = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(5)[i].values
                x = _unpacked(b.column(2)[i], len(sid), width)
                q = _unpacked(b.column(6)[i], len(qid), b.column(7)[i].as_py())
                floor = np.frombuffer(b.column(8)[i].as_py())
                if part != ZERO_PART:  # the block's own bound
                    u = _unit(q)
                    gap = np.arccos(np.clip(u[:, :width] @ centroids[part], -1, 1)) - b.column(3)[i].as_py() - SLACK
                    high = np.where((u * u).sum(1) > 0, np.cos(np.clip(gap, 0, np.pi)), zero)
                    keep = np.flatnonzero(high >= floor - SLACK)
                    q, qid = q[keep], qid.take(pa.array(keep))
                if not len(q):
                    continue
                length = np.outer(np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1)))
                s = np.full(length.shape, zero)
                np.divide(x @ q[:, :width].T, length, out=s, where=length > 0)
                if places is not None:  # halves away from zero
                    unit = float(10 ** places)
                    s = np.copysign(np.floor(np.abs(s * unit) + 0.5) / unit, s)
                rank = np.where(np.isnan(s), -np.inf, s)
                n = min(k, len(x))
                top = np.empty((n, len(q)), np.int64)
                for j in range(len(q)):  # ids ascend: ties go to the lower one
                    r = rank[:, j]
                    cut = np.partition(r, len(r) - n)[len(r) - n]
                    sure = np.flatnonzero(r > cut)
                    top[:, j] = np.concatenate((sure, np.flatnonzero(r == cut)[:n - len(sure)]))
                column = np.broadcast_to(np.arange(len(q)), top.shape)
                yield pa.RecordBatch.from_arrays(
                    [sid.take(pa.array(top.ravel())), qid.take(pa.array(column.ravel())),
                     pa.array(s[top, column].ravel(), pa.float64(), from_pandas=True)], names=["id", "q_id", "score"])

    packs = pairs.repartitionByRange("part", "q_id").sortWithinPartitions("part").mapInArrow(pack, T.StructType([
        T.StructField("q_part", T.IntegerType()), T.StructField("q_ids", T.ArrayType(q_type)), T.StructField("q_mat", T.BinaryType()),
        T.StructField("q_width", T.IntegerType()), T.StructField("floors", T.BinaryType())]))
    # by their number: a stored table of pairs is far smaller than its packs, so the size of its files says little
    packs = F.broadcast(packs) if fits(pairs, BROADCAST_PAIRS) else packs.hint("merge")
    met = index.blocks.join(packs, F.col("part") == F.col("q_part"))
    return met.mapInArrow(score, T.StructType([T.StructField("id", index.id_type), T.StructField("q_id", q_type),
                                               T.StructField("score", T.DoubleType())]))


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc_nulls_last(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 3, q_id: str = "query_id", q_vec: str = "query_vec",
           zero: float | None = 0.0, score_places: int | None = 9) -> tuple[DataFrame, DataFrame]:
    """(hits, pairs): (id, q_id, score, rank) of the best k rows per query, written,
    and (q_id, part) of what was scored."""
    zero = math.nan if zero is None else zero
    low = -math.inf if math.isnan(zero) else zero
    asked = queries.select(F.col(f"`{q_id}`").alias("q_id"), F.col(f"`{q_vec}`").cast("array<double>").alias("q_vec"))
    seeds = _asked(index, asked.withColumn("floor", F.lit(-math.inf)), k, low, True)
    first = files.stored(_best(_scored(index, seeds, k, zero, score_places), k), "first-hits")
    # the k-th score; a query with fewer hits has no floor
    floors = first.groupBy(F.col("q_id").alias("f_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"),
                                                            F.count("score").alias("scored"))
    floors = floors.select("f_id", F.when((F.col("n") >= k) & (F.col("scored") >= k), F.col("low")).alias("low"))
    rest = asked.join(broadcast_if_small(floors), F.col("q_id").eqNullSafe(F.col("f_id")), "left").select(
        "q_id", "q_vec", F.coalesce("low", F.lit(-math.inf)).alias("floor"))
    more = files.stored(_asked(index, rest, k, low, False), "asked")
    hits = first.drop("rank").unionByName(_scored(index, more, k, zero, score_places))
    return files.stored(_best(hits, k), "hits"), seeds.select("q_id", "part").unionByName(more.select("q_id", "part"))


def share_scored(index: VectorIndex, queries: DataFrame, pairs: DataFrame) -> float:
    """Stored rows in the parts that were visited, as a share of all pairs."""
    spark = pairs.sparkSession
    n = spark.createDataFrame(list(index.counts.items()), "p int, n long")
    seen = pairs.join(F.broadcast(n), F.col("part") == F.col("p")).agg(F.sum("n")).first()[0] or 0
    return seen / max(1, index.rows * queries.count())
