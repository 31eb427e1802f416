"""The pruned search against a full scan, and what it skips."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tipscope.operators import vector_search as vs


def frames(spark, x, q):
    s = spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    a = spark.createDataFrame([(j, [float(b) for b in v]) for j, v in enumerate(q)], "query_id long, query_vec array<double>")
    return s.repartition(4), a


def full(x, q, k):
    x = np.array([v if v is not None else np.zeros(len(q[0])) for v in x], float)
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    s = np.round(np.where(n > 0, q @ x.T / np.where(n > 0, n, 1), 0), 9)
    return {(j, r + 1): (i, s[j, i]) for j in range(len(q)) for r, i in enumerate(np.lexsort((np.arange(len(x)), -s[j]))[:k])}


def clustered(r, n, dim, groups=40, spread=0.15):
    c = r.normal(size=(groups, dim))
    return c[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))


@pytest.mark.parametrize("kind,k", [("clustered", 5), ("random", 3), ("ties", 4), ("positive", 70)])
def test_equal_to_a_full_scan(spark, monkeypatch, kind, k):
    monkeypatch.setattr(vs, "BLOCK_ROWS", 16)
    r = np.random.default_rng(3)
    x = {"clustered": clustered(r, 900, 12), "random": r.normal(size=(600, 6)), "ties": r.integers(-1, 2, (500, 3)).astype(float),
         "positive": r.random((300, 26))}[kind]
    q = np.vstack([x[:15] + 0.01 * r.normal(size=x[:15].shape), r.normal(size=(15, x.shape[1])), np.zeros((1, x.shape[1]))])
    x = [*x, None, np.zeros(x.shape[1])]
    s, a = frames(spark, x, q)
    index = vs.build_index(s)
    hits, pairs = vs.search(index, a, k)
    got = {(h.q_id, h["rank"]): (h.id, h.score) for h in hits.collect()}
    want = full(x, q, k)
    assert index.rows == len(x) and set(got) == set(want)
    assert all(got[w][0] == want[w][0] and got[w][1] == pytest.approx(want[w][1], abs=2e-9) for w in want)
    assert pairs.count() == pairs.distinct().count()


def test_the_share_scored_falls_with_size(spark):
    r = np.random.default_rng(4)
    share = []
    for n in (400, 1600, 6400):
        x = clustered(r, n, 16, groups=int(np.sqrt(n)))
        s, a = frames(spark, x, x[:20])
        index = vs.build_index(s)
        _, pairs = vs.search(index, a, 3)
        share.append(vs.share_scored(index, a, pairs))
    assert share[0] > share[1] > share[2] and share[2] < 0.1


def test_no_cartesian_product(spark):
    r = np.random.default_rng(5)
    s, a = frames(spark, r.normal(size=(50, 4)), r.normal(size=(5, 4)))
    index = vs.build_index(s)
    _, pairs = vs.search(index, a, 3)
    plan = vs._scored(index, vs._asked(index, a.selectExpr("query_id AS q_id", "query_vec AS q_vec", "double('-Infinity') AS floor"), 3, 0.0, True),
                      3, 0.0, 9)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "CrossJoin" not in plan and "Join Cross" not in plan


def test_a_partition_of_most_rows_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK_ROWS", 32)
    x = [np.array([1.0, 2.0])] * 400 + [np.array([3.0, -1.0]), np.array([-1.0, 0.5])]
    s, a = frames(spark, x, np.array([[1.0, 2.0], [0.0, -1.0]]))
    index = vs.build_index(s)
    assert index.blocks.count() >= 13
    hits, _ = vs.search(index, a, 3)
    assert {(h.q_id, h["rank"]): h.id for h in hits.collect()} == {(q, n): i for (q, n), (i, _) in full(x, np.array([[1.0, 2.0], [0.0, -1.0]]), 3).items()}


def test_empty_sides(spark):
    s, a = frames(spark, [np.ones(3)] * 2, np.ones((2, 3)))
    assert vs.search(vs.build_index(s.where("chunk_id < 0")), a, 3)[0].count() == 0
    assert vs.search(vs.build_index(s), a.where("query_id < 0"), 3)[0].count() == 0
    assert vs.search(vs.build_index(s), a, 3)[0].count() == 4  # fewer rows than k


def test_the_sample_of_the_index_stays_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*a):
        raise AssertionError("rows were sent to the driver")
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, refused)
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id long, embedding array<double>")
    index = vs.build_index(df, partitions=5)
    assert index.rows == 300 and index.centroids.shape == (5, 6)
    assert np.allclose((index.centroids ** 2).sum(1), 1)
    assert vs.build_index(df.where("chunk_id < 0")).rows == 0


def test_pairs_leave_a_worker_in_pieces(spark):
    r = np.random.default_rng(6)
    s, _ = frames(spark, r.normal(size=(600, 32)), np.ones((1, 32)))
    index = vs.build_index(s, partitions=300)

    class Queries:
        schema = T.StructType.fromDDL("q_id long, q_vec array<double>, floor double")

        def mapInArrow(self, run, schema):
            return run

    q = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([list(v) for v in r.normal(size=(100, 32))], pa.list_(pa.float64())),
                                    pa.array([-np.inf] * 100)], names=["q_id", "q_vec", "floor"])
    sent = list(vs._asked(index, Queries(), 3, 0.0, False)([q])) + list(vs._asked(index, Queries(), 3, 0.0, True)([q]))
    assert sum(b.num_rows for b in sent) == 100 * len(index.counts)
    assert max(b.nbytes for b in sent) < 1 << 19 and len(index.counts) * 100 * 32 * 8 > 1 << 21


def test_blocks_of_sparse_vectors_are_compressed(spark):
    r = np.random.default_rng(7)
    x = np.where(r.random((400, 64)) < 0.2, r.integers(1, 5, (400, 64)) * 0.37, 0)
    s, a = frames(spark, x, x[:4])
    index = vs.build_index(s, partitions=2)
    assert index.blocks.selectExpr("sum(length(mat)) AS n").first().n < x.nbytes / 4
    hits, _ = vs.search(index, a, 3)
    assert {(h.q_id, h["rank"]): h.id for h in hits.collect()} == {(q, n): i for (q, n), (i, _) in full(x, x[:4], 3).items()}


def test_many_pairs_are_not_broadcast(spark, monkeypatch):
    """Whatever the size of the files they are stored in."""
    r = np.random.default_rng(8)
    s, a = frames(spark, r.normal(size=(200, 4)), r.normal(size=(5, 4)))
    index = vs.build_index(s)
    pairs = vs.files.stored(vs._asked(index, a.selectExpr("query_id AS q_id", "query_vec AS q_vec", "double('-Infinity') AS floor"), 3, 0.0, False), "asked")

    def plan():
        return vs._scored(index, pairs, 3, 0.0, 9)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(vs, "BROADCAST_PAIRS", 10)
    assert "SortMergeJoin" in plan() and "BroadcastHashJoin" not in plan()
