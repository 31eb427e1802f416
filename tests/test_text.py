"""Chunking, chunk ids and retrieval on hand-made documents."""

from pyspark.sql import functions as F

from tipscope.functions import text as tx
from tipscope.operators import retrieval as rt
from tipscope.operators import vector_search as vs
from tipscope.operators import ranges as rg


def _expected_chunks(t, size=700, step=580):
    if len(t) <= size:
        return [t]
    return [t[s:s + size] for s in range(0, len(t), step)]


def test_chunk_boundaries(spark):
    texts = ["a" * 700, "b" * 701, "x" * 580 + "y" * 581, "short", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", tx.chunks("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _expected_chunks(t)


def test_chunk_ids_are_a_global_sequence(spark):
    docs = spark.createDataFrame(
        [(i, f"s{i % 3}", "word " * (i * 97 % 700)) for i in range(200)],
        "doc_id long, source string, text string")
    st = rt.chunk_store(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in st] == list(range(1, len(st) + 1))
    keys = [(r.doc_id, r.chunk_id) for r in st]
    assert keys == sorted(keys)


def test_prefix_offsets_brute_force(spark):
    rows = [(i, (i * 7919) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r._offset for r in rg.prefix_offsets(df, "k", "v", range_rows=70).collect()}
    run = 0
    for k, v in rows:
        assert got[k] == run
        run += v


def test_topk_batch_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    store = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    qs = [(100 + j, rng.normal(size=5).tolist()) for j in range(4)]
    s = spark.createDataFrame(store, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id long, query_vec array<double>")
    got = rt.topk_batch(s, q, 3).collect()
    for qid, qv in qs:
        sc = sorted(((-round(float(np.dot(qv, e) / np.linalg.norm(qv) / np.linalg.norm(e)), 9), i)
                     for i, e in store))[:3]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == qid),
                                           key=lambda r: r["rank"])] == [i for _, i in sc]


def test_join_paragraphs_order_and_filter(spark):
    rows = [(1, 2, "paragraph", "b"), (1, 1, "paragraph", "a"), (1, 3, "table", "x"), (2, 1, "paragraph", "c")]
    df = spark.createDataFrame(rows, "doc long, pos long, kind string, text string")
    got = {r.doc: r.text for r in rt.join_paragraphs(df, "doc", "pos", "text", "kind", ["paragraph"]).collect()}
    assert got == {1: "a\nb", 2: "c"}


def test_truncate_and_letters(spark):
    df = spark.createDataFrame([("x" * 300,), ("abcA",)], "t string")
    r = df.select(tx.truncate("t").alias("p"), tx.letter_vector("t").alias("v")).collect()
    assert len(r[0].p) == 250 and r[0].p.endswith("...")
    assert r[1].v[0] == 2.0 and r[1].v[1] == 1.0 and sum(r[1].v) == 4.0
    assert df.select(F.length(tx.truncate("t"))).collect()[1][0] == 4


def test_topk_batch_takes_any_number_of_queries(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(vs, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    store = rng.integers(-2, 3, (40, 3)).astype(float)  # many ties
    qs = rng.integers(-2, 3, (900, 3)).astype(float)
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(store)] + [(40, None)],
                              "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(qs)], "query_id string, query_vec array<double>")
    got = {}
    for r in rt.topk_batch(s, q, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    store = np.vstack([store, np.zeros(3)])
    norm = np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(store, axis=1)
    sc = np.round(np.where(norm > 0, qs @ store.T / np.where(norm > 0, norm, 1), 0), 9)
    for i in range(len(qs)):
        want = sorted(range(41), key=lambda j: (-sc[i, j], j))[:4]
        assert [got[f"q{i}"][n] for n in (1, 2, 3, 4)] == want


def test_chunk_store_keeps_documents_without_text(spark):
    docs = spark.createDataFrame([(1, "s", None), (2, "s", "a b")], "doc_id long, source string, text string")
    assert [(r.chunk_id, r.doc_id, r.chunk) for r in rt.chunk_store(docs).orderBy("chunk_id").collect()] == [(1, 1, ""), (2, 2, "a b")]


def test_string_ids_and_equal_ids_get_chunk_ids(spark):
    docs = spark.createDataFrame([("b", "s", "x " * 800), (None, "s", "n"), ("a", "s", None), ("b", "s", "x " * 800), ("a", "t", "q")],
                                 "doc_id string, source string, text string")
    got = [(r.chunk_id, r.doc_id, r.source, len(r.chunk)) for r in rt.chunk_store(docs).orderBy("chunk_id").collect()]
    assert [g[0] for g in got] == list(range(1, 10)) and [g[1] for g in got] == [None, "a", "a", *["b"] * 6]
    assert [g[3] for g in got[3:]] == [700, 700, 439] * 2
    assert sorted((r.chunk_id, r.doc_id) for r in rt.chunk_ids(docs).collect() if r.doc_id) == [g[:2] for g in got[1:]]
