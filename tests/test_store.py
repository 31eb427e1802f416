"""Versioned tables, the chunk store and containers of documents."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tipscope.operators import retrieval as rt
from tipscope.plans import store
from tipscope.sources import files
from tipscope.sources.versions import VersionedTable, fingerprint

DOC = "doc_id long, source string, text string"
ROWS = [(i, f"s{i % 3}", f"word{i} " * (i * 40)) for i in range(40)] + [(7, "s1", "again"), (7, "s1", "again"), (50, None, None)]


def folder():
    return tempfile.mkdtemp(prefix="store-", dir="/tmp")


def written(spark, rows, path):
    spark.createDataFrame(rows, DOC).write.mode("overwrite").parquet(path)
    return spark.read.schema(DOC).parquet(path)


def plain(df):
    return sorted(((r.chunk_id, r.doc_id, r.source, r.chunk) for r in df.collect()), key=str)


def test_a_store_is_reused_until_its_input_changes(spark):
    at, cut = folder(), []

    def embed(c):
        cut.append(sorted(r.doc_id for r in c.select("doc_id").distinct().collect()))
        return c.withColumn("embedding", F.array(F.length("chunk").cast("double")))

    docs = written(spark, ROWS, at + "/in")
    first = store.chunk_table(docs, at + "/store", embed=embed)
    assert sorted({r.chunk_id for r in first.collect()}) == list(range(1, first.count() + 1))
    assert len({tuple(r)[:2] for r in first.collect()}) == first.count()
    key = [(r.doc_id, r.doc_hash, r.pos) for r in first.orderBy("chunk_id").collect()]
    assert [k[0] for k in key] == sorted((k[0] for k in key), key=lambda i: (i is not None, i or 0))
    assert sorted((r.source or "", r.chunk) for r in first.collect()) == sorted(
        (r.source or "", r.chunk) for r in rt.chunk_store(docs).collect())
    again = store.chunk_table(spark.read.schema(DOC).parquet(at + "/in"), at + "/store", embed=embed)
    assert again.inputFiles() == first.inputFiles() and len(cut) == 1
    changed = written(spark, [r for r in ROWS if r[0] != 3] + [(9, "s0", "another text"), (60, "s9", "new")], at + "/in2")
    second = store.chunk_table(changed, at + "/store", embed=embed)
    assert cut[1] == [9, 60]  # only what is new is cut and embedded
    assert plain(second) == plain(store.build(changed)) and "embedding" in second.columns
    assert first.count() == len(key)  # an earlier reader keeps its version
    store.chunk_table(changed, at + "/store", force_rebuild=True, embed=embed)
    assert len(cut) == 3 and len(cut[2]) > 30


def test_a_half_written_store_is_not_seen(spark):
    at = folder()
    t = VersionedTable(spark, at)
    assert t.read() is None and t.current() is None
    with pytest.raises(Exception):
        t.publish(spark.range(4).select((F.col("id") / 0).alias("x"), F.raise_error(F.lit("lost")).alias("y")))
    assert t.read() is None
    t.publish(spark.range(3).toDF("id"), "a")
    with open(f"{at}/_manifests/00000002.json", "w") as f:
        f.write('{"path": "' + at)  # its writer died
    assert t.read().count() == 3
    t.publish(spark.range(5).toDF("id"), "b")
    assert sorted(os.listdir(f"{at}/_manifests"))[-1].endswith("00000003.json") and t.read().count() == 5


def test_two_sessions_publish_and_read(spark):
    at, other = folder(), spark.newSession()
    a, b = VersionedTable(spark, at), VersionedTable(other, at)
    mine = a.get("x", lambda before: spark.range(3).toDF("id"))
    assert b.get("x", lambda before: other.range(9).toDF("id")).count() == 3
    late = b.manifests
    b.manifests = lambda: []  # it has not seen the first one
    b.publish(other.range(7).toDF("id"), "y")
    b.manifests = late
    assert [n for n, _ in a.manifests()] == [2, 1] and a.read().count() == 7 and mine.count() == 3
    assert json.loads(open(f"{at}/_manifests/00000001.json").read())["fingerprint"] == "x"


def test_fingerprints_follow_files_and_parameters(spark):
    at = folder()
    d = written(spark, ROWS, at + "/in")
    assert fingerprint(d, 1) == fingerprint(d, 1) != fingerprint(d, 2)
    mark = fingerprint(d)
    d = written(spark, ROWS[:5], at + "/in")
    assert fingerprint(spark.read.schema(DOC).parquet(at + "/in")) != mark


def test_containers_keep_texts_whole(spark):
    rows = [("a", "plain"), ("b\x1f", "x\x1ey\x1fz\x1b1\x1b\n\r\nend\x1b"), (None, "n"), ("e", ""), ("n", None), ("long", "é\n" * 200_000), (None, None)]
    df = spark.createDataFrame(rows, "source string, text string").repartition(2)
    at = folder() + "/pack"
    files.write_text_pack(df, at)
    assert len([f for f in os.listdir(at) if f.startswith("part")]) <= 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # files are read in splits
    try:
        got = files.text_pack(spark, at).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_small_files_are_compacted(spark):
    at = folder()
    for i in range(25):
        os.makedirs(at + "/in", exist_ok=True)
        with open(f"{at}/in/d{i}.txt", "w") as f:
            f.write(f"line {i}\nmore\n")
    got = files.compact_text_docs(spark, at + "/in", at + "/pack", files_per_part=10)
    assert {(r.source, r.text) for r in got.collect()} == {(f"d{i}.txt", f"line {i}\nmore\n") for i in range(25)}
    assert len([f for f in os.listdir(at + "/pack") if f.startswith("part")]) == 3
