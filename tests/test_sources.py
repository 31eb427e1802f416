"""Readers, sinks, the stored-table cache and the streaming ingest."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from tipscope.sources import files
from tipscope.sources import fixtures as fx
from tipscope.streaming.ingest import run_ingest


def test_text_docs_whole_files(spark):
    d = tempfile.mkdtemp(prefix="docs-", dir="/tmp")
    for name, text in (("a.md", "line one\nline two\n"), ("b.txt", "other")):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    got = {r.source: r.text for r in files.text_docs(spark, d).collect()}
    assert got == {"a.md": "line one\nline two\n", "b.txt": "other"}


def test_cached_table_reuse_and_rebuild(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="store-", dir="/tmp"), "t")
    first = files.cached_table(spark, path, lambda: spark.range(3))
    assert first.count() == 3
    again = files.cached_table(spark, path, lambda: spark.range(5))
    assert again.count() == 3
    rebuilt = files.cached_table(spark, path, lambda: spark.range(5), force_rebuild=True)
    assert rebuilt.count() == 5


def test_zone_csv_header_renamed(spark):
    path = tempfile.mkdtemp(prefix="zones-", dir="/tmp") + "/z"
    z = fx.zones(spark, SMALL).select(F.col("LocationID").alias("Location ID"), "Borough")
    files.write_csv(z, path)
    back = files.zone_csv(spark, path)
    assert back.columns == ["LocationID", "Borough"]
    assert back.count() == z.count()


def test_streaming_ingest_processes_new_files_once(spark):
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="stream-out-", dir="/tmp") + "/o"
    trips = fx.trips(spark, SMALL)
    zones = fx.zones(spark, SMALL)
    months = sorted(r.file_month for r in trips.select("file_month").distinct().collect())
    first, second = months[: len(months) // 2], months[len(months) // 2:]
    trips.where(F.col("file_month").isin(first)).write.parquet(src + "/part=1")
    name = "ingest-test-" + os.path.basename(src)
    run_ingest(spark, src + "/part=1", zones, ["AFRICA", "AMERICA", "ASIA"], out, name).awaitTermination()
    n1 = spark.read.parquet(out).count()
    trips.where(F.col("file_month").isin(second)).write.mode("append").parquet(src + "/part=1")
    run_ingest(spark, src + "/part=1", zones, ["AFRICA", "AMERICA", "ASIA"], out, name).awaitTermination()
    n2 = spark.read.parquet(out).count()
    from tipscope.operators import filters as flt
    expect = flt.trip_quality(flt.borough(trips, zones, ["AFRICA", "AMERICA", "ASIA"])).count()
    assert 0 < n1 < n2 == expect


def test_notebook_run_writes_every_table(spark):
    from tipscope.plans import notebook
    out = tempfile.mkdtemp(prefix="notebook-", dir="/tmp")
    paths = notebook.run(spark, fx.trips(spark, SMALL), fx.zones(spark, SMALL),
                         ["AFRICA", "AMERICA", "ASIA"], out, target_n=400)
    for name, p in paths.items():
        assert os.path.isdir(p), name
    assert spark.read.parquet(paths["coefficients"]).count() == 4 + 6 + 6 + 5
    counts = [r.n for r in spark.read.parquet(paths["sample_check"]).collect()]
    assert counts and max(counts) <= 400


def test_dashboard_load_recodes_once(spark):
    from tipscope.catalog.base import analysis
    from tipscope.plans import dashboard as dash
    from tipscope.plans.features import extract_columns
    ex = extract_columns(analysis(spark, SMALL))
    path = tempfile.mkdtemp(prefix="extract-", dir="/tmp") + "/x"
    files.write_csv(ex, path)
    df = dash.load(spark, path, ex.schema, tempfile.mkdtemp(prefix="dash-", dir="/tmp") + "/r")
    assert df.count() == ex.count()
    assert set(r.month for r in df.select("month").distinct().collect()) <= set(dash.MONTH_LEVELS)
    page = dash.table_page(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], None, 1, 5)
    assert page.count() == min(5, ex.count())


def test_selected_trips_are_filtered_before_they_are_joined(spark, monkeypatch):
    from tipscope.catalog import base
    from tipscope.operators import filters as flt
    from tipscope.sources import fixtures

    want = flt.trip_quality(flt.borough(fixtures.trips(spark, SMALL), base.zones(spark, SMALL), base.SELECTED), "final")
    monkeypatch.setattr(files, "_MATERIALIZED", {})
    got = base.selected(spark, SMALL)
    assert not files._MATERIALIZED  # the whole trip table is not stored for them
    assert got.schema == want.schema and got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {k: min(len(x) - len(x.lstrip(" :+-")) for x in plan if k in x) for k in ("Join Inner", "Filter")}
    scan = next(i for i, x in enumerate(plan) if "l_linenumber" in x and "Relation" in x)
    assert "Filter" in plan[scan - 1] + plan[scan - 2] and depth["Join Inner"] < depth["Filter"]
