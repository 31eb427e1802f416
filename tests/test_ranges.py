"""Places, running sums and pages over ranges, on any keys."""

import random

from pyspark.sql import functions as F

from tipscope.operators import diagnostics as dia
from tipscope.operators import ranges as rg
from tipscope.operators import sampling as smp


def test_places_and_sums_of_string_keys(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("abc") for _ in range(3)), r.randrange(9)) for _ in range(700)] + [(None, 4), (None, 2)]
    d = rg.directory(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v", range_rows=60)
    assert d.ranges.count() > 5 and d.count() == 702
    order = sorted(d.positions().collect(), key=lambda x: x._pos)
    assert [x._pos for x in order] == list(range(702))
    assert [x.k for x in order] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or ""))
    got = sorted((x.k or "", x._offset, x.v) for x in d.running("v").collect())
    total = 0
    for k, off, v in sorted(got, key=lambda x: (x[1], x[0])):
        assert off <= total or v == 0 or off == total
        total = max(total, off + v)
    assert total == sum(v for _, v in rows) and d.rows.count() == 702


def test_running_sums_add_up_in_key_order(spark):
    rows = [(i % 50, i % 50 // 10, 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    got = rg.prefix_offsets(df, ["b", "a"], "v", range_rows=37).collect()
    spans = sorted((x._offset, x._offset + x.v, x.b, x.a) for x in got)
    assert spans[0][0] == 0 and all(p[1] == n[0] for p, n in zip(spans, spans[1:]))
    assert [s[2:] for s in spans] == sorted(s[2:] for s in spans)


def test_a_constant_key_is_spread_over_ranges(spark):
    df = spark.range(1000).select(F.lit(1.75).alias("k"), F.lit(1).alias("v"))
    d = rg.directory(df, ["k"], "v", range_rows=100)
    sizes = [r["_rows"] for r in d.ranges.collect()]
    assert len(sizes) >= 8 and max(sizes) <= 250
    assert sorted(r._offset for r in d.running("v").collect()) == list(range(1000))
    infl = spark.range(1000).select(F.lit(0.5).alias("std_resid"))
    assert sorted(r.i for r in dia.qq(infl).collect()) == list(range(1, 1001))


def test_a_deep_page_reads_only_its_ranges(spark):
    rows = [(None if i % 100 == 0 else i // 3, i) for i in range(5000)]  # ties and NULLs
    df = spark.createDataFrame(rows, "k long, id long").repartition(4)
    d = rg.directory(df, ["k"], range_rows=250)
    page = d.slice(3000, 25)
    assert d.ranges.count() > 10
    assert "PartitionFilters: [_range" in page._jdf.queryExecution().toString().replace("isnotnull(_range", "_range")
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    got = [r.k for r in page.collect()]
    assert got == [x[0] for x in want[3000:3025]]
    assert sorted(r.id for r in d.slice(0, 5000).collect()) == list(range(5000))
    assert d.slice(4990, 25).count() == 10 and d.slice(6000, 25).count() == 0 and d.slice(4000, None).count() == 1000


def test_pages_follow_each_other(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(30)], "k long, id long")
    d = rg.directory(df, ["k"], range_rows=7)
    pages = [[r.id for r in d.slice(at, 8).collect()] for at in range(0, 32, 8)]
    assert sorted(sum(pages, [])) == list(range(30)) and [len(p) for p in pages] == [8, 8, 8, 6]
    assert [r.id for r in smp.page(df, 2, 10, ["id"]).collect()] == list(range(10, 20))
    assert smp.page(df, 1, None, ["id"]).count() == 30
    assert smp.page(df.where("id < 0"), 1, 10, ["id"]).count() == 0


def test_an_empty_table_has_no_places(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert rg.directory(df, ["k"], "v").positions().count() == 0
    assert rg.prefix_offsets(df, "k", "v").count() == 0
