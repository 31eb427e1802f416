"""Profiles of whole frames against pandas, on every type of column."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tipscope.operators import filters as flt
from tipscope.operators import profile as prof

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(700):
        rows.append((None if i % 9 == 0 else NAN if i % 11 == 0 else float(r.normal()), int(r.integers(0, 5)), 2.5, None,
                     None if i % 7 == 0 else ["", " ", "ab", "é", f"u{i}"][i % 5], i % 3 == 0, [i % 2],
                     dt.datetime(2025, 1, 1) + dt.timedelta(seconds=int(r.integers(0, 10**6))), dt.date(2025, 1, 1 + i % 28)))
    schema = ("x double, k int, same double, none double, s string, b boolean, l array<int>, t timestamp_ntz, d date")
    return spark.createDataFrame(rows, schema).repartition(6), pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def test_skim_of_every_column(mixed):
    df, p = mixed
    index = prof.value_counts(df)
    got = {(r.skim_variable, r.stat): r.value for r in prof.skim(df, index).collect()}
    assert {v for v, _ in got} == set(df.columns)
    x = p.x.astype(float)
    for st, want in (("n_missing", x.isna().sum()), ("complete_rate", x.notna().mean()), ("mean", x.mean()), ("sd", x.std()),
                     ("p0", x.min()), ("p25", x.quantile(.25)), ("p50", x.median()), ("p75", x.quantile(.75)), ("p100", x.max())):
        assert got["x", st] == pytest.approx(want), st
    assert got["none", "n_missing"] == 700 and got["none", "mean"] is None and got["none", "p50"] is None
    assert got["same", "sd"] == 0 and got["same", "p25"] == 2.5 and got["k", "p50"] == p.k.median()
    s = p.s.dropna()
    assert [got["s", k] for k in ("n_missing", "min", "max", "empty", "n_unique", "whitespace")] == [
        p.s.isna().sum(), 0, s.str.len().max(), (s == "").sum(), s.nunique(), (s == " ").sum()]
    e = (p.t - pd.Timestamp("1970-01-01")).dt.total_seconds()
    assert got["t", "median"] == pytest.approx(e.median()) and got["t", "n_unique"] == p.t.nunique()
    assert got["d", "max"] == dt.datetime(2025, 1, 28, tzinfo=dt.timezone.utc).timestamp()
    assert got["b", "n_unique"] == 2 and got["l", "n_missing"] == 0


def test_histograms_have_every_bin_and_no_missing_values(mixed):
    df, p = mixed
    got = {}
    for r in prof.skim_hist(df).collect():
        got.setdefault(r.variable, {})[r.bin] = r.n
    assert set(got) == {"x", "k", "same"} and all(sorted(v) == list(range(8)) for v in got.values())
    want, _ = np.histogram(p.x.dropna().astype(float), bins=8)
    assert [got["x"][i] for i in range(8)] == list(want)
    assert got["same"] == {0: 700, **{i: 0 for i in range(1, 8)}}
    assert [got["k"][i] for i in range(8)].count(0) == 3


def test_summary_and_missing_count_nan(mixed):
    df, p = mixed
    got = {(r.variable, r.stat): r.value for r in prof.summary(df).collect()}
    gone = p.x.isna().sum()
    assert got["x", "nas"] == gone and got["x", "q3"] == pytest.approx(p.x.quantile(.75))
    assert got["s", "length"] == 700 and got["s", "nas"] == p.s.isna().sum() and got["none", "nas"] == 700
    assert {r.variable: r.n_missing for r in prof.missing(df).collect()}["x"] == gone
    r = prof.intro(df).first()
    assert r.columns == 9 and r.all_missing_columns == 1 and r.complete_rows == 0
    assert r.total_missing_values == gone + 700 + p.s.isna().sum()


def test_the_table_is_read_once_for_the_index(spark, mixed):
    df, _ = mixed
    index = prof.value_counts(df)
    assert index.agg({"n": "sum"}).first()[0] == 700 * 9
    assert index.groupBy("variable", "num", "text").count().where("count > 1").count() == 0
    plan = prof.skim(df, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # nothing but the index is read


def test_an_empty_frame_has_no_profile(mixed):
    df, _ = mixed
    none = df.where("k > 99")
    assert prof.skim(none).count() == 0 and prof.skim_hist(none).count() == 0 and prof.summary(none).count() == 0


def test_search_looks_into_each_column(spark):
    df = spark.createDataFrame([(1, "Ab", 2.5), (2, None, 7.0), (12, "b", None)], "i long, s string, x double")
    assert sorted(r.i for r in flt.table_search(df, "B").collect()) == [1, 12]
    assert sorted(r.i for r in flt.table_search(df, "2").collect()) == [1, 2, 12]
    assert flt.table_search(df, "1Ab").count() == 0
