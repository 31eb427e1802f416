"""Hand-made rows for the semantic traps."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tipscope.functions import features as fx
from tipscope.functions import text as tx
from tipscope.operators import correlation as cor
from tipscope.operators import filters as flt
from tipscope.operators import sampling as smp


def test_null_predicate_drops_rows(spark):  # T1
    df = spark.createDataFrame([(1,), (None,), (2,)], "passenger_count int")
    assert df.where(F.col("passenger_count") == 1).count() == 1


def test_quantile_filter_sees_unfiltered_input(spark):  # T2, T3
    rows = [(0.0, 1.0, 1.0), (1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (3.0, 1.0, 1.0), (10.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "tip_amount double, trip_distance double, trip_minutes double")
    # p99 over all five rows (zero included) = 3 + 0.96 * 7 = 9.72; strict '<'
    out = sorted(r.tip_amount for r in flt.model_clean(df).collect())
    assert out == [1.0, 2.0, 3.0]
    q = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double") \
        .agg(F.percentile("x", F.lit(0.99))).first()[0]
    assert abs(q - 9.79) < 1e-12


def test_zero_minutes_speed_is_null(spark):  # T4
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 30.0)], "d double, m double")
    got = [r[0] for r in df.select(fx.speed_mph("d", "m")).collect()]
    assert got[0] is None and got[1] == 4.0


def test_constant_column_correlation_is_null(spark):  # T5
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    r = {(x.var_x, x.var_y): x.r for x in cor.matrix(df, ["a", "b"], upper=True).collect()}
    assert r[("a", "b")] is None and r[("a", "a")] is None and abs(r[("b", "b")] - 1) < 1e-12


def test_pairwise_complete(spark):  # T5 with nulls
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 5.9, 2.0), (4.0, 8.2, 2.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(x.var_x, x.var_y): x.r for x in cor.matrix(df, ["a", "b", "c"]).collect()}
    ab = df.select(F.corr("a", "b")).first()[0]
    ac = df.where("c IS NOT NULL").select(F.corr("a", "c")).first()[0]
    assert abs(r[("a", "b")] - ab) < 1e-12 and abs(r[("c", "a")] - ac) < 1e-12


def test_tip_pct_variants(spark):  # T10
    df = spark.createDataFrame([(2.0, 10.0), (5.0, 0.0), (15.0, 10.0)], "tip double, fare double")
    got = df.select(fx.tip_pct("tip", "fare").alias("a"),
                    fx.tip_pct("tip", "fare", scale=1, guard=True).alias("b"),
                    fx.tip_pct("tip", "fare", scale=1, guard=True, cap=True).alias("c")).collect()
    assert [r.a for r in got] == [20.0, None, 150.0]
    assert [r.b for r in got] == [0.2, None, 1.5]
    assert [r.c for r in got] == [0.2, None, None]


def test_weekday_sunday_is_one(spark):  # T11
    df = spark.createDataFrame([(dt.datetime(2025, 3, 2, 10),)], "ts timestamp_ntz")
    r = df.select(fx.weekday_num("ts"), fx.weekday_name("ts")).first()
    assert tuple(r) == (1, "Sun")


def test_file_month_miss_is_null(spark):  # T14
    df = spark.createDataFrame([("yellow_2025-07.parquet",), ("lookup.parquet",)], "f string")
    assert [r[0] for r in df.select(fx.file_month("f")).collect()] == ["2025-07", None]


def test_squish_unicode_whitespace(spark):  # T16, T17
    df = spark.createDataFrame([("  a  b \n c 😀 ",)], "t string")
    r = df.select(tx.squish("t").alias("s")).first().s
    assert r == "a b c 😀"
    assert df.select(F.length(tx.squish("t"))).first()[0] == 7


def test_topk_ties_break_on_id(spark):  # T21
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9), (4, 0.1)], "id int, score double")
    assert [r.id for r in smp.topk(df, "score", 3, ["id"]).collect()] == [2, 1, 3]


def test_nan_is_not_finite(spark):  # T6
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, 1.0), (float("inf"), 1.0)],
                               "x double, fare_amount double")
    assert flt.plot_valid(df, ["x"]).count() == 1
    assert not math.isnan(flt.plot_valid(df, ["x"]).agg(F.avg("x")).first()[0])


def test_dashboard_empty_selection(spark):
    df = spark.createDataFrame([("Jan", "Mon")], "month string, pickup_weekday_name string")
    assert flt.dashboard(df, [], ["Mon"]).count() == 0
    assert flt.dashboard(df, ["Jan"], ["Mon"]).count() == 1


def test_month_overwritten_and_season_uses_new_month(spark):  # T7, T8
    from tipscope.plans.features import add_features
    df = spark.createDataFrame(
        [(dt.datetime(2025, 7, 31, 23, 50), dt.datetime(2025, 8, 1, 0, 10), 1.0, 2.0, 10.0, "2025-08")],
        "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
        "tip_amount double, trip_distance double, fare_amount double, month string")
    r = add_features(df).first()
    assert r.month == 7 and r.tourist_season == "1" and abs(r.trip_minutes - 20.0) < 1e-12


def test_two_season_definitions(spark):  # T9
    from tipscope.operators.aggregates import month_season
    df = spark.createDataFrame([(8, 1.0), (9, 2.0)], "month int, tip_amount double")
    got = {r.month: r.tourist_season for r in month_season(df).collect()}
    assert got == {"Aug": "Tourist Season", "Sep": "Non-Tourist Season"}
    flags = [r[0] for r in df.select(fx.season_flag("month")).collect()]
    assert flags == ["0", "0"]


def test_weekday_levels_monday_first(spark):  # T12
    df = spark.createDataFrame([("Mon",), ("Sun",)], "d string")
    got = [r[0] for r in df.select(fx.level_rank("d", fx.WEEKDAY_ABBR_MON_FIRST)).collect()]
    assert got == [1, 7]


def test_rounding_half_up_vs_even(spark):  # T15
    r = spark.range(1).select(F.round(F.lit(0.25), 1), F.bround(F.lit(0.25), 1)).first()
    assert (r[0], r[1]) == (0.3, 0.2)


def test_null_join_key_keeps_row_unmatched(spark):  # T18
    from tipscope.operators import joins
    trips = spark.createDataFrame([(1,), (None,)], "PULocationID int")
    zones = spark.createDataFrame([(1, "A")], "LocationID int, Borough string")
    got = sorted((r.PULocationID or -1, r.Borough or "") for r in joins.left_zone(trips, zones).collect())
    assert got == [(-1, ""), (1, "A")]


def test_final_model_excludes_total(spark):  # T22
    from tipscope.plans import flows
    names = [n for n, _ in flows.MODELS["log_final"].terms]
    assert "total_amount" not in names and names == ["fare_amount", "fare_sq", "extra"]


def test_durations_ignore_session_time_zone(spark):
    """Zone-less timestamps across a daylight-saving gap: minutes, weekday and
    month key must not depend on the session time zone."""
    from tipscope.plans.features import add_features
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame(
            [(dt.datetime(1995, 4, 2, 1, 50), dt.datetime(1995, 4, 2, 2, 20), 1.0, 1.0, 5.0)],
            "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
            "tip_amount double, trip_distance double, fare_amount double")
        r = add_features(df).select("trip_minutes", "pickup_weekday_name",
                                    fx.year_month("tpep_pickup_datetime").alias("ym")).first()
        assert r.trip_minutes == 30.0 and r.pickup_weekday_name == "Sun" and r.ym == "1995-04"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_scalar_join_requires_one_row(spark):
    import pytest
    from tipscope.operators import joins
    df = spark.range(3)
    one = spark.range(1).select(F.lit(5).alias("s"))
    assert joins.scalar(df, one).count() == 3
    with pytest.raises(ValueError):
        joins.scalar(df, spark.range(2).select(F.lit(5).alias("s")))


def test_tip_summary_on_empty_input_keeps_one_row(spark):
    from tipscope.operators import aggregates as agg
    e = spark.createDataFrame([], "tip_amount double, tip_pct double")
    rows = agg.tip_summary(e).collect()
    assert len(rows) == 1 and rows[0].median_tip_pct is None


def test_summary_all_null_column_gives_null_quartiles(spark):
    from tipscope.operators import profile as prof
    d = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, b double")
    got = {(r.variable, r.stat): r.value for r in prof.summary(d).collect()}
    assert got[("a", "median")] == 2.0 and got[("b", "median")] is None and got[("b", "nas")] == 3.0
