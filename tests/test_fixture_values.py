"""Values FIXTURES.md records as confirmed in both engines at sf0.01."""

import pytest
from pyspark.sql import functions as F

from tipscope.catalog.base import all_features, analysis, selected, trips, zones
from tipscope.operators import joins
from tipscope.operators import regression as reg

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def feats(spark):
    return all_features(spark, SF)


def test_counts(spark, feats):
    assert trips(spark, SF).count() == 60_000
    assert selected(spark, SF).count() == 5_964
    assert feats.where("trip_minutes <= 0").count() == 173
    assert feats.where("passenger_count IS NULL").count() == 8_598
    assert abs(feats.agg(F.avg("trip_minutes")).first()[0] - 25.136833) < 1e-6
    pairs = joins.left_zone_both(trips(spark, SF), zones(spark, SF)) \
        .select("PUBorough", "DOBorough").distinct().count()
    assert pairs == 36


def test_correlation_and_line(spark, feats):
    r = feats.agg(F.corr("tip_amount", "fare_amount"),
                  F.regr_slope("tip_amount", "fare_amount"),
                  F.regr_intercept("tip_amount", "fare_amount")).first()
    assert abs(r[0] - 0.649064) < 1e-6
    assert abs(r[1] - 0.150575) < 1e-6 and abs(r[2] + 0.02627) < 1e-5


def test_final_log_model_coefficients(spark):
    a = analysis(spark, SF).where("tip_amount > 0")
    fare = F.col("fare_amount")
    f = reg.fit(a, F.ln("tip_amount"), [reg.term("fare_amount"), reg.term("fare_sq", fare * fare),
                                        reg.term("extra")])
    assert f.n == 5_651
    got = [f.intercept, *f.beta]
    want = [-0.525462, 0.0700583, -0.000406251, -0.00377348]
    for g, w in zip(got, want):
        assert abs(g - w) <= 1e-6 * max(1.0, abs(w) * 10)
