"""Stratified sampling quotas, including one stratum holding most rows."""

from pyspark.sql import functions as F

from tipscope.operators import sampling as smp


def test_quota_and_hot_stratum(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string")
    out = smp.stratified(df, "g", 40, ["k"], 123)
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    full = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert counts == {g: min(40, n) for g, n in full.items()}
    again = smp.stratified(df, "g", 40, ["k"], 123)
    assert sorted(r.k for r in out.collect()) == sorted(r.k for r in again.collect())


def test_group_limit_planned_before_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    smp.stratified(df, "g", 5, ["id"]).createOrReplaceTempView("strat_plan")
    plan = spark.sql("EXPLAIN SELECT * FROM strat_plan").first()[0]
    assert "WindowGroupLimit" in plan


def test_per_stratum_quota():
    assert smp.per_stratum(10_000, 12) == 834


def test_exact_quantiles_bracket_matches_map(spark):
    import random
    from tipscope.operators.quantiles import exact_quantiles
    random.seed(3)
    rows = [("hot" if random.random() < 0.6 else random.choice("ab"), random.random() * 50)
            for _ in range(5000)] + [("one", 2.0), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    ref = df.groupBy("g").agg(*[F.percentile("x", F.lit(p)).alias(f"q{i}")
                                for i, p in enumerate(probs)]).collect()
    for r in ref:
        for i in range(len(probs)):
            assert abs(got[r.g][f"q{i}"] - r[f"q{i}"]) < 1e-9


def test_exact_quantiles_of_tied_values_count_instead_of_gathering(spark):
    from tipscope.operators.quantiles import exact_quantiles
    rows = [("t", 1.0)] * 990 + [("t", float(i)) for i in range(10)] + [(None, 5.0), (None, 7.0), ("n", None),
                                                                        ("t", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    q = exact_quantiles(df, "x", [0.001, 0.5, 0.9995], ["g"])
    assert "collect_list" not in q._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: (r.q0, r.q1, r.q2) for r in q.collect()}
    s = sorted(x for g, x in rows if g == "t" and x == x)
    want = []
    for p in (0.001, 0.5, 0.9995):
        h = (len(s) - 1) * p
        lo = s[int(h)]
        want.append(lo + (s[min(int(h) + 1, len(s) - 1)] - lo) * (h - int(h)))
    assert set(got) == {"t", None}
    assert all(abs(a - b) < 1e-9 for a, b in zip(got["t"], want))
    assert abs(got[None][1] - 6.0) < 1e-9
    assert exact_quantiles(df.limit(0), "x", [0.5]).collect() == []


def test_null_groups_and_nan_in_boxes_and_density(spark):
    from tipscope.operators import binning as bn
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 3.0), (None, 5.0), (None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    box = {r.g: (r.n, r.median) for r in bn.box_stats(df, "x", "g").collect()}
    assert box == {"a": (3, 2.0), None: (2, 4.0)}
    assert {r.g for r in bn.kde(df, "x", "g", n_grid=4).select("g").distinct().collect()} == {"a", None}
    assert [(r.xmin, r.xmax) for r in bn.hist_equal(df, "x", 1).collect()] == [(1.0, 5.0)]
