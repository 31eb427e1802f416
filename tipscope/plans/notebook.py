"""The final notebook end to end, as one batch run.

read -> borough + quality filters -> stratified sample -> features ->
extract (CSV) -> profiles -> grouped statistics -> correlation -> models
-> diagnostics -> outlier rows. Every output is written as a table under
``out_dir`` (the feature table once, then every statistic reads it back),
so each step is a distributed job and nothing passes through the driver
but model summaries (p x p numbers).
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from tipscope.operators import aggregates as agg
from tipscope.operators import binning as bn
from tipscope.operators import correlation as cor
from tipscope.operators import filters as flt
from tipscope.operators import profile as prof
from tipscope.operators import regression as reg
from tipscope.plans import flows
from tipscope.plans.features import extract_columns
from tipscope.sources import files


def run(spark: SparkSession, trips: DataFrame, zones: DataFrame, boroughs: Sequence[str],
        out_dir: str, target_n: int = flows.TARGET_N, sample: bool = True) -> dict[str, str]:
    """Run the notebook; returns {table name: path}. With ``sample=False``
    the statistics use every filtered trip instead of the stratified sample."""
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame, csv: bool = False) -> DataFrame:
        path = os.path.join(out_dir, name)
        if csv:
            files.write_csv(df, path)
            back = files.extract_csv(spark, path, df.schema)
        else:
            df.write.mode("overwrite").parquet(path)
            back = spark.read.parquet(path)
        paths[name] = path
        return back

    if sample:
        base = save("sample", flows.sample(trips, zones, boroughs, target_n))
        save("sample_check", agg.count_by(base, "source_file"))
    else:
        base = flt.trip_quality(flt.borough(trips, zones, boroughs), "final")
    feats = save("features", flows.features(base))
    save("extract", extract_columns(feats), csv=True)

    save("skim", prof.skim(feats))
    save("missing", prof.missing(feats))
    save("tip_summary", agg.tip_summary(feats))
    save("hourly", agg.hourly(feats))
    save("weekday_median", agg.weekday_median(feats))
    save("monthly", agg.monthly(feats))
    save("month_season", agg.month_season(feats))
    save("season", agg.season(feats))
    save("tip_pct_hist", bn.hist_equal(feats, "tip_pct", 100, (0, 150)))
    save("tip_box_weekday", bn.box_stats(feats, "tip_amount", "pickup_weekday_name"))
    save("tip_density_season", bn.kde(feats, "tip_amount", "tourist_season"))
    save("correlation", cor.matrix(feats, cor.COR_VARS))

    clean = save("model_rows", flt.model_clean(feats))
    fits = {n: flows.fit_model(clean, flows.MODELS[n]) for n in flows.MODELS}
    coef = None
    for n, f in fits.items():
        t = reg.coef_table(spark, f, n)
        coef = t if coef is None else coef.unionByName(t)
    save("coefficients", coef)
    save("anova", reg.anova(spark, fits["log_final"], fits["log_interact"]))
    save("model_metrics", flows.compare(clean, list(flows.MODELS)))
    save("outliers", flows.outliers(clean))
    return paths
