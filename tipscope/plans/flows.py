"""End-to-end flows of the final notebook.

sample:   read -> borough + quality filters -> stratified sample -> tag
features: derived columns
extract:  features -> 20-column extract -> CSV
model:    clean -> fit -> predict -> dollar-scale metrics
outliers: diagnostics of the full log model -> three top-10 lists -> rows
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.operators import diagnostics as dia
from tipscope.operators import filters as flt
from tipscope.operators import regression as reg
from tipscope.operators.sampling import per_stratum, stratified
from tipscope.plans.features import add_features, extract_columns
from tipscope.sources.fixtures import TRIP_KEY
from tipscope.sources.versions import VersionedTable

# The notebook's sampling target and selected columns
TARGET_N = 10_000
SAMPLE_COLUMNS = ("tip_amount", "tpep_pickup_datetime", "tpep_dropoff_datetime", "fare_amount",
                  "trip_distance", "total_amount", "PULocationID", "DOLocationID",
                  "payment_type", "extra", "passenger_count", "airport_fee")


def sample(trips: DataFrame, zones: DataFrame, boroughs: Sequence[str],
           target_n: int = TARGET_N, stratum: str = "file_month",
           n_per: int | None = None, seed: int = 123,
           key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Filter first, then min(rows, ceil(target / files)) rows per file (flow_sample).

    The number of files is the number of distinct strata in the unfiltered
    input (one small aggregate); the quota is then a literal so the row
    limit per stratum is applied before the shuffle.
    """
    if n_per is None:
        n_files = trips.select(stratum).distinct().count()
        n_per = per_stratum(target_n, n_files)
    kept = flt.trip_quality(flt.borough(trips, zones, boroughs), "final")
    s = stratified(kept, stratum, n_per, key, seed)
    return s.select(*key, *SAMPLE_COLUMNS, F.col(stratum).alias("source_file"),
                    F.col(stratum).alias("month"))


def features(df: DataFrame) -> DataFrame:
    """flow_features: the derived columns (month is overwritten by the pickup month, T7)."""
    return add_features(df)


def extract(spark: SparkSession, feats: DataFrame, path: str | None = None) -> DataFrame:
    """flow_extract: 20-column extract published as a new version of the CSV table
    at ``path`` and read back with its schema; readers of earlier versions keep
    theirs."""
    ex = extract_columns(feats)
    if path is None:
        return ex
    return VersionedTable(spark, path, "csv", header="true").publish(ex)


# ---------------------------------------------------------------- models
def log_tip() -> F.Column:
    return F.ln(F.col("tip_amount"))


def terms_raw():
    fare = F.col("fare_amount")
    return [reg.term("fare_amount"), reg.term("fare_sq", fare * fare), reg.term("trip_distance"),
            reg.term("extra"), reg.term("trip_minutes")]


def terms_final():
    fare = F.col("fare_amount")
    return [reg.term("fare_amount"), reg.term("fare_sq", fare * fare), reg.term("extra")]


def terms_interact():
    fare = F.col("fare_amount")
    return [*terms_final(), reg.term("fare_x_extra", fare * F.col("extra"))]


@dataclass
class ModelSpec:
    name: str
    log_response: bool
    terms_fn: Callable[[], list]

    @property
    def terms(self) -> list:
        return self.terms_fn()


MODELS = {
    # tip ~ fare + fare² + distance + extra + minutes
    "raw": ModelSpec("raw", False, terms_raw),
    # log(tip) ~ same terms (the model the influence diagnostics run on)
    "log_full": ModelSpec("log_full", True, terms_raw),
    # log(tip) ~ fare + fare² + extra: the chosen model
    "log_final": ModelSpec("log_final", True, terms_final),
    "log_interact": ModelSpec("log_interact", True, terms_interact),
}


def response(spec: ModelSpec):
    return log_tip() if spec.log_response else F.col("tip_amount")


def fit_model(clean: DataFrame, spec: ModelSpec) -> reg.OlsFit:
    return reg.fit(clean, response(spec), spec.terms)


def fit_models(clean: DataFrame, names: Sequence[str]) -> list[reg.OlsFit]:
    """Fits of several models from one pass over the cleaned rows."""
    return reg.fit_many(clean, [(response(MODELS[n]), MODELS[n].terms) for n in names])


def metrics(clean: DataFrame, names: Sequence[str], fits: Sequence[reg.OlsFit]) -> DataFrame:
    """Dollar-scale errors of several models from one pass: model, rows
    predicted, RMSE, MAE, mean error and the project's pass rule RMSE <= 2 and
    MAE <= 1.5 (mod_rmse_mae, mod_threshold). A row without a prediction doesn't
    count for that model."""
    aggs = []
    for i, (n, f) in enumerate(zip(names, fits)):
        spec = MODELS[n]
        values = dict(spec.terms)
        fitted = f.predict({t: values[t].cast("double") for t in f.terms})
        e = F.col("tip_amount") - (F.exp(fitted) if spec.log_response else fitted)
        e = F.when(~F.isnan(e), e)
        aggs += [F.count(e).alias(f"n{i}"), F.sqrt(F.avg(e * e)).alias(f"rmse{i}"), F.avg(F.abs(e)).alias(f"mae{i}"),
                 F.avg(e).alias(f"bias{i}")]
    cells = [F.struct(F.lit(n).alias("model"), F.col(f"n{i}").alias("n_predicted"), F.col(f"rmse{i}").alias("rmse"),
                      F.col(f"mae{i}").alias("mae"), F.col(f"bias{i}").alias("mean_error")) for i, n in enumerate(names)]
    out = clean.agg(*aggs).select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return out.withColumn("meets_target", (F.col("rmse") <= 2) & (F.col("mae") <= 1.5))


def compare(clean: DataFrame, names: Sequence[str] = ("raw", "log_full", "log_final",
                                                       "log_interact")) -> DataFrame:
    """All models' metrics side by side (mod_compare): one pass fits them all,
    one more gives all their errors."""
    return metrics(clean, names, fit_models(clean, names)).select("model", "rmse", "mae", "meets_target")


def model(feats: DataFrame, names: Sequence[str] = ("raw", "log_full", "log_final")) -> DataFrame:
    """flow_model: the feature table is cleaned, the notebook's models are fitted,
    predictions are taken back to dollars and held against the tips. One row per
    model: rows cleaned, rank, R², residual standard deviation, and the errors."""
    clean = flt.model_clean(feats)
    fits = fit_models(clean, names)
    st = feats.sparkSession.createDataFrame(
        [(n, f.n, f.n_params, f.stats()["r_squared"], f.stats()["sigma"]) for n, f in zip(names, fits)],
        "model string, n_clean long, rank long, r_squared double, sigma double")
    return metrics(clean, names, fits).join(F.broadcast(st), "model")  # one row per model


def outliers(clean: DataFrame, key: Sequence[str] = TRIP_KEY, k: int = 10,
             model: str = "log_full") -> DataFrame:
    """flow_outliers: the cleaned rows among the top-k by Cook's D, |rstudent|
    and leverage of the diagnostics model."""
    spec = MODELS[model]
    f = fit_model(clean, spec)
    infl = dia.influence(clean, response(spec), spec.terms, f, keep=list(key))
    # at most 3 k keys, so the semi join may broadcast them without a count
    idx = F.broadcast(dia.top_influential(infl, list(key), k))
    return clean.join(idx, list(key), "left_semi")
