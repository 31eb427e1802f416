"""Registered source, projection, filter, join and feature queries
(SURVEY §2.1, §2.2, §2.3, §2.8)."""

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from tipscope.catalog.base import (FRAME, SELECTED, all_features, analysis, register, selected, table,
                                   trips, zones)
from tipscope.functions import features as fx
from tipscope.functions import text as tx
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators import filters as flt
from tipscope.operators import joins
from tipscope.operators import profile as prof
from tipscope.operators import retrieval as rt
from tipscope.plans import dashboard as dash
from tipscope.plans import flows
from tipscope.plans.features import extract_columns, unit_rates
from tipscope.plans.store import chunk_table
from tipscope.sources import files
from tipscope.sources.fixtures import TRIP_KEY

KEY = ", ".join(TRIP_KEY)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _scratch(spark, sf_dir, name):
    """A folder of this name for these tables, told apart by their whole path."""
    mark = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    return files.scratch_path(spark, f"{name}_{os.path.basename(sf_dir.rstrip('/'))}_{mark}")


# ---------------------------------------------------------------- §2.1 sources and sinks
register(
    "src_parquet_dir",
    lambda s, d: files.parquet_dir(s, d, merge_schema=True).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CAST(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES) + " AS BIGINT) AS n")

register(
    "src_provenance",
    lambda s, d: (files.with_provenance(files.parquet_dir(s, d, merge_schema=True))
                  .groupBy("source_file", "file_month").agg(F.count(F.lit(1)).alias("n"))),
    "\nUNION ALL ".join(f"SELECT '{t}.parquet' AS source_file, CAST(NULL AS VARCHAR) AS file_month,"
                        f" count(*) AS n FROM {t}" for t in TABLES))

register(
    "src_dataset_lazy",
    lambda s, d: (files.parquet_dir(s, d, merge_schema=True)
                  .where(F.col("_metadata.file_name") == "lineitem.parquet")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"))),
    "SELECT count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem", (), ["sum_qty"])

register(
    "src_parquet_pruned",
    lambda s, d: files.parquet_dir(s, f"{d}/lineitem.parquet",
                                   ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]),
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem", (), ["l_quantity"])

register(
    "src_union_files",
    lambda s, d: files.union_files([table(s, d, "customer"), table(s, d, "supplier")]),
    "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier", (),
    ["c_acctbal", "s_acctbal"])


def _csv_lookup(s, d):
    path = _scratch(s, d, "zones_csv")
    z = zones(s, d).select(F.col("LocationID").alias("Location ID"), "Borough")
    files.write_csv(z.coalesce(1), path)
    return files.zone_csv(s, path)


register("src_csv_lookup", _csv_lookup, "SELECT * FROM zones", ["zones"])


def _sink_csv(s, d):
    path = _scratch(s, d, "selected_csv")
    df = selected(s, d)
    files.write_csv(df, path)
    return files.extract_csv(s, path, df.schema)


register("sink_csv", _sink_csv, "SELECT * FROM sel", ["sel"],
         ["fare_amount", "tip_amount", "trip_distance", "extra", "airport_fee", "total_amount"])

FEAT_DOUBLES = ("fare_amount", "tip_amount", "trip_distance", "extra", "airport_fee",
                "total_amount", "trip_minutes", "trip_speed_mph", "tip_pct")
EXTRACT_SQL = """SELECT * EXCLUDE (pickup_time, dropoff_time, pickup_hour, dropoff_hour,
                                   pickup_date, dropoff_date, pickup_weekday_num,
                                   dropoff_weekday_num) FROM feat"""


def _csv_extract(s, d):
    return flows.extract(s, analysis(s, d), _scratch(s, d, "extract_csv"))


register("src_csv_extract", _csv_extract, EXTRACT_SQL, ["feat"], FEAT_DOUBLES)
register("flow_extract", lambda s, d: flows.extract(s, analysis(s, d), _scratch(s, d, "flow_extract_csv")), EXTRACT_SQL, ["feat"],
         FEAT_DOUBLES)


def _bind_docs(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    conv = rt.join_paragraphs(table(s, d, "conversations"), "conv_id", "turn", "text")
    conv = conv.select(F.col("conv_id").alias("doc_id"), F.lit("conversations").alias("source"),
                       "text")
    return files.union_files([docs, conv])


register(
    "src_bind_docs", _bind_docs,
    """SELECT doc_id, source, text FROM documents
       UNION ALL BY NAME
       SELECT conv_id AS doc_id, 'conversations' AS source,
              string_agg(text, chr(10) ORDER BY turn) AS text
       FROM conversations GROUP BY conv_id""")


def _sink_chunk_store(s, d):
    kept = chunk_table(table(s, d, "documents"), _scratch(s, d, "chunk_store"))
    return kept.select("chunk_id", "doc_id", "source", "chunk")


CHUNKS_CTE = {"chunks": """
  SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) AS BIGINT) AS chunk_id,
         doc_id, source, chunk
  FROM (SELECT doc_id, source, t, s,
               CAST(CASE WHEN length(t) <= 700 THEN 0 ELSE (s - 1) // 580 END AS INTEGER) AS pos,
               substring(t, CAST(s AS BIGINT), 700) AS chunk
        FROM (SELECT doc_id, source, t,
                     unnest(CASE WHEN length(t) <= 700 THEN [1]
                                 ELSE range(1, length(t) + 1, 580) END) AS s
              FROM (SELECT doc_id, source,
                           trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
                    FROM documents) q1) q2) q3"""}

register("sink_chunk_store", _sink_chunk_store, "SELECT * FROM chunks", (), (), CHUNKS_CTE)

# ---------------------------------------------------------------- §2.2 projections and filters
register(
    "proj_select",
    lambda s, d: trips(s, d).select(*TRIP_KEY, *flows.SAMPLE_COLUMNS),
    f"SELECT {KEY}, " + ", ".join(flows.SAMPLE_COLUMNS) + " FROM trips", ["trips"],
    ["fare_amount", "tip_amount", "trip_distance", "extra", "airport_fee", "total_amount"])

register("proj_drop", lambda s, d: extract_columns(analysis(s, d)), EXTRACT_SQL, ["feat"],
         FEAT_DOUBLES)

register(
    "proj_rename",
    lambda s, d: joins.left_zone(trips(s, d), zones(s, d)).withColumnRenamed("Borough", "PUBorough")
    .select(*TRIP_KEY, "PULocationID", "PUBorough"),
    f"""SELECT {KEY}, PULocationID, z.Borough AS PUBorough
        FROM trips LEFT JOIN zones z ON PULocationID = z.LocationID""", ["trips", "zones"])

# the numeric columns of the extract (trip key excluded), as the schema walk finds them
NUMERIC_EXTRACT = ("fare_amount", "tip_amount", "trip_distance", "extra", "payment_type",
                   "passenger_count", "airport_fee", "total_amount", "PULocationID",
                   "DOLocationID", "month", "trip_minutes", "trip_speed_mph", "tip_pct")
register(
    "proj_numeric_cols",
    lambda s, d: prof.select_by_type(extract_columns(analysis(s, d)), "numeric",
                                     exclude=TRIP_KEY),
    "SELECT " + ", ".join(NUMERIC_EXTRACT) + " FROM feat", ["feat"], FEAT_DOUBLES)

register("proj_categorical_cols",
         lambda s, d: prof.select_by_type(extract_columns(analysis(s, d)), "string"),
         "SELECT file_month, tourist_season, pickup_weekday_name, dropoff_weekday_name FROM feat", ["feat"])

register(
    "proj_cast_factor",
    lambda s, d: trips(s, d).select(*TRIP_KEY, *[F.col(c).cast("string").alias(c) for c in
                                                 ("payment_type", "passenger_count",
                                                  "PULocationID")]),
    f"""SELECT {KEY}, CAST(payment_type AS VARCHAR) AS payment_type,
               CAST(passenger_count AS VARCHAR) AS passenger_count,
               CAST(PULocationID AS VARCHAR) AS PULocationID FROM trips""", ["trips"])

TRIP_DOUBLES = ("fare_amount", "tip_amount", "trip_distance", "extra", "airport_fee",
                "total_amount")
BOROUGH_SQL = """SELECT * FROM trips
   WHERE PULocationID IN (SELECT LocationID FROM zsel)
     AND DOLocationID IN (SELECT LocationID FROM zsel)"""

register("flt_borough", lambda s, d: flt.borough(trips(s, d), zones(s, d), SELECTED),
         BOROUGH_SQL, ["trips", "zsel"], TRIP_DOUBLES)

register(
    "flt_borough_one", lambda s, d: flt.borough_one(trips(s, d), zones(s, d), "AMERICA"),
    """SELECT * FROM trips
       WHERE PULocationID IN (SELECT LocationID FROM zones WHERE Borough = 'AMERICA')
         AND DOLocationID IN (SELECT LocationID FROM zones WHERE Borough = 'AMERICA')""",
    ["trips", "zones"], TRIP_DOUBLES)

register("flt_trip_quality", selected, "SELECT * FROM sel", ["sel"], TRIP_DOUBLES)

register(
    "flt_trip_quality_draft",
    lambda s, d: flt.trip_quality(flt.borough(trips(s, d), zones(s, d), SELECTED), "draft"),
    BOROUGH_SQL + """
     AND payment_type = 1 AND fare_amount > 0
     AND tpep_pickup_datetime <> tpep_dropoff_datetime
     AND passenger_count = 1 AND airport_fee = 0""", ["trips", "zsel"], TRIP_DOUBLES)

FEAT_COLS_SQL = "SELECT * FROM feat"
register("flt_model_clean", lambda s, d: flt.model_clean(analysis(s, d)),
         "SELECT * FROM mclean", ["mclean"], FEAT_DOUBLES)

BAND = ("fare_amount", "total_amount", "trip_distance", "trip_minutes", "tip_pct")
register(
    "flt_band_trim", lambda s, d: flt.band_trim(analysis(s, d), BAND),
    "SELECT f.* FROM feat f, (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}"
                for c in BAND)
    + " FROM feat) b WHERE " + " AND ".join(f"f.{c} BETWEEN b.lo_{c} AND b.hi_{c}" for c in BAND),
    ["feat"], FEAT_DOUBLES)

register("flt_outlier_or", lambda s, d: flt.outlier_or(analysis(s, d)),
         "SELECT * FROM feat WHERE fare_amount > 65 OR tip_amount > 20", ["feat"], FEAT_DOUBLES)

TFEAT_DOUBLES = ("fare_amount", "tip_amount", "trip_distance", "extra", "airport_fee",
                 "total_amount", "trip_minutes", "trip_speed_mph", "tip_pct")


def _finite(c):
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 'inf'::DOUBLE)"


register(
    "flt_plot_valid",
    lambda s, d: flt.plot_valid(all_features(s, d), ["tip_pct", "trip_speed_mph"]),
    f"SELECT * FROM tfeat WHERE {_finite('tip_pct')} AND {_finite('trip_speed_mph')}"
    " AND fare_amount > 0", ["tfeat"], TFEAT_DOUBLES)

register("flt_null_rows", lambda s, d: flt.null_rows(all_features(s, d), "trip_speed_mph"),
         "SELECT * FROM tfeat WHERE trip_speed_mph IS NULL", ["tfeat"], TFEAT_DOUBLES)

register("flt_inf_rows", lambda s, d: flt.inf_rows(all_features(s, d)),
         "SELECT * FROM tfeat WHERE trip_minutes = 0 AND trip_distance > 0", ["tfeat"],
         TFEAT_DOUBLES)

DASH_MONTHS = ("Jan", "Jul", "Dec")
DASH_DAYS = ("Mon", "Fri", "Sat")


def _recoded(s, d):
    return dash.recode(extract_columns(analysis(s, d)))


RECODE_SQL = """SELECT * REPLACE (
       (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] AS month,
       CASE tourist_season WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' END AS tourist_season,
       CAST(payment_type AS VARCHAR) AS payment_type),
     CAST(month AS INTEGER) AS month_level,
     CAST(list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], pickup_weekday_name)
          AS INTEGER) AS pickup_weekday_level
   FROM (""" + EXTRACT_SQL + ")"

register(
    "flt_dashboard",
    lambda s, d: dash.filtered(_recoded(s, d), dash.FilterState(DASH_MONTHS, DASH_DAYS)),
    "SELECT * FROM recoded WHERE month IN ('Jan', 'Jul', 'Dec')"
    " AND pickup_weekday_name IN ('Mon', 'Fri', 'Sat')",
    ["feat"], FEAT_DOUBLES, {"recoded": RECODE_SQL})

register("flt_pair_not_null",
         lambda s, d: flt.pair_not_null(all_features(s, d), "trip_speed_mph", "tip_amount"),
         "SELECT * FROM tfeat WHERE trip_speed_mph IS NOT NULL AND tip_amount IS NOT NULL",
         ["tfeat"], TFEAT_DOUBLES)

register("flt_log_positive",
         lambda s, d: flt.log_positive(analysis(s, d), "tip_amount", "fare_amount", True, True),
         "SELECT * FROM feat WHERE tip_amount > 0 AND fare_amount > 0", ["feat"], FEAT_DOUBLES)

register(
    "flt_table_search",
    lambda s, d: flt.table_search(analysis(s, d), "1996-0"),
    "SELECT * FROM feat WHERE lower(concat_ws(chr(31), "
    + ", ".join(f"CAST({c} AS VARCHAR)" for c in FRAME) + ")) LIKE '%1996-0%'", ["feat"], FEAT_DOUBLES)

# ---------------------------------------------------------------- §2.3 joins
register(
    "join_left_zone",
    lambda s, d: joins.left_zone(trips(s, d), zones(s, d)).select(*TRIP_KEY, "PULocationID",
                                                                  "Borough"),
    f"""SELECT {KEY}, PULocationID, z.Borough
        FROM trips LEFT JOIN zones z ON PULocationID = z.LocationID""", ["trips", "zones"])

register(
    "join_left_zone_both",
    lambda s, d: (joins.left_zone_both(trips(s, d), zones(s, d))
                  .groupBy("PUBorough", "DOBorough").agg(F.count(F.lit(1)).alias("n"))),
    """SELECT p.Borough AS PUBorough, q.Borough AS DOBorough, count(*) AS n
       FROM trips LEFT JOIN zones p ON PULocationID = p.LocationID
                  LEFT JOIN zones q ON DOLocationID = q.LocationID
       GROUP BY 1, 2""", ["trips", "zones"])

register(
    "join_suffix",
    lambda s, d: joins.left_zone_suffix(trips(s, d), zones(s, d)).select(
        *TRIP_KEY, "`Borough.x`", "`Borough.y`"),
    f"""SELECT {KEY}, p.Borough AS "Borough.x", q.Borough AS "Borough.y"
        FROM trips LEFT JOIN zones p ON PULocationID = p.LocationID
                   LEFT JOIN zones q ON DOLocationID = q.LocationID""", ["trips", "zones"])

register("join_semi_zone", lambda s, d: joins.semi_zone(trips(s, d), zones(s, d), SELECTED),
         BOROUGH_SQL, ["trips", "zsel"], TRIP_DOUBLES)


def _join_scalar(s, d):
    a = analysis(s, d)
    stat = a.agg(F.percentile("tip_amount", F.lit(0.99)).alias("tip_p99"))
    return (joins.scalar(a.select(*TRIP_KEY, "tip_amount"), stat)
            .withColumn("above_p99", F.col("tip_amount") >= F.col("tip_p99")))


register(
    "join_scalar", _join_scalar,
    f"""SELECT {KEY}, tip_amount, p.tip_p99, tip_amount >= p.tip_p99 AS above_p99
        FROM feat, (SELECT quantile_cont(tip_amount, 0.99) AS tip_p99 FROM feat) p""",
    ["feat"], ["tip_amount", "tip_p99"])


def _query_vector_scores(s, d):
    """Cosine of every stored vector with one query vector: the mean of all
    vectors (a one-row aggregate)."""
    e = table(s, d, "embeddings")
    q = rt.centroids(e).select(F.col("centroid").alias("_q"))
    return e.crossJoin(broadcast_if_small(q, 1)).select(
        "vec_id", "label", tx.cosine(F.col("_q"), F.col("embedding")).alias("score"))


GCENT_CTE = {"gcent": """
  SELECT list(v ORDER BY i) AS centroid FROM (
    SELECT i, avg(CAST(v AS DOUBLE)) AS v FROM (
      SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) x
    GROUP BY i) y"""}
QV_SQL = """SELECT e.vec_id, e.label,
              coalesce(list_dot_product(q.centroid, CAST(e.embedding AS DOUBLE[]))
                / nullif(sqrt(list_dot_product(q.centroid, q.centroid))
                         * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]),
                                                 CAST(e.embedding AS DOUBLE[]))), 0), 0.0) AS score
       FROM embeddings e, gcent q"""

register("join_query_vector", _query_vector_scores, QV_SQL, (), ["score"], GCENT_CTE)

# ---------------------------------------------------------------- §2.8 features


def _ft(cols, sql_cols, doubles=(), cte="tfeat", src=all_features):
    def fn(s, d):
        return src(s, d).select(*TRIP_KEY, *(cols() if callable(cols) else cols))
    return fn, f"SELECT {KEY}, {sql_cols} FROM {cte}", [cte], doubles


def _reg_ft(name, cols, sql_cols, doubles=(), cte="tfeat", src=all_features):
    fn, body, ctes, dbl = _ft(cols, sql_cols, doubles, cte, src)
    register(name, fn, body, ctes, dbl)


_reg_ft("ft_parse_ts",
        lambda: [F.col("tpep_pickup_datetime").cast("string").alias("pickup_text"),
         fx.parse_ts(F.col("tpep_pickup_datetime").cast("string")).alias("pickup_parsed"),
         fx.parse_ts(F.format_string("%02d/%02d/%04d %02d:%02d:%02d",
                                     *[f("tpep_pickup_datetime") for f in (
                                         F.dayofmonth, F.month, F.year, F.hour, F.minute,
                                         F.second)]),
                     "dd/MM/yyyy HH:mm:ss").alias("pickup_parsed_fmt")],
        """CAST(tpep_pickup_datetime AS VARCHAR) AS pickup_text,
           TRY_CAST(CAST(tpep_pickup_datetime AS VARCHAR) AS TIMESTAMP) AS pickup_parsed,
           try_strptime(strftime(tpep_pickup_datetime, '%d/%m/%Y %H:%M:%S'),
                        '%d/%m/%Y %H:%M:%S') AS pickup_parsed_fmt""")
_reg_ft("ft_hour", lambda: ["pickup_hour", F.hour("tpep_dropoff_datetime").alias("dropoff_hour")],
        "pickup_hour, CAST(hour(tpep_dropoff_datetime) AS INTEGER) AS dropoff_hour")
_reg_ft("ft_date", lambda: [F.to_date("tpep_pickup_datetime").alias("pickup_date"),
                    F.to_date("tpep_dropoff_datetime").alias("dropoff_date")],
        """CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
           CAST(tpep_dropoff_datetime AS DATE) AS dropoff_date""")
_reg_ft("ft_month", lambda: ["month"], "month")
_reg_ft("ft_file_month",
        lambda: [fx.file_month(F.when(F.col("payment_type") == 1,
                              F.concat(F.lit("trips_"), F.col("file_month"), F.lit(".parquet")))
                       .otherwise(F.lit("trips.parquet"))).alias("month_from_name")],
        r"""nullif(regexp_extract(CASE WHEN payment_type = 1
                                      THEN 'trips_' || file_month || '.parquet'
                                      ELSE 'trips.parquet' END, '(\d{4}-\d{2})', 1), '')
              AS month_from_name""")
_reg_ft("ft_weekday_num", lambda: ["pickup_weekday_num"], "pickup_weekday_num")
_reg_ft("ft_weekday_name", lambda: ["pickup_weekday_name"], "pickup_weekday_name")
_reg_ft("ft_minutes", lambda: ["trip_minutes"], "trip_minutes", ["trip_minutes"])
_reg_ft("ft_speed", lambda: ["trip_speed_mph"], "trip_speed_mph", ["trip_speed_mph"])
_reg_ft("ft_tip_pct",
        lambda: [fx.tip_pct().alias("tip_pct_pct"),
         fx.tip_pct(guard=True).alias("tip_pct_guarded"),
         fx.tip_pct(scale=1, guard=True).alias("tip_frac"),
         fx.tip_pct(scale=1, guard=True, cap=True).alias("tip_frac_capped")],
        """tip_amount / nullif(fare_amount, 0) * 100.0 AS tip_pct_pct,
           CASE WHEN fare_amount > 0 THEN tip_amount / nullif(fare_amount, 0) END * 100.0
             AS tip_pct_guarded,
           CASE WHEN fare_amount > 0 THEN tip_amount / nullif(fare_amount, 0) END AS tip_frac,
           CASE WHEN tip_amount / nullif(fare_amount, 0) BETWEEN 0 AND 1 AND fare_amount > 0
                THEN tip_amount / nullif(fare_amount, 0) END AS tip_frac_capped""",
        ["tip_pct_pct", "tip_pct_guarded", "tip_frac", "tip_frac_capped"])


def _unit_rates(s, d):
    return unit_rates(all_features(s, d)).select(
        *TRIP_KEY, "fare_per_mile", "fare_per_minute", "tip_per_mile", "tip_per_minute")


register(
    "ft_unit_rates", _unit_rates,
    f"""SELECT {KEY},
       CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance END AS fare_per_mile,
       CASE WHEN trip_minutes > 0 THEN fare_amount / trip_minutes END AS fare_per_minute,
       CASE WHEN trip_distance > 0 THEN tip_amount / trip_distance END AS tip_per_mile,
       CASE WHEN trip_minutes > 0 THEN tip_amount / trip_minutes END AS tip_per_minute
       FROM tfeat""", ["tfeat"],
    ["fare_per_mile", "fare_per_minute", "tip_per_mile", "tip_per_minute"])

_reg_ft("ft_season", lambda: ["tourist_season",
                      fx.season_flag("month", fx.SEASON_MONTHS_CHART).alias("season_chart")],
        "tourist_season, CASE WHEN month IN (7, 8, 10, 11, 12) THEN '1' ELSE '0' END"
        " AS season_chart")
_reg_ft("ft_season_label", lambda: [fx.season_label("tourist_season").alias("season_label")],
        "CASE tourist_season WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' END AS season_label")
_reg_ft("ft_month_name", lambda: [fx.month_name("month").alias("month_name")],
        "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month]"
        " AS month_name")
_reg_ft("ft_level_order",
        lambda: [fx.level_rank("pickup_weekday_name", fx.WEEKDAY_ABBR_MON_FIRST).alias("weekday_level")],
        "CAST(list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], pickup_weekday_name)"
        " AS INTEGER) AS weekday_level")
_reg_ft("ft_powers", lambda: [(F.col("fare_amount") * F.col("fare_amount")).alias("fare_sq"),
                      (F.col("fare_amount") * F.col("extra")).alias("fare_x_extra")],
        "fare_amount * fare_amount AS fare_sq, fare_amount * extra AS fare_x_extra",
        ["fare_sq", "fare_x_extra"])
_reg_ft("ft_log", lambda: [F.ln("tip_amount").alias("log_tip")], "ln(tip_amount) AS log_tip",
        ["log_tip"], cte="mclean", src=lambda s, d: flt.model_clean(analysis(s, d)))
_reg_ft("ft_round", lambda: [F.round("tip_amount", 1).alias("tip_1dp"),
                     F.round("tip_pct", 4).alias("tip_pct_4dp")],
        "round(tip_amount, 1) AS tip_1dp, round(tip_pct, 4) AS tip_pct_4dp",
        ["tip_1dp", "tip_pct_4dp"])


# ---------------------------------------------------------------- incremental ingest
def _stream_ingest(s, d):
    from tipscope.sources import fixtures as fx_src
    from tipscope.streaming.ingest import run_ingest
    src = files.materialized_path(s, f"trips:{d}", lambda: fx_src.trips(s, d))
    from tipscope.session import app_id
    run = "".join(ch if ch.isalnum() else "_" for ch in f"{app_id(s)}_{files._RUN_ID}")
    out = _scratch(s, d, "stream_out_" + run)
    q = run_ingest(s, src, zones(s, d), SELECTED, out,
                   name=f"ingest_{run}_{os.path.basename(d.rstrip('/'))}")
    q.awaitTermination()
    return s.read.parquet(out)


register("stream_ingest", _stream_ingest, "SELECT * FROM feat", ["feat"], FEAT_DOUBLES)


def _text_docs(s, d):
    """Documents in container files (written from the table), read back whole
    with their sources."""
    path = _scratch(s, d, "doc_pack") + "-" + uuid.uuid4().hex
    files.write_text_pack(table(s, d, "documents"), path)
    return files.text_pack(s, path)


register("src_text_docs", _text_docs, "SELECT source, text FROM documents")
