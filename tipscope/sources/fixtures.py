"""Trip and zone tables derived from the TPC-H-like test tables.

The library works on a trip table (one row per taxi trip) and a zone
lookup. The test data has neither, so both are derived here from
``lineitem``/``orders``/``customer``/``supplier`` and ``nation``/``region``
with fixed rules (see FIXTURES.md). Everything stays a lazy plan over the
parquet scans, so pruning and pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.functions.features import year_month
from tipscope.functions.sizing import broadcast_if_small

# Fixed values of the fixture rules (must equal the oracle's CTEs).
# zone id left out of the lookup so that unmatched zones occur
MISSING_ZONE_ID = 24
# Suppliers (two numbers each) up to this many are broadcast
MAX_SUPPLIER_BROADCAST = 1_000_000
TRIP_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    """One trip per lineitem, joined to its order, customer and supplier. With
    ``ends`` (a column of zone ids) only trips that start and end in these: zones are
    the nations of customers and suppliers, which are filtered before they are
    joined.

    At scale the joins are plain equi-joins on keys; Catalyst picks
    broadcast only when a side's estimated size is under the broadcast
    threshold, otherwise sort-merge with AQE skew splitting.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    if ends is not None:
        c = c.join(ends, c.c_nationkey == ends[ends.columns[0]], "left_semi")
        s = s.join(ends, s.s_nationkey == ends[ends.columns[0]], "left_semi")

    # orders meet their customers first (the smaller side), so the
    # lineitem-sized rows are shuffled once for the order key, not again for the
    # customer key; suppliers come before, as a filter on them then spares rows that
    # shuffle, and are broadcast where a count finds them few
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "c_nationkey")
    j = (li.join(broadcast_if_small(s, MAX_SUPPLIER_BROADCAST), F.col("l_suppkey") == F.col("s_suppkey"))
           .join(oc, F.col("l_orderkey") == F.col("o_orderkey")))

    secs = ((F.col("l_partkey") * 37) % 86400).cast("int")
    dur = (F.col("l_quantity") * 60 + (F.col("l_suppkey") % 7) * 15 - 60).cast("int")
    fare = F.col("l_extendedprice") / 1000
    tip = F.round(F.col("l_extendedprice") * F.col("l_discount") * 3 / 1000, 2)
    extra = F.col("l_tax") * 100
    airport = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"),
                     F.lit(1.75)).otherwise(F.lit(0.0)).cast("double")
    pickup = F.timestamp_add("SECOND", secs, F.col("o_orderdate"))
    dropoff = F.timestamp_add("SECOND", secs + dur, F.col("o_orderdate"))
    return j.select(
        *TRIP_KEY,
        pickup.alias("tpep_pickup_datetime"),
        dropoff.alias("tpep_dropoff_datetime"),
        fare.alias("fare_amount"),
        tip.alias("tip_amount"),
        (F.col("l_quantity") / 5).alias("trip_distance"),
        extra.alias("extra"),
        F.when(F.col("l_returnflag") == "N", 2).otherwise(1).alias("payment_type"),
        F.when(F.col("l_linenumber") <= 4, 1).when(F.col("l_linenumber") == 5, 2)
         .when(F.col("l_linenumber") == 6, 0).otherwise(F.lit(None).cast("int"))
         .alias("passenger_count"),
        airport.alias("airport_fee"),
        (fare + extra + tip + airport).alias("total_amount"),
        F.col("c_nationkey").alias("PULocationID"),
        F.col("s_nationkey").alias("DOLocationID"),
        year_month(pickup).alias("file_month"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone lookup ``(LocationID, Borough)``; one id is left out on purpose."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .where(F.col("n_nationkey") != MISSING_ZONE_ID)
             .select(F.col("n_nationkey").alias("LocationID"),
                     F.col("r_name").alias("Borough")))
