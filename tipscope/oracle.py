"""DuckDB SQL equivalents of the registered queries.

The oracle only sees the base test tables, so the trip/zone views and the
shared derived sets are inlined as CTEs. ``sql(body, *ctes)`` prepends
the named CTEs (and the ones they depend on) to a query body.
"""

from __future__ import annotations

# Fixed values shared with tipscope.sources.fixtures / tipscope.registry
SELECTED_BOROUGHS = ("AFRICA", "AMERICA", "ASIA")

_FEATURES = """
  SELECT *,
         CAST(month(tpep_pickup_datetime) AS INTEGER) AS month,
         CASE WHEN month(tpep_pickup_datetime) IN (7, 10, 11, 12) THEN '1' ELSE '0' END
           AS tourist_season,
         tpep_pickup_datetime AS pickup_time, tpep_dropoff_datetime AS dropoff_time,
         CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(hour(tpep_dropoff_datetime) AS INTEGER) AS dropoff_hour,
         CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
         CAST(tpep_dropoff_datetime AS DATE) AS dropoff_date,
         CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS pickup_weekday_num,
         CAST(dayofweek(tpep_dropoff_datetime) + 1 AS INTEGER) AS dropoff_weekday_num,
         strftime(tpep_pickup_datetime, '%a') AS pickup_weekday_name,
         strftime(tpep_dropoff_datetime, '%a') AS dropoff_weekday_name,
         (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 6.0e7
           AS trip_minutes,
         60 * trip_distance / nullif((epoch_us(tpep_dropoff_datetime)
           - epoch_us(tpep_pickup_datetime)) / 6.0e7, 0) AS trip_speed_mph,
         tip_amount / nullif(fare_amount, 0) * 100.0 AS tip_pct
  FROM {src}"""

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tbase": ((), """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
         l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
         o.o_orderdate, c.c_nationkey, s.s_nationkey,
         CAST((l.l_partkey * 37) % 86400 AS INTEGER) AS secs,
         CAST(l.l_quantity * 60 + (l.l_suppkey % 7) * 15 - 60 AS INTEGER) AS dur
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey"""),
    "tcols": (("tbase",), """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         o_orderdate + to_seconds(secs) AS tpep_pickup_datetime,
         o_orderdate + to_seconds(secs + dur) AS tpep_dropoff_datetime,
         l_extendedprice / 1000 AS fare_amount,
         round(l_extendedprice * l_discount * 3 / 1000, 2) AS tip_amount,
         l_quantity / 5 AS trip_distance,
         l_tax * 100 AS extra,
         CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS payment_type,
         CAST(CASE WHEN l_linenumber <= 4 THEN 1 WHEN l_linenumber = 5 THEN 2
                   WHEN l_linenumber = 6 THEN 0 END AS INTEGER) AS passenger_count,
         CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1.75 ELSE 0.0 END
              AS DOUBLE) AS airport_fee,
         c_nationkey AS PULocationID, s_nationkey AS DOLocationID
  FROM tbase"""),
    "trips": (("tcols",), """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         tpep_pickup_datetime, tpep_dropoff_datetime, fare_amount, tip_amount,
         trip_distance, extra, payment_type, passenger_count, airport_fee,
         fare_amount + extra + tip_amount + airport_fee AS total_amount,
         PULocationID, DOLocationID,
         strftime(tpep_pickup_datetime, '%Y-%m') AS file_month
  FROM tcols"""),
    "zones": ((), """
  SELECT n_nationkey AS LocationID, r_name AS Borough
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey <> 24"""),
    "zsel": (("zones",), """
  SELECT DISTINCT LocationID FROM zones
  WHERE Borough IN ('AFRICA', 'AMERICA', 'ASIA')"""),
    # trips in the selected boroughs passing the final quality rules
    "sel": (("trips", "zsel"), """
  SELECT * FROM trips
  WHERE PULocationID IN (SELECT LocationID FROM zsel)
    AND DOLocationID IN (SELECT LocationID FROM zsel)
    AND payment_type = 1 AND fare_amount > 0
    AND tpep_pickup_datetime <> tpep_dropoff_datetime
    AND passenger_count = 1 AND airport_fee = 0 AND total_amount > 0"""),
    "feat": (("sel",), _FEATURES.format(src="sel")),
    # features over every trip (no filters)
    "tfeat": (("trips",), _FEATURES.format(src="trips")),
    # model-cleaning filter: tip > 0, tip < p99 over the input (T2), distance, minutes
    "mclean": (("feat",), """
  SELECT f.* FROM feat f,
       (SELECT quantile_cont(tip_amount, 0.99) AS q FROM feat) p
  WHERE f.tip_amount > 0 AND f.tip_amount < p.q
    AND f.trip_distance > 0 AND f.trip_minutes > 0"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in _CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *ctes: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named CTEs (dependencies first) and extras."""
    parts = [f"{n} AS ({_CTES[n][1]}\n)" for n in _order(ctes)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    if not parts:
        return body
    recursive = any("(" in k for k in extra or {})
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
