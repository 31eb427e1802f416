"""Column expressions for trip features (date parts, durations, ratios).

All are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the reference's feature rules.
# tourist season months (data definition) and the chart variant with August
SEASON_MONTHS = (7, 10, 11, 12)
SEASON_MONTHS_CHART = (7, 8, 10, 11, 12)
MONTH_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAY_ABBR_SUN_FIRST = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
WEEKDAY_ABBR_MON_FIRST = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_ts(x, fmt: str | None = None) -> Column:
    """Text -> timestamp without zone; invalid text gives NULL (ft_parse_ts)."""
    c = _c(x)
    if fmt:
        # parse without a time zone (so no DST shift); NULL when the text does
        # not match the pattern (try_to_timestamp tells which texts parse)
        return F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(),
                      F.to_timestamp_ntz(c, F.lit(fmt)))
    return c.try_cast("timestamp_ntz")


def _day_micros(ts: Column) -> Column:
    """Microseconds since midnight of a zone-less timestamp (no zone rules)."""
    return ((F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
            + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def micros_between(start, end) -> Column:
    """Exact microseconds from start to end of zone-less timestamps, computed
    from calendar days and time of day, so the session time zone (and its
    daylight-saving gaps) never enters."""
    s, e = _c(start), _c(end)
    return (F.datediff(F.to_date(e), F.to_date(s)).cast("long") * 86_400_000_000
            + _day_micros(e) - _day_micros(s))


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 00:00:00 of a zone-less timestamp."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                          _c(ts).cast("timestamp_ntz")) / F.lit(1e6)


def minutes_between(start, end) -> Column:
    """Fractional minutes from start to end; may be zero or negative (ft_minutes)."""
    return micros_between(start, end) / F.lit(6.0e7)


def safe_div(num, den) -> Column:
    """Division giving NULL on a zero divisor instead of raising under ANSI."""
    return F.try_divide(_c(num), _c(den))


def speed_mph(distance, minutes) -> Column:
    """60 * miles / minutes; NULL where minutes == 0 (ft_speed, trap T4)."""
    return safe_div(F.lit(60) * _c(distance), _c(minutes))


def tip_pct(tip="tip_amount", fare="fare_amount", scale: float = 100.0,
            guard: bool = False, cap: bool = False) -> Column:
    """Tip share of the fare, four reference variants (ft_tip_pct).

    scale=100 percent / 1 fraction; guard -> NULL unless fare > 0;
    cap -> NULL outside [0, 1] of the fraction.
    """
    frac = safe_div(tip, fare)
    if guard:
        frac = F.when(_c(fare) > 0, frac)
    if cap:
        frac = F.when((frac >= 0) & (frac <= 1), frac)
    return frac * F.lit(float(scale)) if scale != 1 else frac


def unit_rate(num, den) -> Column:
    """num / den, NULL unless den > 0 (ft_unit_rates)."""
    return F.when(_c(den) > 0, _c(num) / _c(den))


def season_flag(month, months=SEASON_MONTHS) -> Column:
    """'1' when month is in the tourist season else '0' (ft_season)."""
    return F.when(_c(month).isin(list(months)), F.lit("1")).otherwise(F.lit("0"))


def season_label(flag, yes: str = "Yes", no: str = "No") -> Column:
    """'1'/'0' flag -> label (ft_season_label)."""
    return F.when(_c(flag) == "1", F.lit(yes)).when(_c(flag) == "0", F.lit(no))


def month_name(month) -> Column:
    """1..12 -> Jan..Dec (ft_month_name)."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), _c(month).cast("int"))


def weekday_num(ts) -> Column:
    """Weekday number with Sunday = 1 (ft_weekday_num)."""
    return F.dayofweek(_c(ts))


def weekday_name(ts) -> Column:
    """Abbreviated English weekday name (ft_weekday_name), from the weekday
    number so that no zone conversion is involved."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_ABBR_SUN_FIRST]), F.dayofweek(_c(ts)))


def year_month(ts) -> Column:
    """'yyyy-MM' of a zone-less timestamp."""
    return F.format_string("%04d-%02d", F.year(_c(ts)), F.month(_c(ts)))


def level_rank(x, levels) -> Column:
    """1-based position of x in an explicit level order, NULL if absent (ft_level_order)."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), _c(x)).cast("int")


def file_month(path) -> Column:
    """'yyyy-mm' taken from a file name, NULL when absent (ft_file_month, T14)."""
    return F.nullif(F.regexp_extract(_c(path), r"(\d{4}-\d{2})", 1), F.lit(""))


def is_finite(x) -> Column:
    c = _c(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
