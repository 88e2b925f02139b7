"""DATE, DATETIME, TIME and TIMESTAMP functions.

Differences count boundaries for calendar parts, as the dialect does, and are
truncated for parts below a day.  Weeks start on Sunday unless a day is named.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: days of the week in the dialect's order.
WEEKDAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
#: Fixed value: microseconds in each part below a day, and the day.
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def _weekday(part: str) -> int:
    found = re.fullmatch(r"WEEK\((\w+)\)", part)
    return WEEKDAYS.index(found[1]) if found else (1 if part == "ISOWEEK" else 0)


# ---- parts


def extract(part: str, x: Column) -> Column:
    """EXTRACT(part FROM x) as INT64."""
    day = x.cast("date")
    if part == "DAYOFWEEK":
        value = F.dayofweek(day)
    elif part == "DAYOFYEAR":
        value = F.dayofyear(day)
    elif part == "ISOWEEK":
        value = F.weekofyear(day)
    elif part == "ISOYEAR":
        value = F.extract(F.lit("YEAROFWEEK"), day)
    elif part == "WEEK" or part.startswith("WEEK("):
        k = _weekday(part)
        value = F.floor((F.dayofyear(day) + 6 - (F.dayofweek(day) - 1 - k + 7) % 7) / 7)
    elif part == "MICROSECOND":
        value = F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(1_000_000))
    elif part == "MILLISECOND":
        value = F.floor(F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(1_000_000)) / 1000)
    elif part == "SECOND":
        value = F.second(x)
    else:
        value = F.extract(F.lit(part), x)
    return value.cast("long")


def at_zone(ts: Column, zone: str) -> Column:
    """The civil time of a TIMESTAMP in a zone (session zone UTC)."""
    return F.from_utc_timestamp(ts, zone)


# ---- dates


def date_add(day: Column, n, part: str = "DAY") -> Column:
    """Months, quarters and years clamp to the last day of the month."""
    n = n if isinstance(n, Column) else F.lit(n)
    if part in MONTHS:
        return F.add_months(day, (n * MONTHS[part]).cast("int"))
    return F.date_add(day, (n * (7 if part == "WEEK" else 1)).cast("int"))


def date_sub(day: Column, n, part: str = "DAY") -> Column:
    return date_add(day, -(n if isinstance(n, Column) else F.lit(n)), part)


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def date_diff(a: Column, b: Column, part: str = "DAY") -> Column:
    """Boundaries of the part between b and a."""
    if part == "DAY":
        value = F.datediff(a, b)
    elif part == "MONTH":
        value = _months(a) - _months(b)
    elif part == "QUARTER":
        value = (F.year(a) * 4 + F.quarter(a)) - (F.year(b) * 4 + F.quarter(b))
    elif part == "YEAR":
        value = F.year(a) - F.year(b)
    elif part == "ISOYEAR":
        value = F.extract(F.lit("YEAROFWEEK"), a) - F.extract(F.lit("YEAROFWEEK"), b)
    else:
        # 1970-01-01 was a Thursday, four days after a Sunday
        week = lambda d: F.floor((F.unix_date(d) + 4 - _weekday(part)) / 7)
        value = week(a) - week(b)
    return value.cast("long")


def date_trunc(day: Column, part: str) -> Column:
    if part == "DAY":
        return day
    if part in MONTHS:
        return F.trunc(day, part)
    if part == "ISOYEAR":
        return F.trunc(F.make_date(F.extract(F.lit("YEAROFWEEK"), day), F.lit(1), F.lit(4)), "WEEK")
    return F.date_sub(day, (F.dayofweek(day) - 1 - _weekday(part) + 7) % 7)


def last_day(day: Column, part: str = "MONTH") -> Column:
    if part == "MONTH":
        return F.last_day(day)
    if part in MONTHS:
        return F.date_sub(F.add_months(F.trunc(day, part), MONTHS[part]), 1)
    if part == "ISOYEAR":
        return F.date_sub(date_trunc(F.date_add(date_trunc(day, "ISOYEAR"), 380), "ISOYEAR"), 1)
    return F.date_add(date_trunc(day, part), 6)


# ---- datetimes and timestamps


def add_micros(x: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(x.cast("timestamp")) + micros)


def timestamp_add(ts: Column, n: int, part: str) -> Column:
    return add_micros(ts, F.lit(n * MICROS[part]))


def timestamp_sub(ts: Column, n: int, part: str) -> Column:
    return timestamp_add(ts, -n, part)


def datetime_add(x: Column, n: int, part: str) -> Column:
    """Sub-day parts add time; calendar parts move the date and keep the time of day."""
    if part in MICROS:
        return add_micros(x, F.lit(n * MICROS[part])).cast("timestamp_ntz")
    day = x.cast("date")
    moved = date_add(day, n, part)
    return add_micros(x, F.datediff(moved, day).cast("long") * MICROS["DAY"]).cast("timestamp_ntz")


def datetime_sub(x: Column, n: int, part: str) -> Column:
    return datetime_add(x, -n, part)


def timestamp_diff(a: Column, b: Column, part: str) -> Column:
    """Truncated toward zero below a day, and for whole days of time between timestamps."""
    gap = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return ((gap - gap % MICROS[part]) / MICROS[part]).cast("long")


def datetime_diff(a: Column, b: Column, part: str) -> Column:
    if part in MICROS and part != "DAY":
        return timestamp_diff(a, b, part)
    return date_diff(a.cast("date"), b.cast("date"), part)


def timestamp_trunc(ts: Column, part: str, zone: str = "UTC") -> Column:
    local = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
    if part in ("WEEK", "ISOWEEK", "ISOYEAR") or part.startswith("WEEK("):
        cut = date_trunc(local.cast("date"), part).cast("timestamp")
    else:
        cut = F.date_trunc(part, local)
    return cut if zone == "UTC" else F.to_utc_timestamp(cut, zone)


def datetime_trunc(x: Column, part: str) -> Column:
    return timestamp_trunc(x.cast("timestamp"), part).cast("timestamp_ntz")


def string(ts: Column) -> Column:
    """STRING(timestamp): text with the zone +00, fractions only where there are any."""
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00"))


# ---- time of day, as microseconds since midnight, wrapping at 24 hours


def micros_of_day(x: Column) -> Column:
    """TIME(datetime) as microseconds."""
    return F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(MICROS["DAY"]))


def time_text(micros: Column) -> Column:
    """HH:MM:SS[.ffffff] of microseconds since midnight."""
    text = F.date_format(F.timestamp_micros(micros), "HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def time_add(micros: Column, n: int, part: str) -> Column:
    return F.pmod(micros + n * MICROS[part], F.lit(MICROS["DAY"]))


def time_sub(micros: Column, n: int, part: str) -> Column:
    return time_add(micros, -n, part)


def time_diff(a: Column, b: Column, part: str) -> Column:
    gap = a - b
    return ((gap - gap % MICROS[part]) / MICROS[part]).cast("long")


def time_trunc(micros: Column, part: str) -> Column:
    return micros - micros % MICROS[part]


# ---- formatting and parsing

#: Fixed value: format elements that are a Spark pattern.
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "B": "MMMM", "b": "MMM", "h": "MMM", "d": "dd", "A": "EEEE", "a": "EEE", "j": "DDD", "H": "HH", "I": "hh", "M": "mm",
    "S": "ss", "p": "a", "E4Y": "yyyy", "E*S": "ss.SSSSSS",
}
#: Fixed value: format elements that stand for several others.
COMPOSITES = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "x": "%m/%d/%y", "X": "%H:%M:%S", "c": "%a %b %e %H:%M:%S %Y"}
_ELEMENT = re.compile(r"%(E4Y|E\*S|E[1-6]S|Ez|.)")


def format_datetime(pattern: str, x: Column) -> Column:
    """FORMAT_DATE / FORMAT_DATETIME / FORMAT_TIMESTAMP (in UTC) with a constant pattern."""
    # "%%" is matched first, so its second half opens nothing
    pattern = re.sub(r"%%|%([FTRDxXc])", lambda found: COMPOSITES[found[1]] if found[1] else found[0], pattern)
    ts, parts, at = x.cast("timestamp"), [], 0
    for found in _ELEMENT.finditer(pattern):
        parts.append(F.lit(pattern[at : found.start()]))
        at, element = found.end(), found[1]
        if element in PATTERNS:
            parts.append(F.date_format(ts, PATTERNS[element]))
        elif re.fullmatch("E[1-6]S", element):
            parts.append(F.date_format(ts, "ss." + "S" * int(element[1])))
        else:
            parts.append(_computed(element, ts))
    parts.append(F.lit(pattern[at:]))
    return F.concat(*parts)


def _computed(element: str, ts: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = ts.cast("date")
    options = {
        "e": lambda: F.lpad(F.dayofmonth(day).cast("string"), 2, " "),
        "u": lambda: ((F.dayofweek(day) + 5) % 7 + 1).cast("string"),
        "w": lambda: (F.dayofweek(day) - 1).cast("string"),
        "U": lambda: two(extract("WEEK", day)),
        "W": lambda: two(extract("WEEK(MONDAY)", day)),
        "V": lambda: two(extract("ISOWEEK", day)),
        "G": lambda: extract("ISOYEAR", day).cast("string"),
        "g": lambda: two(extract("ISOYEAR", day) % 100),
        "C": lambda: two(F.floor(F.year(day) / 100)),
        "J": lambda: extract("ISOYEAR", day).cast("string"),
        "Q": lambda: F.quarter(day).cast("string"),
        "k": lambda: F.lpad(F.hour(ts).cast("string"), 2, " "),
        "l": lambda: F.lpad(((F.hour(ts) + 11) % 12 + 1).cast("string"), 2, " "),
        "P": lambda: F.lower(F.date_format(ts, "a")),
        "s": lambda: F.unix_seconds(ts).cast("string"),
        "Z": lambda: F.lit("UTC"),
        "z": lambda: F.lit("+0000"),
        "Ez": lambda: F.lit("+00:00"),
        "n": lambda: F.lit("\n"),
        "t": lambda: F.lit("\t"),
        "%": lambda: F.lit("%"),
    }
    if element not in options:
        raise ValueError(f"unknown format element %{element}")
    return options[element]()


def parse_timestamp(pattern: str, text: Column, safe: bool = False) -> Column:
    """PARSE_* with a constant pattern, as TIMESTAMP; unreadable text raises, or is NULL when ``safe``."""
    wanted = pattern.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%R", "%H:%M").replace("%D", "%m/%d/%y").replace("%E*S", "%S.%f").replace("%E4Y", "%Y").replace("%e", "%d")

    @F.pandas_udf(T.TimestampNTZType())
    def parse(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            try:
                if wanted == "%s":
                    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(value))
                return dt.datetime.strptime(value.strip(), wanted)
            except ValueError:
                if safe:
                    return None
                raise

        return pd.Series([one(v) for v in values], dtype="object")

    return parse(text)


def parse_date(pattern: str, text: Column, safe: bool = False) -> Column:
    return parse_timestamp(pattern, text, safe).cast("date")


def parse_datetime(pattern: str, text: Column, safe: bool = False) -> Column:
    return parse_timestamp(pattern, text, safe)


def parse_time(pattern: str, text: Column, safe: bool = False) -> Column:
    """Microseconds of the day."""
    return micros_of_day(parse_timestamp(pattern, text, safe))


# ---- intervals: struct(months, days, micros)


def make_interval(years=0, months=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    as_long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    micros = as_long(hours) * MICROS["HOUR"] + as_long(minutes) * MICROS["MINUTE"] + as_long(seconds) * MICROS["SECOND"]
    return F.struct((as_long(years) * 12 + as_long(months)).alias("months"), as_long(days).alias("days"), micros.alias("micros"))


def _interval(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.alias("months"), days.alias("days"), micros.alias("micros"))


def _carry(value: Column, size: int) -> tuple[Column, Column]:
    rest = value % size
    return ((value - rest) / size).cast("long"), rest


def justify_hours(interval: Column) -> Column:
    """24 hours become a day."""
    days, rest = _carry(interval["micros"], MICROS["DAY"])
    return _interval(interval["months"], interval["days"] + days, rest)


def justify_days(interval: Column) -> Column:
    """30 days become a month."""
    months, rest = _carry(interval["days"], 30)
    return _interval(interval["months"] + months, rest, interval["micros"])


def justify_interval(interval: Column) -> Column:
    return justify_days(justify_hours(interval))


def interval_extract(part: str, interval: Column) -> Column:
    """EXTRACT from an interval, toward zero: months give YEAR and MONTH, the time HOUR to MICROSECOND."""
    if part in ("YEAR", "MONTH"):
        years, months = _carry(interval["months"], 12)
        return years if part == "YEAR" else months
    if part == "DAY":
        return interval["days"]
    within = {"HOUR": None, "MINUTE": "HOUR", "SECOND": "MINUTE", "MILLISECOND": "SECOND", "MICROSECOND": "SECOND"}
    micros = interval["micros"] if within[part] is None else interval["micros"] % MICROS[within[part]]
    return _carry(micros, MICROS[part])[0]


def interval_negate(interval: Column) -> Column:
    return _interval(-interval["months"], -interval["days"], -interval["micros"])


def date_minus(a: Column, b: Column) -> Column:
    """DATE - DATE: an interval of days."""
    return make_interval(days=F.datediff(a, b))


def add_interval(x: Column, interval: Column) -> Column:
    """Months first (clamped), then days, then time."""
    day = x.cast("date")
    moved = F.datediff(F.add_months(day, interval["months"].cast("int")), day).cast("long") + interval["days"]
    return add_micros(x, moved * MICROS["DAY"] + interval["micros"])


# ---- constructors and part takers


def datetime_of(day: Column, micros: Column) -> Column:
    """DATETIME(date, time)."""
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros)


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """TIME(hour, minute, second)."""
    return (hour.cast("long") * 3600 + minute * 60 + second) * 10**6


def time_of(ts: Column) -> Column:
    """TIME(timestamp) and EXTRACT(TIME ...)."""
    return F.pmod(F.unix_micros(ts), F.lit(86_400 * 10**6))


def date_of(ts: Column, zone: str = "UTC") -> Column:
    """DATE(timestamp, zone) and EXTRACT(DATE ... AT TIME ZONE)."""
    return F.from_utc_timestamp(ts, zone).cast("date")


def timestamp_of(local: Column, zone: str = "UTC") -> Column:
    """TIMESTAMP(text or date or datetime, zone)."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def format_time(pattern: str, micros: Column) -> Column:
    return format_datetime(pattern, F.timestamp_micros(micros))


def format_timestamp(pattern: str, ts: Column, zone: str = "UTC") -> Column:
    """FORMAT_TIMESTAMP in a zone; the elements that name the zone are for UTC alone."""
    if zone != "UTC" and re.search("%E?[zZ]", pattern):
        raise ValueError("elements of the zone's name or offset are for UTC alone")
    return format_datetime(pattern, F.from_utc_timestamp(ts, zone))


class Clock:
    """CURRENT_TIMESTAMP and its relatives; ``now`` (in UTC) pins them to a moment."""

    def __init__(self, now: datetime.datetime | None = None):
        self.now = now

    def current_timestamp(self) -> Column:
        return F.current_timestamp() if self.now is None else F.lit(self.now.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")

    def current_datetime(self, zone: str = "UTC") -> Column:
        return F.from_utc_timestamp(self.current_timestamp(), zone)

    def current_date(self, zone: str = "UTC") -> Column:
        return self.current_datetime(zone).cast("date")

    def current_time(self, zone: str = "UTC") -> Column:
        """Microseconds of the day."""
        return time_of(self.current_datetime(zone))
