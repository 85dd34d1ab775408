"""Times in mixed forms, precisions and zones, brought to one unambiguous form.

A value is rewritten to year|month|day|time by the first layout that matches, its zone read, and where it has none, its local time is joined
as of its moment to the zone's offset intervals. The intervals are kept in local time, exploded by years: two that hold a time mean that it
occurs twice, none that it was skipped, one gives the offset. They are read from the zone database itself, every zone and every change; years after the last
listed change take the intervals of a year of the same type, as the calendar and the rules repeat. All of it runs as built-in expressions; the interval table
is bounded by the public zone database and is the only thing that is always broadcast.
"""

from __future__ import annotations

import struct
import zoneinfo
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small

# English month names by their first three letters, and the offsets in minutes that zone abbreviations stand for.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_MINUTES = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "SST": -660, "CHST": 600}

#: Two-digit years from this one on are 19xx.
PIVOT = 78
#: Local years that share a row of the interval table; more make the table smaller and its rows longer.
BUCKET_YEARS = 16
#: Beyond the listed changes of a zone its rule is probed in steps of so many days; no rule changes twice within them.
PROBE_DAYS = 21

_REST = r"(?:(?:[T,]| ) *(.*))?"
_DAY_NAME = r"(?:[A-Za-z]{3,9},? +)?"
#: Layouts of a day with an optional rest, each with its rewriting to year|month|day|rest.
_LAYOUTS = [
    (rf"(?s)^{_DAY_NAME}(\d{{1,2}})[- /]?([A-Za-z]{{3,9}})\.?,?[- /](\d{{4}}|\d{{2}}){_REST}$", "$3|$2|$1|$4"),
    (rf"(?s)^{_DAY_NAME}([A-Za-z]{{3,9}})\.?[- ](\d{{1,2}}),? *(\d{{4}}){_REST}$", "$3|$1|$2|$4"),
    (rf"(?s)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_REST}$", "$3|$1|$2|$4"),
    (rf"(?s)^(\d{{4}})[-/. ](\d{{1,2}}|[A-Za-z]{{3,9}})[-/. ](\d{{1,2}}){_REST}$", "$1|$2|$3|$4"),
    (r"^(\d{4})(\d{2})(\d{2})(?:\.0+)?$", "$1|$2|$3|"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,]\d+)? *([A-Za-z].*|[-+].*)?$", "$1|$2|$3|$4:$5:$6 $7"),
    (r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2}) *([A-Za-z].*|[-+].*)?$", "$1|$2|$3|$4:$5 $6"),
    (r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])([0-5]\d)$", "$1|$2|$3|$4:$5"),
    (r"^(19[7-9]\d|20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])$", "$1|$2|$3|$4:00"),
]
#: Layouts of a month, rewritten to year|month||.
_MONTH_LAYOUTS = [
    (r"^(\d{4})(\d{2})(?:\.0+)?$", "$1|$2||"),
    (r"^([A-Za-z]{3,9})\.?[-/., ]+'?(\d{4}|\d{2})$", "$2|$1||"),
    (r"^(\d{4})[-/., ]+(\d{1,2}|[A-Za-z]{3,9})$", "$1|$2||"),
    (r"^(\d{1,2})[-/., ]+(\d{4}|\d{2})$", "$2|$1||"),
]
_TIME = r"^(\d{1,2})(?::(\d{2}))?(?::(\d{2})(?:[.,]\d+)?)? *(?:([AaPp])\.?[Mm]\.?(?![A-Za-z/]))? *(.*)$"
_TIME_TIGHT = r"^(\d{2})(\d{2}) *([A-Za-z].*|[-+].*)?$"
_EPOCH = r"^(-?\d{7}|\d{9}|\d{10}|\d{11}|\d{12}|\d{13}|\d{16})(?:\.\d+)?$"


def _zone_file(name: str) -> bytes:
    """The compiled file of a zone, from the system's database or the tzdata package."""
    for root in zoneinfo.TZPATH:
        if (f := Path(root, name)).is_file():
            return f.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _listed_changes(raw: bytes) -> tuple[list[int], bool]:
    """The moments of change that a compiled zone file (RFC 8536) lists, and whether a rule with daylight-saving time follows them."""
    sizes = lambda at: struct.unpack(">6l", raw[at + 20 : at + 44])

    def body(n: tuple[int, ...], wide: int) -> int:
        utc, std, leap, times, types, chars = n
        return times * (wide + 1) + types * 6 + chars + leap * (wide + 4) + std + utc

    at, wide = 0, 4
    if raw[4:5] >= b"2":
        at, wide = 44 + body(sizes(0), 4), 8
    n = sizes(at)
    times = struct.unpack(f">{n[3]}{'q' if wide == 8 else 'l'}", raw[at + 44 : at + 44 + n[3] * wide])
    rule = raw[at + 44 + body(n, wide) :].strip() if wide == 8 else b""
    return list(times), b"," in rule


def _change(offset, lo: int, hi: int) -> int:
    """The first second after lo, up to hi, with another offset than lo."""
    o = offset(lo)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if offset(mid) == o else (lo, mid)
    return hi


_ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _year_type(y: int) -> int:
    """0 to 13: the week day of the first of January, and whether it is a leap year. Rules are alike in years of one type."""
    return date(y, 1, 1).weekday() + 7 * (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))


@lru_cache(maxsize=1)
def _database() -> tuple[int, int, list[int], list[tuple[str, list[tuple[int, int, int]]]]]:
    """(first year, last year with changes of its own, for each type of year one that stands for all later ones, zones with their intervals).

    An interval is (local start, local end, offset) in seconds; the first begins before all dates, the last ends after them.
    """
    known: dict[bytes, tuple[list[int], bool, list[str]]] = {}
    for name in sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"}):
        raw = _zone_file(name)
        if raw not in known:
            known[raw] = (*_listed_changes(raw), [])
        known[raw][2].append(name)
    moments = [t for times, _, _ in known.values() for t in times if t > -(1 << 40)]
    first, last = ((_ZERO + timedelta(seconds=t)).year for t in (min(moments), max(moments)))
    stand_in: dict[int, int] = {}
    for y in range(last + 1, last + 400):
        stand_in.setdefault(_year_type(y), y)
    end = int((datetime(max(stand_in.values()) + 1, 3, 1, tzinfo=timezone.utc) - _ZERO).total_seconds())
    zones = []
    for times, ruled, names in known.values():
        zone = zoneinfo.ZoneInfo(names[0])
        offset = lru_cache(4)(lambda t, zone=zone: int((_ZERO + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds()))
        cuts = [t for t in times if t > -(1 << 40)]
        if ruled:
            t, step = max([*cuts, 0]), PROBE_DAYS * 86400
            while t < end:
                if offset(t + step) != offset(t):
                    cuts.append(_change(offset, t, t + step))
                t += step
        spans, o = [], offset(cuts[0] - 1) if cuts else offset(0)
        begin = -(1 << 40)
        for t in cuts:
            if (n := offset(t)) != o:
                spans.append((begin + o, t + o, o))
                begin, o = t, n
        spans.append((begin + o, 1 << 40, o))
        zones += [(name, spans) for name in names]
    return first, last, [stand_in[k] for k in range(14)], zones


@lru_cache(maxsize=1)
def _interval_table() -> pa.Table:
    """(tz, bucket, spans): the offset intervals that touch BUCKET_YEARS local years, ordered, as an array of (s, e, off). Every zone of the database is there, by all its names."""
    first, last, stand_in, zones = _database()
    second = lambda y: (date(y, 1, 1).toordinal() - _ZERO.toordinal()) * 86400
    tz, bucket, ends, flat = [], [], [0], []
    for name, own in zones:
        at = 0
        for k in range((first - 1) // BUCKET_YEARS, max(stand_in) // BUCKET_YEARS + 1):
            a, b = second(k * BUCKET_YEARS) - 2 * 86400, second((k + 1) * BUCKET_YEARS) + 2 * 86400
            while own[at][1] <= a:
                at += 1
            to = at
            while to < len(own) and own[to][0] < b:
                to += 1
            tz.append(name)
            bucket.append(k)
            flat += own[at:to]
            ends.append(len(flat))
    s, e, o = zip(*flat)
    spans = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(o, pa.int32())], ["s", "e", "off"])
    return pa.table({"tz": tz, "bucket": pa.array(bucket, pa.int32()), "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)})


def zone_intervals(spark: SparkSession) -> DataFrame:
    """The table of _interval_table."""
    return spark.createDataFrame(_interval_table())


def _rule_year(y: Column) -> Column:
    """The year whose intervals hold for a year: itself, the first before all changes, or after the last listed change one of its type."""
    first, last, stand_in, _ = _database()
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    kind = F.weekday(F.make_date(y, F.lit(1), F.lit(1))) + F.when(leap, 7).otherwise(0)
    later = F.element_at(F.array(*[F.lit(x) for x in stand_in]), (kind + 1).cast("int"))
    return F.when(y > last, later).otherwise(F.greatest(y, F.lit(first - 1)))


def _rule_shift(y: Column, rule: Column) -> Column:
    """The seconds from a year to the one whose intervals stand for it; 0 for years up to the last listed change."""
    jan = lambda c: F.unix_date(F.make_date(c, F.lit(1), F.lit(1))).cast("long")
    return F.when(y > _database()[1], (jan(rule) - jan(y)) * 86400).otherwise(F.lit(0))


def _first_match(text: Column, layouts: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    out = None
    for pattern, form in layouts:
        hit = F.regexp_replace(text, pattern, form)
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out.otherwise(otherwise) if otherwise is not None else out


def _month(text: Column) -> Column:
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text, 1, 3))).cast("int")
    return F.when(text.rlike(r"^\d+$"), text.cast("int")).otherwise(F.nullif(named, F.lit(0)))


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) == 2, F.when(y >= PIVOT, y + 1900).otherwise(y + 2000)).otherwise(y)


def normalised(df: DataFrame, value: str, tz: str, *, day_needed: bool | Column = True, with_day: bool = True) -> DataFrame:
    """df with norm_text, time_status, utc_seconds and (with_day) local_day: the day as written, or that of the moment in the row's own zone, in UTC if that isn't known.

    norm_text is `YYYY-MM-DDTHH:MM:SSZ` in UTC for a value with a time of day (fractions dropped), `YYYY-MM-DD` for a day, `YYYY-MM` for a
    month, `INVALID` for what names no existing date or time, has no year, or only a month though day_needed. time_status is `zoned`, `local`,
    `ambiguous` (occurs twice: the first is taken), `skipped` (the offset in force before the change is taken), `unplaced` (no zone known: INVALID),
    `day`, `month` or `invalid`. Null values give nulls; empty texts are INVALID. Years of two digits from 78 on are 19xx; in dates
    that start with a number below the year the month comes first unless it is named; a bare number is calendar digits or seconds,
    milli- or microseconds since 1970. A zone may be any of the database by any of its names; all years from 1 to 9999 have their offsets: before a zone's first
    change its first one, after its last listed change those of its rule. Works on any extra columns; columns that start with `_t_` or `_z_` are taken for its own.
    """
    spark = df.sparkSession
    text = F.trim(F.regexp_replace(F.col(value), r"\s+", " "))
    d = df.withColumn("_t_text", text)
    t = F.col("_t_text")
    d = d.withColumn("_t_parts", F.split(_first_match(t, _LAYOUTS, _first_match(t, _MONTH_LAYOUTS)), r"\|", 4))
    part = lambda i: F.col("_t_parts")[i]
    d = d.withColumns({"_t_y": _year(part(0)), "_t_m": _month(part(1)), "_t_d": part(2).try_cast("int"), "_t_rest": F.trim(part(3))})
    y, m, day, rest = (F.col(c) for c in ("_t_y", "_t_m", "_t_d", "_t_rest"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    iso = F.concat_ws("-", pad(y, 4), pad(m, 2), pad(day, 2))
    d = d.withColumn("_t_date", F.when(y.between(1, 9999) & m.between(1, 12) & day.between(1, 31), iso.try_cast("date")))
    # the time of day: the usual form, or four digits with a zone
    tight = rest.rlike(_TIME_TIGHT)
    g = lambda i: F.regexp_extract(rest, _TIME, i)
    q = lambda i: F.regexp_extract(rest, _TIME_TIGHT, i)
    num = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))
    d = d.withColumns({"_t_h": F.when(tight, num(q(1))).otherwise(num(g(1))), "_t_mi": F.when(tight, num(q(2))).otherwise(num(g(2))), "_t_s": F.when(tight, F.lit(0)).otherwise(num(g(3))), "_t_ap": F.when(tight, F.lit("")).otherwise(F.lower(g(4))), "_t_zone": F.trim(F.when(tight, q(3)).otherwise(g(5))), "_t_timed": tight | (rest.rlike(_TIME) & ((g(2) != "") | (g(4) != "")))})
    h, mi, s, ap, zone = (F.col(c) for c in ("_t_h", "_t_mi", "_t_s", "_t_ap", "_t_zone"))
    hour = F.when(ap == "", h).otherwise(h % 12 + F.when(ap == "p", 12).otherwise(0))
    time_ok = (h < 24) & (mi < 60) & (s < 60) & ((ap == "") | h.between(1, 12))
    plain = F.regexp_replace(F.upper(zone), r"^[\[(]|[\])]$", "")
    shift = F.regexp_extract(plain, r"^(?:UTC|GMT|Z)? ?([+-])(\d{1,2}):?(\d{2})?$", 1)
    shift_min = F.regexp_extract(plain, r"^(?:UTC|GMT|Z)? ?([+-])(\d{1,2}):?(\d{2})?$", 2)
    shift_rest = F.regexp_extract(plain, r"^(?:UTC|GMT|Z)? ?([+-])(\d{1,2}):?(\d{2})?$", 3)
    named = F.create_map(*[x for k, v in ZONE_MINUTES.items() for x in (F.lit(k), F.lit(v))])
    minutes = F.when(shift != "", (num(shift_min) * 60 + num(shift_rest)) * F.when(shift == "-", -1).otherwise(1)).otherwise(F.try_element_at(named, plain))
    d = d.withColumns({"_t_off": minutes, "_t_region": F.when((zone != "") & minutes.isNull(), F.regexp_replace(zone, r"^[\[(]|[\])]$", "")), "_t_local": F.when(time_ok, F.unix_date("_t_date").cast("long") * 86400 + hour * 3600 + mi * 60 + s)})
    # bare numbers
    digits = F.regexp_extract(t, _EPOCH, 1)
    unit = F.when(F.length(digits) <= 10, F.lit(1)).when(F.length(digits) <= 13, F.lit(1000)).otherwise(F.lit(1_000_000))
    epoch = F.when(part(0).isNull() & (digits != ""), F.floor(digits.try_cast("long") / unit).cast("long"))
    d = d.withColumn("_t_epoch", epoch)
    # the as-of join to the offset intervals
    zones = F.broadcast(zone_intervals(spark).withColumnsRenamed({"tz": "_z_tz", "bucket": "_z_bucket", "spans": "_z_spans"}))
    bare = F.col("_t_timed") & (zone == "")
    d = d.withColumn("_t_tz", F.when(F.col("_t_local").isNotNull(), F.when(bare, F.col(tz)).otherwise(F.col("_t_region"))))
    d = d.withColumn("_t_rule", F.when(F.col("_t_tz").isNotNull(), _rule_year(y)))
    d = d.withColumn("_t_shift", _rule_shift(y, F.col("_t_rule")))
    d = d.join(zones, (F.col("_t_tz") == F.col("_z_tz")) & (F.floor(F.col("_t_rule") / BUCKET_YEARS) == F.col("_z_bucket")), "left")
    local = F.col("_t_local")
    there = local + F.col("_t_shift")
    d = d.withColumn("_t_hit", F.filter("_z_spans", lambda x: (x["s"] <= there) & (there < x["e"])))
    before = F.filter("_z_spans", lambda x: x["e"] <= there)
    hits = F.size("_t_hit")
    # of two intervals the earlier moment is the one with the larger offset
    asof = F.when(hits >= 1, F.array_max(F.transform("_t_hit", lambda x: x["off"]))).when(F.size(before) > 0, F.element_at(F.transform(before, lambda x: x["off"]), -1))
    timed, off = F.col("_t_timed"), F.col("_t_off")
    utc = F.when(F.col("_t_epoch").isNotNull(), F.col("_t_epoch")).when(timed & off.isNotNull(), local - off * 60).when(timed, local - asof)
    d = d.withColumn("utc_seconds", utc)
    needed = day_needed if isinstance(day_needed, Column) else F.lit(day_needed)
    month_ok = y.between(1, 9999) & m.between(1, 12)
    has_day = F.coalesce(part(2) != "", F.lit(False))
    status = (
        F.when(F.col(value).isNull(), F.lit(None).cast("string"))
        .when(F.col("_t_epoch").isNotNull(), "zoned")
        .when(F.col("_t_parts").isNull(), "invalid")
        .when(~has_day, F.when(month_ok & ~needed, "month").otherwise("invalid"))
        .when(F.col("_t_date").isNull(), "invalid")
        .when(rest == "", "day")
        .when(~F.coalesce(timed, F.lit(False)) | local.isNull(), "invalid")
        .when(off.isNotNull(), "zoned")
        .when((zone != "") & F.col("_z_tz").isNull(), "invalid")
        .when(utc.isNull(), "unplaced")
        .when(hits > 1, "ambiguous")
        .when(hits == 0, "skipped")
        .otherwise("local")
    )
    d = d.withColumn("time_status", status)
    st = F.col("time_status")
    zoned_text = F.concat(F.date_format(F.date_from_unix_date(F.floor(F.col("utc_seconds") / 86400).cast("int")), "yyyy-MM-dd"), F.lit("T"), *_clock(F.pmod("utc_seconds", F.lit(86400))), F.lit("Z"))
    norm = F.when(st.isNull(), F.lit(None).cast("string")).when(st.isin("invalid", "unplaced"), "INVALID").when(st == "day", F.date_format("_t_date", "yyyy-MM-dd")).when(st == "month", F.concat_ws("-", pad(y, 4), pad(m, 2))).otherwise(zoned_text)
    d = d.withColumn("norm_text", norm)
    if with_day:  # the day of a moment given with a zone is that of the row's own zone
        moment = F.when(st == "zoned", F.col("utc_seconds"))
        d = d.withColumn("_t_day", F.date_from_unix_date(F.floor(moment / 86400).cast("int")))
        d = d.withColumn("_t_rule2", _rule_year(F.year("_t_day")))
        d = d.withColumn("_t_shift2", _rule_shift(F.year("_t_day"), F.col("_t_rule2")))
        again = zones.withColumnsRenamed({"_z_tz": "_z_tz2", "_z_bucket": "_z_bucket2", "_z_spans": "_z_spans2"})
        d = d.join(F.broadcast(again), (F.col(tz) == F.col("_z_tz2")) & (F.floor(F.col("_t_rule2") / BUCKET_YEARS) == F.col("_z_bucket2")), "left")
        then = moment + F.col("_t_shift2")
        here = F.try_element_at(F.filter("_z_spans2", lambda x: (x["s"] - x["off"] <= then) & (then < x["e"] - x["off"])), F.lit(1))["off"]
        day = F.date_from_unix_date(F.floor((moment + F.coalesce(here, F.lit(0))) / 86400).cast("int"))
        d = d.withColumn("local_day", F.when(st == "zoned", F.least(day, F.lit("9999-12-31").cast("date"))).when(st.isin("day", "local", "ambiguous", "skipped", "unplaced"), F.col("_t_date")))
    return d.drop(*[c for c in d.columns if c.startswith(("_t_", "_z_"))])


def _clock(seconds: Column) -> list[Column]:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return [two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60)]


def with_zone(df: DataFrame, key: str, places: DataFrame, place_key: str, place_tz: str, out: str = "tz_of_row") -> DataFrame:
    """df with the zone of the place that key names; null where the place isn't known. Of several zones listed for a place the first by name is taken."""
    p = small(places.groupBy(F.col(place_key).alias("_p_key")).agg(F.min(place_tz).alias(out)))
    return df.join(p, F.col(key) == F.col("_p_key"), "left").drop("_p_key")


def is_documented(value: Column, form: str) -> Column:
    """Whether the value is exactly an existing date in a documented form: DD-MON-YY, MM/DD/YYYY or yyyymm. Null gives false."""
    if form == "DD-MON-YY":
        mon = F.array_position(F.array(*[F.lit(m.upper()) for m in MONTHS]), F.substring(value, 4, 3))
        yy = F.substring(value, 8, 2).try_cast("int")
        iso = F.concat_ws("-", (yy + F.when(yy >= PIVOT, 1900).otherwise(2000)).cast("string"), F.lpad(mon.cast("string"), 2, "0"), F.substring(value, 1, 2))
        ok = value.rlike(r"^\d{2}-[A-Z]{3}-\d{2}\z") & (mon > 0) & iso.try_cast("date").isNotNull()
    elif form == "MM/DD/YYYY":
        iso = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2))
        ok = value.rlike(r"^\d{2}/\d{2}/\d{4}\z") & iso.try_cast("date").isNotNull()
    else:
        ok = value.rlike(r"^\d{6}\z") & F.substring(value, 5, 2).try_cast("int").between(1, 12)
    return F.coalesce(ok, F.lit(False))


def latest(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """(key, cols): one row per key, the one that arrived last; ties by the largest values. Null keys are left out."""
    top = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_r"))
    return top.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
