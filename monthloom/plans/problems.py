"""Queries over the registers: times, trailing totals, failed rows, packed values; with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import badrows, packed, rolling, timestamps
from ..session import settled, shared_dir
from ..sources.tables import table

REGISTERS = [
    ("faa", "faa_incidents", "incident_id", "localeventdate", "office_code", "DD-MON-YY", True),
    ("ntsb", "ntsb_incidents", "ntsb_id", "event_date", "office_code", "MM/DD/YYYY", True),
    ("asrs", "asrs_reports", "acn", "report_date", "facility_code", "yyyymm", False),
]


def _times(spark: SparkSession, sf: str, only_undocumented: bool) -> DataFrame:
    """The records of the three registers in one table, normalised at once."""
    parts = []
    for name, source, key, value, place, form, day_needed in REGISTERS:
        rows = timestamps.latest(table(spark, sf, source), key, "received_ts", [value, place])
        if only_undocumented:
            rows = rows.filter(F.col(value).isNotNull() & ~timestamps.is_documented(F.col(value), form))
        parts.append(rows.select(F.lit(name).alias("register_name"), F.col(key).alias("record_id"), F.col(value).alias("value"), F.concat(F.lit("facility " if name == "asrs" else "office "), place).alias("place"), F.lit(day_needed).alias("day_needed")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    places = table(spark, sf, "field_offices").select(F.concat(F.lit("office "), "office_code").alias("place"), "tz_name")
    places = places.unionByName(table(spark, sf, "airport_reference").select(F.concat(F.lit("facility "), "loc_id").alias("place"), "tz_name"))
    out = timestamps.normalised(timestamps.with_zone(rows, "place", places, "place", "tz_name"), "value", "tz_of_row", day_needed=F.col("day_needed"), with_day=False)
    return out.select("register_name", "record_id", "norm_text", "time_status")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf, True).select("register_name", "record_id", "norm_text")


def p3_time_status(spark: SparkSession, sf: str) -> DataFrame:
    """How the values of each register came out."""
    return _times(spark, sf, False).groupBy("register_name", "time_status").agg(F.count(F.lit(1)).alias("n_records"))


def _deliveries(spark: SparkSession, sf: str, first: bool = False) -> DataFrame:
    """One delivery of each count_id, the last or the first."""
    rows, order = table(spark, sf, "daily_counts"), F.col("loaded_ts")
    if first:
        rows = rows.withColumn("loaded_ts", F.lit("2200-01-01").cast(rows.schema["loaded_ts"].dataType) - order)
    rows = timestamps.latest(rows, "count_id", "loaded_ts", ["airport_code", "event_year", "event_month", "event_day", *COUNTS])
    two = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    day = F.when(F.col("event_year").between(1, 9999) & F.col("event_month").between(1, 12) & F.col("event_day").between(1, 31), F.concat_ws("-", two("event_year", 4), two("event_month", 2), two("event_day", 2)).try_cast("date"))
    code = F.nullif(F.upper(F.trim("airport_code")), F.lit(""))
    return rows.select("count_id", code.alias("airport_code"), day.alias("day"), *COUNTS)


COUNTS, PERIODS = ["faa_incidents", "ntsb_incidents"], [7, 30]


def _as_text(out: DataFrame) -> DataFrame:
    return out.select("airport_code", F.date_format("day", "yyyy-MM-dd").alias("day_text"), *[F.round(c, 6).alias(c) for c in out.columns if "_avg_" in c], *[F.col(c).cast("long").alias(c) for c in out.columns if "_total_" in c])


def p4_trailing_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and daily averages over 7 and 30 days for every airport and day."""
    return _as_text(rolling.trailing_totals(_deliveries(spark, sf), "airport_code", "day", COUNTS, PERIODS))


def p4_corrected_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The same from stored trees: built from the first delivery of each count, then corrected where a later one differs."""
    first, last = settled(_deliveries(spark, sf, True)), settled(_deliveries(spark, sf))
    trees = rolling.StoredTrees(spark, f"{shared_dir(spark)}/trees_{uuid.uuid4().hex}", COUNTS, PERIODS)
    trees.build(rolling.daily_sums(first, "airport_code", "day", COUNTS))
    gone, come = first.exceptAll(last).withColumn("sign", F.lit(-1)), last.exceptAll(first).withColumn("sign", F.lit(1))
    trees.correct(rolling.daily_sums(gone.unionByName(come), "airport_code", "day", COUNTS, F.col("sign")))
    return _as_text(trees.totals("airport_code"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = rolling.trailing_totals(_deliveries(spark, sf), "airport_code", "day", COUNTS, PERIODS)
    week = F.col("faa_incidents_total_7d") + F.col("ntsb_incidents_total_7d")
    month = F.col("faa_incidents_total_30d") + F.col("ntsb_incidents_total_30d")
    return t.filter((week == 0) & (month >= 15)).select("airport_code", F.date_format("day", "yyyy-MM-dd").alias("day_text"))


_DAYS_SQL = """
WITH one AS (
  SELECT * FROM daily_counts QUALIFY row_number() OVER (PARTITION BY count_id ORDER BY loaded_ts DESC) = 1),
d AS (
  SELECT upper(trim(airport_code)) AS airport_code,
         TRY_CAST(printf('%04d-%02d-%02d', event_year, event_month, event_day) AS DATE) AS day,
         coalesce(faa_incidents, 0) AS f, coalesce(ntsb_incidents, 0) AS n
  FROM one WHERE trim(airport_code) <> ''),
g AS (SELECT airport_code, day, sum(f) AS f, sum(n) AS n FROM d WHERE day IS NOT NULL GROUP BY 1, 2),
b AS (SELECT airport_code, min(day) AS lo, max(day) AS hi FROM g GROUP BY 1),
s AS (SELECT airport_code, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
w AS (
  SELECT s.airport_code, s.day,
         sum(coalesce(f, 0)) OVER x7 AS f7, sum(coalesce(n, 0)) OVER x7 AS n7,
         sum(coalesce(f, 0)) OVER x30 AS f30, sum(coalesce(n, 0)) OVER x30 AS n30
  FROM s LEFT JOIN g ON s.airport_code = g.airport_code AND s.day = g.day
  WINDOW x7 AS (PARTITION BY s.airport_code ORDER BY s.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         x30 AS (PARTITION BY s.airport_code ORDER BY s.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "ntsb_raw_lines")
    _, bad = badrows.split_rows(lines.select("line_id", "raw_line"), "raw_line", badrows.REGISTER_B, ["latitude", "airport_code"])
    return bad.select("line_id", "reason")


def p6_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that load, with their fields."""
    good, _ = badrows.split_rows(table(spark, sf, "ntsb_raw_lines").select("line_id", "raw_line"), "raw_line", badrows.REGISTER_B, ["latitude", "airport_code"])
    return good.drop("raw_line").withColumn("latitude", F.col("latitude").try_cast("double"))


_FIELD_SQL = r'[ \t\r]*(?:"[^"]*(?:""[^"]*)*"[ \t\r]*|[^" \t\r|][^"|]*)?'


def _sql_pattern(k: int, value: str) -> str:
    head = (_FIELD_SQL + r"\|") * k
    return rf'^{head}[ \t\r]*(?:"[ \t\r]*{value}[ \t\r]*"|{value})[ \t\r]*(?:\||$)'


_P6_SQL = f"""
SELECT line_id, reason FROM (
  SELECT line_id, CASE
    WHEN NOT regexp_full_match(raw_line, '{_FIELD_SQL}(?:\\|{_FIELD_SQL})*', 's') THEN 'quoting'
    WHEN NOT regexp_full_match(raw_line, '{_FIELD_SQL}(?:\\|{_FIELD_SQL}){{6}}', 's') THEN 'columns'
    WHEN NOT regexp_matches(raw_line, '{_sql_pattern(2, badrows.LATITUDE)}', 's') THEN 'latitude'
    WHEN NOT regexp_matches(raw_line, '{_sql_pattern(0, badrows.AIRPORT_CODE)}', 's') THEN 'airport_code' END AS reason
  FROM ntsb_raw_lines) WHERE reason IS NOT NULL
"""


_NAMES = [f.name for f in badrows.REGISTER_B]
_VALID_SQL = f"""
WITH g AS (SELECT line_id, regexp_extract(raw_line, '^({_FIELD_SQL})' || repeat('\\|({_FIELD_SQL})', 6) || '$', [{", ".join(f"'{n}'" for n in _NAMES)}], 's') AS s
  FROM ntsb_raw_lines WHERE raw_line IS NOT NULL AND line_id NOT IN (SELECT line_id FROM ({_P6_SQL}))),
t AS (SELECT line_id, {", ".join(f"trim(regexp_replace(s.{n}, '[\t\r]', ' ', 'g')) AS {n}" for n in _NAMES)} FROM g),
u AS (SELECT line_id, {", ".join(f"""nullif(CASE WHEN {n} LIKE '"%' THEN trim(replace({n}[2:length({n}) - 1], '""', '"')) ELSE {n} END, '') AS {n}""" for n in _NAMES)} FROM t)
SELECT * REPLACE (TRY_CAST(latitude AS DOUBLE) AS latitude) FROM u
"""


def _leftovers(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.latest(table(spark, sf, "leftovers"), "row_id", "acn", ["atcadvisory", "firstpass"])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = settled(_leftovers(spark, sf))  # the learning rounds read it again

    def split(name: str, arity: int | None) -> DataFrame:
        out = packed.split_values(rows, "row_id", name, arity).filter("n_values >= 2")
        return out.select("row_id", F.lit(name).alias("field_name"), "pos", "item")

    with ThreadPoolExecutor(2) as both:  # the short jobs of one column's rounds run beside those of the other
        first, second = both.map(split, ("atcadvisory", "firstpass"), (None, 3))
    return first.unionByName(second)


QUERIES = {f.__name__: f for f in (p3_found, p3_time_status, p4_found, p4_trailing_totals, p4_corrected_totals, p6_found, p6_valid_rows, p7_found)}

ORACLE = {
    "p4_found": _DAYS_SQL + "SELECT airport_code, strftime(day, '%Y-%m-%d') AS day_text FROM w WHERE f7 + n7 = 0 AND f30 + n30 >= 15",
    "p4_trailing_totals": _DAYS_SQL
    + """SELECT airport_code, strftime(day, '%Y-%m-%d') AS day_text,
      round(f7 / 7.0, 6) AS faa_incidents_avg_7d, round(n7 / 7.0, 6) AS ntsb_incidents_avg_7d,
      round(f30 / 30.0, 6) AS faa_incidents_avg_30d, round(n30 / 30.0, 6) AS ntsb_incidents_avg_30d,
      CAST(f7 AS BIGINT) AS faa_incidents_total_7d, CAST(n7 AS BIGINT) AS ntsb_incidents_total_7d,
      CAST(f30 AS BIGINT) AS faa_incidents_total_30d, CAST(n30 AS BIGINT) AS ntsb_incidents_total_30d FROM w""",
    "p6_found": _P6_SQL,
    "p6_valid_rows": _VALID_SQL,
}
ORACLE["p4_corrected_totals"] = ORACLE["p4_trailing_totals"]
