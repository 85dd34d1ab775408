"""The wide report: two registers, the reports' words and their windows, one row per entity and month.

Register events are counted by entity and month, united, freed of events both registers hold, densified, and joined with the counts of the reports' words and their own /
outside / overall totals over trailing windows; columns are named by measure, scope and window.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, text
from ..operators import lookup, panel, registers
from ..operators.timestamps import latest, normalised, with_zone
from ..session import settled
from ..sources.tables import table

FIRST, LAST = 1988 * 12 + 1, 2019 * 12 + 12
WINDOWS = [1, 3, 6, 12]
TOP = 50
WORDS = ["n_reports", "n_words", "n_callbacks"]


def column_names(parts: list[list[str]]) -> list[str]:
    """The product of name parts, joined by one underscore each; empty parts leave no trace."""
    return ["_".join(p for p in c if p) for c in product(*parts)]


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with the columns of the order that it has, each once."""
    have, out = set(df.columns), []
    for c in order:
        if c in have and c not in out:
            out.append(c)
    return df.select(*out)


def renamed(df: DataFrame, suffix: str, skip: list[str]) -> DataFrame:
    """df with lower-case names, flight classes in order, blanks and tabs as underscores, and the suffix on all but the skipped columns and those that have it."""
    new = {}
    for c in df.columns:
        name = class_column(c).strip().lower().replace(" ", "_").replace("\t", "_")
        new[c] = c if c in skip else name if suffix and name.endswith(suffix) else "_".join(filter(None, [name, suffix]))
    return df.withColumnsRenamed(new)


# Words of flight classes and how they are shortened in column names.
CLASS_WORDS = {"itinerant": "itnr", "general": "gen", "overflight": "ovrflt"}


def class_column(name: str) -> str:
    """The name of a column of flight volumes: of `CLASS<tab>RULES KIND` the second part comes first, joined, then the class; of `KIND Local` local comes first; other names stay."""
    short = lambda text: [CLASS_WORDS.get(w, w) for w in text.split()]
    if "\t" in name and ("IFR" in name or "VFR" in name):
        kind, _, rules = name.lower().partition("\t")
        return "_".join(["".join(short(rules)), *short(kind)])
    if name.endswith("Local") and len(name.split()) == 2:
        return "_".join(reversed(name.lower().split()))
    return name


def discovered(columns: list[str], having: list[str] = [], without: list[str] = [], not_ending: list[str] = [], skip: list[str] = []) -> list[str]:
    """The columns whose names hold any of having (if given) and none of without, don't end with any of not_ending and aren't to be skipped."""
    ok = lambda c: (not having or any(x in c for x in having)) and not any(x in c for x in without) and not c.endswith(tuple(not_ending)) and c not in skip
    return [c for c in columns if ok(c)]


#: A year that stands for none in the report table, and the first month that it doesn't hold in full.
NO_YEAR, INCOMPLETE = 20, 2019 * 12 + 11


def in_scope(df: DataFrame, month_idx: str) -> DataFrame:
    """Rows of real years up to the last month that the table holds in full; null months are left out."""
    year = F.floor((F.col(month_idx) - 1) / 12)
    return df.filter((year != NO_YEAR) & (F.col(month_idx) < INCOMPLETE))


def shortened(df: DataFrame, short: dict[str, str]) -> DataFrame:
    """df with parts of its column names replaced, in the order given."""
    new = {}
    for c in df.columns:
        name = c
        for long, brief in short.items():
            name = name.replace(long, brief)
        new[c] = name
    return df.withColumnsRenamed(new)


def _any_day(df: DataFrame, value: str, key: str, places: tuple[DataFrame, str], day_needed: bool = True) -> DataFrame:
    """df with local_day, the day that a value in any readable form means where it was written, and norm_text; the zone is that of the place that key names."""
    return normalised(with_zone(df, key, places[0], places[1], "tz_name"), value, "tz_of_row", day_needed=day_needed)


def _register_days(spark: SparkSession, sf: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events of both registers by entity, month and day: those dated as documented, or every readable date."""
    a = latest(table(spark, sf, "faa_incidents"), "incident_id", "received_ts", ["localeventdate", "tracon_code", "office_code"])
    b = latest(table(spark, sf, "ntsb_incidents"), "ntsb_id", "received_ts", ["event_date", "airport_code", "investigation_type", "office_code"])
    if every:
        offices = table(spark, sf, "field_offices"), "office_code"
        days = {k: f("local_day") for k, f in (("day", F.dayofmonth), ("month", F.month), ("year", F.year))}
        a, b = (_any_day(d, c, "office_code", offices).withColumns(days) for d, c in ((a, "localeventdate"), (b, "event_date")))
    else:
        a = a.filter(F.col("localeventdate").rlike(r"^\d{2}-[A-Z]{3}-\d{2}$")).withColumns(dates.day_month_year(F.col("localeventdate")))
        b = b.filter(F.col("event_date").rlike(r"^\d{2}/\d{2}/\d{4}$")).withColumns(dates.slashed(F.col("event_date")))
    a = a.withColumn("entity", F.col("tracon_code"))
    b = b.withColumns({"entity": names.short_code(names.clean_code(F.col("airport_code"))), "kind": F.col("investigation_type")})
    keep = "entity is not null and month between 1 and 12 and year between 1988 and 2019"
    month = dates.month_idx(F.col("year"), F.col("month")).alias("month_idx")
    return a.filter(keep).select("entity", month, "day"), b.filter(keep).select("entity", month, "day", "kind")


def register_panel(spark: SparkSession, sf: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entity, month_idx, faa, incidents, accidents, n_overlap, total, total_nodups) of the TOP busiest entities, dense; and those entities."""
    a, b = _register_days(spark, sf, every)
    keys = ["entity", "month_idx"]
    u = registers.union_totals([registers.counts(a, keys, "faa"), registers.class_counts(b, keys, "kind", {"incidents": "Incident", "accidents": "Accident"})], keys, ["faa", "incidents", "accidents"])
    u = registers.with_overlap(u, registers.overlap(a, b, [*keys, "day"], keys), keys).withColumn("total", F.col("faa") + F.col("incidents") + F.col("accidents"))
    u = settled(u.withColumn("total_nodups", F.col("total") - F.col("n_overlap")))  # one row per entity and month; read for the top and for the panel
    top = settled(u.groupBy("entity").agg(F.sum("total").alias("_t")).orderBy(F.desc("_t"), "entity").limit(TOP).select("entity"))
    measures = ["faa", "incidents", "accidents", "n_overlap", "total", "total_nodups"]
    return panel.dense(lookup.allowed(u, "entity", top), top, FIRST, LAST, measures, 0), top


def reports(spark: SparkSession, sf: str, every: bool = False, counted: bool = False) -> DataFrame:
    """One row per report with its month_idx, null unless the date is written as documented, or (every) in any readable form. counted: the number of words of the narrative and whether there is a callback in place of the texts, which so are never shuffled."""
    r, facts = table(spark, sf, "asrs_reports"), ["narrative", "callback", "synopsis", "combined"]
    if counted:
        r, facts = r.withColumns({"n_words": text.word_count(F.col("narrative")), "with_callback": F.col("callback").isNotNull()}), ["n_words", "with_callback"]
    r = latest(r, "acn", "received_ts", ["report_date", "facility_code", *facts])
    if every:
        r = _any_day(r, "report_date", "facility_code", (table(spark, sf, "airport_reference"), "loc_id"), day_needed=False)
        parts = F.split(F.coalesce(F.date_format("local_day", "yyyy-MM"), F.when(F.col("time_status") == "month", F.col("norm_text"))), "-")
        return r.withColumn("month_idx", dates.month_idx(parts[0].cast("int"), parts[1].cast("int")))
    return r.withColumn("month_idx", F.when(F.col("report_date").rlike(r"^\d{6}$"), dates.month_idx(*dates.yyyymm(F.col("report_date")).values())))


def report_panel(spark: SparkSession, sf: str, entities: DataFrame, every: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """(entity, month_idx, WORDS) of the reports of these entities in months written as documented, or of every readable date. counted: the reports, if they are at hand."""
    r = (reports(spark, sf, every, counted=True) if counted is None else counted).filter("month_idx is not null")
    d = r.select(F.col("facility_code").alias("entity"), "month_idx", F.col("n_words").alias("_w"), F.col("with_callback").alias("_c"))
    return lookup.allowed(d, "entity", entities).groupBy("entity", "month_idx").agg(F.count(F.lit(1)).alias("n_reports"), F.sum("_w").cast("long").alias("n_words"), F.count_if("_c").alias("n_callbacks"))


def report_windows(spark: SparkSession, sf: str, lag: int, every: bool = False, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity, month_idx, register counts, windows of WORDS, quotients) and the entities. counted: as in report_panel."""
    base, entities = register_panel(spark, sf, every)
    words = panel.dense(report_panel(spark, sf, entities, every, counted), entities, FIRST, LAST, WORDS, 0)
    scoped = panel.own_out_all(words, WORDS)
    measures = column_names([WORDS, ["", "out", "all"]])
    rolled = panel.lagged(scoped, measures, WINDOWS, lag)
    quotients = {}
    for n in WINDOWS:
        quotients[f"avg_words_{n}m"] = (f"n_words_{n}m", f"n_reports_{n}m")
        quotients[f"share_words_{n}m"] = (f"n_words_{n}m", f"n_words_all_{n}m")
    out = base.join(panel.ratios(rolled, quotients), ["entity", "month_idx"], "left")
    return ordered(out, [*base.columns, *[f"{m}_{n}m" for n in WINDOWS for m in measures], *quotients]), entities


def named_months(df: DataFrame) -> DataFrame:
    """df with year and month in place of month_idx."""
    year = F.floor((F.col("month_idx") - 1) / 12).cast("int")
    return df.select("entity", year.alias("year"), (F.col("month_idx") - year * 12).cast("int").alias("month"), *[c for c in df.columns if c not in ("entity", "month_idx")])


def final_wide(spark: SparkSession, sf: str, lag: int = 1) -> DataFrame:
    """The wide report with windows that end lag months before the row's month. Windows are null until they are complete; months without reports count 0.

    Only dates exactly in the documented form count, as in the SQL; final_wide_whole counts every readable date.
    """
    return named_months(report_windows(spark, sf, lag)[0])


def _sql() -> str:
    measures = column_names([WORDS, ["", "out", "all"]])

    def window(n: int) -> str:
        w = f"(PARTITION BY entity ORDER BY month_idx RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return ", ".join(f"CASE WHEN count({m}) OVER {w} = {n} THEN CAST(sum({m}) OVER {w} AS BIGINT) END AS {m}_{n}m" for m in measures)

    months = ", ".join(f"'{m}'" for m in dates.MONTH_NAMES)
    return f"""WITH fa AS (SELECT * FROM faa_incidents QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY received_ts DESC) = 1),
nt AS (SELECT *, nullif(upper(trim(replace(replace(replace(lower(trim(airport_code)), 'n/a', ''), 'none', ''), 'na', ''))), '') AS code FROM ntsb_incidents QUALIFY row_number() OVER (PARTITION BY ntsb_id ORDER BY received_ts DESC) = 1),
r AS (SELECT * FROM asrs_reports QUALIFY row_number() OVER (PARTITION BY acn ORDER BY received_ts DESC) = 1),
a0 AS (SELECT tracon_code AS entity, TRY_CAST(left(localeventdate, 2) AS INTEGER) AS day, nullif(list_position([{months}], localeventdate[4:6]), 0) AS month, TRY_CAST(right(localeventdate, 2) AS INTEGER) AS y FROM fa WHERE regexp_full_match(localeventdate, '[0-9]{{2}}-[A-Z]{{3}}-[0-9]{{2}}')),
a AS (SELECT entity, day, CAST(month + 12 * CASE WHEN y >= 78 THEN 1900 + y ELSE 2000 + y END AS INTEGER) AS month_idx FROM a0 WHERE entity IS NOT NULL AND month IS NOT NULL),
b AS (SELECT CASE WHEN length(code) = 4 AND code[1] = 'K' THEN code[2:] ELSE code END AS entity, CAST(event_date[4:5] AS INTEGER) AS day, CAST(event_date[1:2] AS INTEGER) AS month, CAST(event_date[1:2] AS INTEGER) + 12 * CAST(right(event_date, 4) AS INTEGER) AS month_idx, investigation_type AS kind
  FROM nt WHERE regexp_full_match(event_date, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND code IS NOT NULL),
ac AS (SELECT * FROM a WHERE month_idx BETWEEN {FIRST} AND {LAST}), bc AS (SELECT * FROM b WHERE month BETWEEN 1 AND 12 AND month_idx BETWEEN {FIRST} AND {LAST}),
u0 AS (SELECT entity, month_idx, sum(f) AS faa, sum(i) AS incidents, sum(c) AS accidents FROM (SELECT entity, month_idx, 1 AS f, 0 AS i, 0 AS c FROM ac UNION ALL SELECT entity, month_idx, 0, CAST(coalesce(kind = 'Incident', false) AS INTEGER), CAST(coalesce(kind = 'Accident', false) AS INTEGER) FROM bc) GROUP BY 1, 2),
o AS (SELECT entity, month_idx, sum(least(x.n, y.n)) AS n_overlap FROM (SELECT entity, month_idx, day, count(*) AS n FROM ac GROUP BY ALL) x JOIN (SELECT entity, month_idx, day, count(*) AS n FROM bc GROUP BY ALL) y USING (entity, month_idx, day) GROUP BY 1, 2),
u AS (SELECT u0.*, coalesce(n_overlap, 0) AS n_overlap FROM u0 LEFT JOIN o USING (entity, month_idx)),
top AS (SELECT entity FROM u GROUP BY 1 ORDER BY sum(faa + incidents + accidents) DESC, entity LIMIT {TOP}),
grid AS (SELECT entity, CAST(m AS INTEGER) AS month_idx FROM top CROSS JOIN (SELECT unnest(range({FIRST}, {LAST + 1})) AS m)),
w AS (SELECT facility_code AS entity, CAST(CAST(report_date AS INTEGER) // 100 * 12 + CAST(report_date AS INTEGER) % 100 AS INTEGER) AS month_idx, count(*) AS n_reports,
  sum(coalesce(len(list_filter(string_split(regexp_replace(narrative, '[[:punct:]]', ' ', 'g'), ' '), lambda x: x <> '')), 0)) AS n_words, count(callback) AS n_callbacks FROM r WHERE regexp_full_match(report_date, '[0-9]{{6}}') GROUP BY 1, 2),
d AS (SELECT grid.entity, grid.month_idx, {", ".join(f"coalesce({m}, 0) AS {m}" for m in WORDS)} FROM grid LEFT JOIN w USING (entity, month_idx)),
s AS (SELECT *, {", ".join(f"sum({m}) OVER z AS {m}_all, sum({m}) OVER z - {m} AS {m}_out" for m in WORDS)} FROM d WINDOW z AS (PARTITION BY month_idx)),
l AS (SELECT entity, month_idx, {", ".join(window(n) for n in WINDOWS)} FROM s)
SELECT l.entity, CAST((l.month_idx - 1) // 12 AS INTEGER) AS year, CAST((l.month_idx - 1) % 12 + 1 AS INTEGER) AS month, CAST(coalesce(faa, 0) AS BIGINT) AS faa, CAST(coalesce(incidents, 0) AS BIGINT) AS incidents, CAST(coalesce(accidents, 0) AS BIGINT) AS accidents,
  CAST(coalesce(n_overlap, 0) AS BIGINT) AS n_overlap, CAST(coalesce(faa + incidents + accidents, 0) AS BIGINT) AS total, CAST(coalesce(faa + incidents + accidents - n_overlap, 0) AS BIGINT) AS total_nodups,
  {", ".join(f"{m}_{n}m" for n in WINDOWS for m in measures)},
  {", ".join(f"round(n_words_{n}m / NULLIF(n_reports_{n}m, 0), 6) AS avg_words_{n}m, round(n_words_{n}m / NULLIF(n_words_all_{n}m, 0), 6) AS share_words_{n}m" for n in WINDOWS)}
FROM l LEFT JOIN u USING (entity, month_idx)"""


QUERIES = {"final_wide": final_wide}
ORACLE = {"final_wide": _sql()}
