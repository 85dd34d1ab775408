"""Queries over what sources and sinks do and over the rarer operators of words, places, advisories and windows; each with its SQL.

Files that a query reads are first written by the sinks to a folder of its own beside the checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import advisory, lookup, panel, registers, timestamps, tokens, vectors
from ..session import settled, shared_dir, small
from ..sources import sinks, tables
from ..sources.tables import table
from . import panels, wide

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Registers a query and its SQL."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        ORACLE[name or f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files_{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def delimited_round_trip(spark, sf):
    """Parts as pipe-delimited text with padded values and header, read with a declared schema."""
    path = _folder(spark)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias(" p_partkey "), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias(" p_name "), F.col("p_size").alias(" p_size"), "p_retailprice")
    p.write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", sep="|")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def second_header_left_out(spark, sf):
    """Nations as text whose second row names the columns."""
    path = _folder(spark)
    n = table(spark, sf, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    named = spark.createDataFrame([tuple(n.columns)], n.schema)
    sinks.write_table(named.unionByName(n).coalesce(1), path, fmt="csv")
    return tables.csv_second_header(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT p_partkey, p_type FROM part WHERE p_size > 10")
def folder_without_some_files(spark, sf):
    """A folder of delimited files of which those with a mark in their names are left out."""
    path = _folder(spark)
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    for size, name in ((F.col("p_size") > 10, "kept"), (F.col("p_size") <= 10, "skip")):
        sinks.write_table(p.filter(size).select("p_partkey", "p_type"), f"{path}/{name}", fmt="csv")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path")
    sources = [r["path"] for r in files.collect()]  # a handful of files
    whole = tables.csv(spark, sources, "p_partkey long, p_type string").withColumn("_f", F.input_file_name())
    return whole.filter(~F.col("_f").contains("/skip/")).drop("_f")


@query("SELECT DISTINCT unnest(string_split(lower(replace(n_name, '_', ' ')), ' ')) AS word FROM nation WHERE n_name BETWEEN 'NATION_10' AND 'NATION_19'")
def words_of_links(spark, sf):
    """The words of a page's links between two of them."""
    cell = F.concat(F.lit("<td><a href='x'>"), F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("</a></td>"))
    page = table(spark, sf, "nation").agg(F.concat(F.lit("<table><tr>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name", cell.alias("c")))), lambda x: x["c"]), ""), F.lit("</tr></table>")).alias("html"))
    return tables.link_words(page, "html", "NATION 10", "NATION 19")


CELLS = [(0, None, "i"), (0, None, "we"), (1, "pronoun", "us"), (1, "pronoun", None), (2, None, "sudden"), (3, None, ""), (3, None, "fear"), (4, "affect", "calm"), (4, "affect", "calm"), (5, None, "stray")]


@query("SELECT * FROM (VALUES ('pronoun', 'i'), ('pronoun', 'we'), ('affect', 'us'), ('affect', 'sudden'), ('affect', 'fear')) t(category, word)")
def category_dictionary(spark, sf):
    """A ragged list of categories, each named above the column that follows its last one."""
    return tables.ragged_groups(spark.createDataFrame(CELLS, "col_idx int, header string, word string"))


RAW_DICTIONARIES = {
    "nasa": [(1, " RWY ", "runway"), (2, "rwy", "runway strip"), (3, "apch", "approach"), (4, None, "nothing")], "faa": [(1, "TWR", "tower"), (2, "twr", "control tower")], "casa": [(1, "wx", "weather (general)"), (2, "gs", "glide slope")],
    "iata": [(1, None, "missing"), (2, "LAG", "lagos")], "hand": [(1, "maint", "maintenance"), (2, "maint", "main tank")], "hand2": [(1, "fms", None), (2, "atc", "air traffic control")],
}


@query("SELECT * FROM (VALUES ('nasa', 'rwy', 'runway'), ('nasa', 'apch', 'approach'), ('faa', 'twr', 'tower'), ('faa', 'twr', 'control tower'), ('casa', 'wx', 'weather'), ('casa', 'gs', 'glide slope'), ('iata', 'lag', 'lagos'), ('hand', 'maint', 'maintenance'), ('hand2', 'atc', 'air traffic control')) t(dict, acronym, fullform)")
def six_dictionaries(spark, sf):
    """Six dictionaries in one long table: brackets taken out of casa, first rows of nasa and both hand lists."""
    out = None
    for name, rows in RAW_DICTIONARIES.items():
        d = tables.dictionary(spark.createDataFrame(rows, "ord int, acronym string, fullform string"), name, "acronym", "fullform", "ord", strip_parens=name == "casa", first_only=name in ("nasa", "hand", "hand2"))
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT DISTINCT p_name AS word, 'flagged' AS what FROM part WHERE p_size > 45 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'after' FROM part WHERE p_partkey > (SELECT max(p_partkey) FROM part WHERE p_size = 7 OR p_size = 9)")
def annotated_words(spark, sf):
    """Words whose annotation is filled, and those after the last annotated row."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 45, "x").alias("note"), F.when(F.col("p_size") == 7, "a").alias("fix"), F.when(F.col("p_size") == 9, "b").alias("add"))
    after = tables.after_last_flag(p.withColumn("word", F.col("p_partkey").cast("string")), "p_partkey", "word", ["fix", "add"])
    return tables.flagged_words(p, "p_name", "note").withColumn("what", F.lit("flagged")).unionByName(after.withColumn("what", F.lit("after")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def corpus_from_cache(spark, sf):
    """A table built once, written, and read from there the second time."""
    path = _folder(spark)
    build = lambda: table(spark, sf, "documents").select("doc_id", "source")
    tables.cached(spark, path, build)
    again = tables.cached(spark, path, lambda: build().limit(0))
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS facility, CAST(n_nationkey AS BIGINT) * 1234567 AS operations, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END AS local_ops FROM nation")
def volume_report(spark, sf):
    """An HTML table of volumes with thousands separators as typed columns."""
    n = F.col("n_nationkey").cast("long")
    ops = F.regexp_replace((n * 1234567).cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    cells = lambda *cs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td class='n'>"), c, F.lit("</td>")) for c in cs], F.lit("</tr>"))
    page = table(spark, sf, "nation").select(F.lit("p").alias("k"), F.concat(F.lit("<table><tr><th>Facility</th><th>Operations</th><th>Local</th></tr>"), cells(F.concat(F.lit("<b>"), "n_name", F.lit("</b>")), ops, F.when(n % 5 == 0, "&nbsp;").otherwise(n.cast("string"))), F.lit("</table>")).alias("html"))
    rows = tables.html_rows(page, "k", "html").filter("row > 0").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("facility", "operations", "local_ops"))])
    return tables.volume_report(rows, ["operations", "local_ops"])


@query(panels.ORACLE["word_tags"])
def words_by_tag(spark, sf):
    """Tagged words written to one folder per tag and read together."""
    path = _folder(spark)
    sinks.write_table(panels.QUERIES["word_tags"](spark, sf), path, by=["tag"])
    return spark.read.parquet(path).select("word", "ct", F.coalesce(F.col("tag").cast("string"), F.lit("")).alias("tag"), "abrev")


_LONG = "SELECT 'n_orders' AS measure, '{n}m' AS win, {lag} AS lag, entity, month_idx, n_orders_{n}m AS value FROM (SELECT entity, month_idx, {w} FROM panel)"


@query(f"WITH {panels._panel_sql()} " + " UNION ALL ".join(_LONG.format(n=n, lag=g, w=panels._window_sql(n, g, ["n_orders"])) for n, g in ((1, 1), (3, 1), (3, 2))))
def windows_by_file(spark, sf):
    """Windowed sums written to one folder per measure, window and lag."""
    path, out = _folder(spark), None
    dense = settled(panels._panel(spark, sf))
    for n, lag in ((1, 1), (3, 1), (3, 2)):
        w = panel.lagged(dense, ["n_orders"], [n], lag).select(F.lit("n_orders").alias("measure"), F.lit(f"{n}m").alias("win"), F.lit(lag).alias("lag"), "entity", "month_idx", F.col(f"n_orders_{n}m").alias("value"))
        out = w if out is None else out.unionByName(w)
    sinks.write_table(out, path, by=["measure", "win", "lag"])
    return spark.read.parquet(path).select("measure", "win", F.col("lag").cast("int").alias("lag"), "entity", "month_idx", "value")


@query("SELECT 'kept' AS what, line_id FROM ntsb_raw_lines WHERE NOT coalesce(raw_line LIKE '%\"%', false) UNION ALL SELECT 'apart', line_id FROM ntsb_raw_lines WHERE raw_line LIKE '%\"%'")
def rows_set_apart(spark, sf):
    """Lines with quotes written apart, the others returned."""
    path = _folder(spark)
    kept = sinks.quarantine(table(spark, sf, "ntsb_raw_lines").select("line_id", "raw_line"), F.col("raw_line").contains('"'), path)
    return kept.select(F.lit("kept").alias("what"), "line_id").unionByName(spark.read.parquet(path).select(F.lit("apart").alias("what"), "line_id"))


# --- registers, places, lookups ------------------------------------------------------------------------------------------------------


@query("SELECT tracon_code, count(eventtype) AS n_typed, count(*) AS n_rows FROM faa_incidents GROUP BY 1")
def event_type_counts(spark, sf):
    """Rows per airport, and those whose type is given."""
    d = table(spark, sf, "faa_incidents")
    typed = registers.counts(d, ["tracon_code"], "n_typed", "eventtype").withColumnRenamed("tracon_code", "_k")
    return registers.counts(d, ["tracon_code"], "n_rows").join(typed, F.col("tracon_code").eqNullSafe(F.col("_k"))).select("tracon_code", "n_typed", "n_rows")


@query("""WITH m AS (SELECT state_code AS code, min(full_state) AS name FROM airport_reference GROUP BY 1),
p AS (SELECT ntsb_id, received_ts, string_split(location_text, ',') AS p FROM ntsb_incidents), q AS (SELECT *, CASE WHEN len(p) IN (2, 3) THEN trim(p[2]) END AS second, CASE WHEN len(p) >= 2 THEN trim(p[-1]) END AS last FROM p)
SELECT ntsb_id, received_ts, CASE WHEN len(p) IN (2, 3) THEN lower(trim(p[1])) END AS city, CASE WHEN len(p) = 3 THEN coalesce(a.name, second) WHEN len(p) = 2 THEN a.name END AS state,
CASE WHEN b.name IS NOT NULL OR last = 'USA' THEN 'United States' ELSE last END AS country FROM q LEFT JOIN m a ON a.code = second LEFT JOIN m b ON b.code = last""")
def located_places(spark, sf):
    """City, state written out, and country of register B."""
    d = table(spark, sf, "ntsb_incidents").select("ntsb_id", "received_ts", "location_text")
    return names.located(d, "location_text", table(spark, sf, "airport_reference"), "state_code", "full_state").drop("location_text")


HANDCODED = [(1, "ECONOMY", "cold widget", 24, "?"), (2, "ECONOMY", "cold widget", 24, "first"), (3, "ECONOMY", "cold widget", 24, "last"), (4, "STANDARD", "small widget", 10, "?"), (5, "PROMO", "small gear", 3, "third")]


@query("WITH o(ord, p_type, p_name, p_size, v) AS (VALUES " + ", ".join(map(str, HANDCODED)) + """), l AS (SELECT * FROM o WHERE v <> '?' QUALIFY row_number() OVER (PARTITION BY p_type, p_name, p_size ORDER BY ord DESC) = 1)
SELECT p_partkey, coalesce(l.v, p_brand) AS label FROM part LEFT JOIN l USING (p_type, p_name, p_size)""")
def composite_override(spark, sf):
    """Overrides by three keys at once, the last one winning."""
    o = spark.createDataFrame(HANDCODED, "ord int, p_type string, p_name string, p_size int, v string")
    d = table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_size", F.col("p_brand").alias("label"))
    return lookup.override(d, ["p_type", "p_name", "p_size"], o, "v", "ord", "label").select("p_partkey", "label")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'PATCHED' WHEN 7 THEN 'ALSO' ELSE n_name END AS n_name FROM nation")
def patched_rows(spark, sf):
    """A few rows corrected by their keys."""
    patches = spark.createDataFrame([(3, "PATCHED"), (7, "ALSO"), (999, "NOWHERE")], "n_nationkey int, n_name string")
    return lookup.patched(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", patches, "n_name")


# --- column names --------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS tracon, count(*) FILTER (o_orderstatus = 'F') AS ifritnr_air_carrier_3m, count(*) FILTER (o_orderstatus = 'O') AS vfrovrflt_gen_aviation_3m, count(*) FILTER (o_orderstatus = 'P') AS local_civil_3m, count(*) AS n_narr_3m FROM orders GROUP BY 1")
def renamed_columns(spark, sf):
    """Flight classes in order, a window's suffix, and long names shortened."""
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tracon")).agg(status("F").alias("Air Carrier\tIFR Itinerant"), status("O").alias("General Aviation\tVFR Overflight"), status("P").alias("Civil Local"), F.count(F.lit(1)).alias("N narrative_3m"))
    return wide.shortened(wide.renamed(d, "3m", ["tracon"]), {"narrative": "narr"})


@query("SELECT 'nasa_narr_ct' AS column_name UNION ALL SELECT 'faa_syn_ct'")
def dictionary_columns(spark, sf):
    """Which columns of a wide table count dictionary words."""
    have = ["tracon", "month", "nasa_narr_ct", "nasa_narr_ct_all", "nasa_narr_ct_out", "lwc_affect", "narr_avg_wc", "tower_ident_ct", "num_callbacks", "faa_syn_ct", "year"]
    found = wide.discovered(have, without=["lwc", "avg", "ident_ct", "num"], not_ending=["_all", "_out"], skip=["tracon", "month", "year"])
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query("SELECT doc_id FROM documents WHERE report_month // 100 <> 20 AND report_month < 201911")
def documents_in_scope(spark, sf):
    """Documents of real years up to the last full month."""
    d = table(spark, sf, "documents").select("doc_id", dates.month_idx(*dates.yyyymm(F.col("report_month")).values()).alias("m"))
    return wide.in_scope(d, "m").select("doc_id")


# --- words ---------------------------------------------------------------------------------------------------------------------------

FANNED = [*panels.DICTIONARIES, ("nasa", "the", "first form"), ("nasa", "the", "second form"), ("faa", "the", "third form"), ("faa", "the", "third form")]


@query(f"""WITH v AS (SELECT word, count(*) AS ct FROM (SELECT unnest({panels._CLEAN_SQL.format('lower(text)')}) AS word FROM documents) GROUP BY 1), d(dict, word, fullform) AS (VALUES {panels._values(FANNED)})
SELECT DISTINCT v.word, ct, {", ".join(f"{k}.fullform AS {k}" for k in panels.DICTS)} FROM v {" ".join(f"LEFT JOIN d {k} ON {k}.word = v.word AND {k}.dict = '{k}'" for k in panels.DICTS)}""")
def dictionary_fan_out(spark, sf):
    """Words with every combination of their full forms in six dictionaries."""
    d = spark.createDataFrame(FANNED, "dict string, acronym string, fullform string")
    return tokens.with_all_forms(tokens.word_counts(panels._docs(spark, sf), "text"), d, panels.DICTS)


@query(f"WITH {panels._TAG_SQL}, s AS (SELECT tag, count(DISTINCT ct) AS n_counts FROM t GROUP BY 1) SELECT tag, n_counts, round(n_counts / sum(n_counts) OVER (), 6) AS share_counts FROM s")
def tag_count_values(spark, sf):
    """Different numbers of occurrences per tag."""
    return tokens.count_values(panels._vocabulary(spark, sf))


_IDENTS = [t.lower().replace(" ", "_") + "_ident_ct" for t in advisory.TYPES]
_REPORTS_SQL = f"""{panels._FOUND_SQL}, one AS (SELECT * FROM asrs_reports QUALIFY row_number() OVER (PARTITION BY acn ORDER BY received_ts DESC) = 1),
o AS (SELECT DISTINCT row_id, acn FROM leftovers WHERE acn IS NOT NULL), c AS (SELECT acn, count(DISTINCT code) AS n_codes, {", ".join(f"count(DISTINCT code) FILTER (type = '{t}') AS {c}" for t, c in zip(advisory.TYPES, _IDENTS))} FROM o LEFT JOIN x USING (row_id) GROUP BY 1),
r AS (SELECT one.*, coalesce(n_codes, 0) AS n_codes, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _IDENTS)}, coalesce(c.acn IS NOT NULL, false) AS with_advisory, callback IS NOT NULL AS with_callback,
  CAST(CAST(report_date AS INTEGER) // 100 * 12 + CAST(report_date AS INTEGER) % 100 AS INTEGER) AS month_idx,
  coalesce(len(list_filter(string_split(regexp_replace(narrative, '[[:punct:]]', ' ', 'g'), ' '), lambda x: x <> '')), 0) AS n_w FROM one LEFT JOIN c USING (acn) WHERE regexp_full_match(report_date, '[0-9]{{4}}(0[1-9]|1[0-2])'))"""


def _coded_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports in months written as documented, with the codes and facility types of their advisories."""
    one = timestamps.latest(table(spark, sf, "asrs_reports"), "acn", "received_ts", ["report_date", "facility_code", "narrative", "callback"])
    one = one.filter(timestamps.is_documented(F.col("report_date"), "yyyymm")).withColumn("month_idx", dates.month_idx(*dates.yyyymm(F.col("report_date")).values()))
    found = timestamps.latest(table(spark, sf, "leftovers").withColumn("_order", F.col("acn")), "row_id", "_order", ["acn", "atcadvisory"]).filter("acn is not null")
    slots = found.select("acn", F.explode_outer(advisory.facilities(F.coalesce("atcadvisory", F.lit("")))).alias("e")).select("acn", "e.type", "e.code").distinct()
    types = [F.count(F.when(F.col("type") == t, F.col("code"))).alias(c) for t, c in zip(advisory.TYPES, _IDENTS)]
    codes = slots.groupBy("acn").agg(F.countDistinct("code").alias("n_codes"), *types)
    return one.join(codes, "acn", "left").withColumns({"with_advisory": F.col("n_codes").isNotNull(), "with_callback": F.col("callback").isNotNull()}).fillna(0, ["n_codes", *_IDENTS])


@query(f"""WITH {_REPORTS_SQL} SELECT facility_code, month_idx, count(*) AS n_docs, CAST(sum(n_w) AS BIGINT) AS n_words, round(avg(n_w), 6) AS avg_words, round(avg(n_codes), 6) AS avg_codes,
count(*) FILTER (with_advisory) AS n_with_advisory, count(*) FILTER (with_callback) AS n_with_callback, count(*) FILTER (with_advisory OR with_callback) AS n_any_flag, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _IDENTS)}, CAST(sum({" + ".join(_IDENTS)}) AS BIGINT) AS n_idents FROM r GROUP BY 1, 2""")
def entity_month_stats(spark, sf):
    """Reports, words, codes per report, flags and facility types of each facility and month."""
    return tokens.document_stats(_coded_reports(spark, sf), ["facility_code", "month_idx"], "narrative", codes="n_codes", flags=["with_advisory", "with_callback"], idents=_IDENTS)


_FIRST, _LAST = 2000 * 12 + 1, 2004 * 12 + 12


@query(f"""WITH {_REPORTS_SQL}, e AS (SELECT DISTINCT facility_code AS entity FROM r WHERE facility_code IS NOT NULL), g AS (SELECT entity, CAST(m AS INTEGER) AS month_idx FROM e CROSS JOIN (SELECT unnest(range({_FIRST}, {_LAST + 1})) AS m)),
f AS (SELECT facility_code AS entity, month_idx, count(*) AS n_docs, sum(n_codes) AS codes FROM r GROUP BY 1, 2), p AS (SELECT g.*, coalesce(n_docs, 0) AS n_docs, coalesce(codes, 0) AS codes FROM g LEFT JOIN f USING (entity, month_idx)),
y AS (SELECT entity, month_idx, {panels._window_sql(3, 1, ["n_docs", "codes"])}, {panels._window_sql(12, 1, ["n_docs", "codes"])} FROM p)
SELECT entity, month_idx, {", ".join(f"round(codes_{n}m / NULLIF(n_docs_{n}m, 0), 6) AS codes_per_report_{n}m" for n in (3, 12))} FROM y""")
def codes_per_report(spark, sf):
    """Codes per report over windows, from the windows' sums."""
    r = settled(_coded_reports(spark, sf))
    facts = r.filter("facility_code is not null").groupBy(F.col("facility_code").alias("entity"), "month_idx").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_codes").alias("codes"))
    d = panel.dense(facts, r.filter("facility_code is not null").select(F.col("facility_code").alias("entity")), _FIRST, _LAST, ["n_docs", "codes"], 0)
    w = panel.ratios(panel.lagged(d, ["n_docs", "codes"], [3, 12], 1), {f"codes_per_report_{n}m": (f"codes_{n}m", f"n_docs_{n}m") for n in (3, 12)})
    return w.select("entity", "month_idx", "codes_per_report_3m", "codes_per_report_12m")


_KINDS = sorted({c for c, _ in panels.CATEGORIES})
_SCOPED = [f"{k}{s}" for k in (*_KINDS, "n_docs", "wc") for s in ("", "_out", "_all")]


@query(f"""WITH v AS (SELECT source AS entity, doc_id, CAST(report_month // 100 * 12 + report_month % 100 AS INTEGER) AS month_idx, unnest({panels._CLEAN_SQL.format('lower(text)')}) AS word FROM documents WHERE source IS NOT NULL AND report_month IS NOT NULL), c(category, word) AS (VALUES {panels._values(panels.CATEGORIES)}),
w AS (SELECT entity, month_idx, count(*) AS wc FROM v GROUP BY 1, 2), n AS (SELECT source AS entity, CAST(report_month // 100 * 12 + report_month % 100 AS INTEGER) AS month_idx, count(*) AS n_docs FROM documents WHERE source IS NOT NULL AND report_month IS NOT NULL GROUP BY 1, 2),
k AS (SELECT entity, month_idx, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in _KINDS)} FROM v JOIN c ON c.word = v.word GROUP BY 1, 2),
e AS (SELECT DISTINCT source AS entity FROM documents WHERE source IS NOT NULL), g AS (SELECT entity, CAST(m AS INTEGER) AS month_idx FROM e CROSS JOIN (SELECT unnest(range({_FIRST}, {_LAST + 1})) AS m)),
p AS (SELECT g.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*_KINDS, "n_docs", "wc"))} FROM g LEFT JOIN w USING (entity, month_idx) LEFT JOIN n USING (entity, month_idx) LEFT JOIN k USING (entity, month_idx)),
s AS (SELECT *, {", ".join(f"sum({c}) OVER z AS {c}_all, sum({c}) OVER z - {c} AS {c}_out" for c in (*_KINDS, "n_docs", "wc"))} FROM p WINDOW z AS (PARTITION BY month_idx)),
x AS (SELECT entity, month_idx, {", ".join(panels._window_sql(n, 1, _SCOPED) for n in (3, 12))} FROM s)
SELECT entity, month_idx, {", ".join(f"round({c}{s}_{n}m / NULLIF(n_docs{s}_{n}m, 0), 6) AS {c}{s}_avg_{n}m, round({c}{s}_{n}m / NULLIF(wc{s}_{n}m, 0), 6) AS {c}{s}_pr_{n}m" for n in (3, 12) for c in _KINDS for s in ("", "_out", "_all"))} FROM x""")
def category_windows(spark, sf):
    """Category words per document and per word, own, outside and overall, over windows."""
    d = settled(panels._docs(spark, sf).filter("source is not null").select(F.col("source").alias("entity"), dates.month_idx(*dates.yyyymm(F.col("report_month")).values()).alias("month_idx"), "text"))
    keys, months = ["entity", "month_idx"], d.filter("month_idx is not null")
    counts = settled(tokens.word_counts(months, "text", keys))
    kinds = tokens.dictionary_counts(counts, keys, spark.createDataFrame(panels.CATEGORIES, "category string, word string"), "category")
    facts = months.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs")).join(counts.groupBy(*keys).agg(F.sum("ct").alias("wc")), keys, "left").join(panel.widened(kinds, keys, "category", _KINDS, "n_words"), keys, "left")
    measures = [*_KINDS, "n_docs", "wc"]
    scoped = panel.own_out_all(panel.dense(facts, d, _FIRST, _LAST, measures, 0), measures)
    quotients = {f"{c}{s}_{what}_{n}m": (f"{c}{s}_{n}m", f"{base}{s}_{n}m") for n in (3, 12) for c in _KINDS for s in ("", "_out", "_all") for what, base in (("avg", "n_docs"), ("pr", "wc"))}
    return panel.ratios(panel.lagged(scoped, _SCOPED, [3, 12], 1), quotients).select(*keys, *quotients)


# --- advisories ----------------------------------------------------------------------------------------------------------------------


@query("SELECT row_id, regexp_replace(coalesce(atcadvisory, '') || '; ' || coalesce(firstpass, ''), '; $', '') AS joined FROM (SELECT DISTINCT row_id, atcadvisory, firstpass FROM leftovers)")
def advisories_joined(spark, sf):
    """Both advisories of a row in one string."""
    return table(spark, sf, "leftovers").select("row_id", "atcadvisory", "firstpass").distinct().select("row_id", advisory.advisory(F.col("atcadvisory"), F.col("firstpass")).alias("joined"))


@query(f"""WITH {panels._FOUND_SQL}, k AS (SELECT DISTINCT loc_id FROM airport_reference)
SELECT l.row_id, coalesce(string_agg(x.type || ' ' || x.code, '|' ORDER BY pos) FILTER (k.loc_id IS NOT NULL), '') AS listed, coalesce(string_agg(x.type || ' ' || x.code, '|' ORDER BY pos) FILTER (x.code IS NOT NULL AND k.loc_id IS NULL), '') AS others
FROM l LEFT JOIN x USING (row_id) LEFT JOIN k ON k.loc_id = x.code GROUP BY 1""")
def advisories_by_code(spark, sf):
    """The facilities of a row whose codes the airport list has, and the others."""
    d = advisory.by_code(panels._found(spark, sf), "row_id", "found", table(spark, sf, "airport_reference"), "loc_id")
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["type"], F.lit(" "), e["code"])), "|").alias(c)
    return d.select("row_id", text("listed"), text("others"))


# --- vectors -------------------------------------------------------------------------------------------------------------------------


def _similarity_sql(n: int) -> str:
    d = panels.DIMS
    return f"""WITH {panels._VEC_SQL}, s AS (SELECT entity, CAST(vec_id % 12 AS INTEGER) AS month_idx, j, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2, 3),
gr AS (SELECT entity, CAST(m AS INTEGER) AS month_idx, j FROM (SELECT DISTINCT label AS entity FROM embeddings) CROSS JOIN (SELECT unnest(range(12)) AS m) CROSS JOIN (SELECT unnest(range({d})) AS j)),
w AS (SELECT entity, month_idx, j, coalesce(sum(coalesce(s, 0)) OVER f, 0) AS s, coalesce(sum(coalesce(n, 0)) OVER f, 0) AS n FROM gr LEFT JOIN s USING (entity, month_idx, j) WINDOW f AS (PARTITION BY entity, j ORDER BY month_idx RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)),
t AS (SELECT month_idx, j, sum(s) AS s, sum(n) AS n FROM w GROUP BY 1, 2),
g AS (SELECT entity, w.month_idx, max(w.n) AS n, max(t.n) AS n_all, sum(w.s * w.s) AS ss, sum(w.s * t.s) AS sa, sum((t.s - w.s) * (t.s - w.s)) AS oo FROM w JOIN t ON t.month_idx = w.month_idx AND t.j = w.j GROUP BY 1, 2)
SELECT entity, month_idx, CAST(n AS BIGINT) AS n, CAST(n_all - n AS BIGINT) AS n_out, CAST(n * (n - 1) / 2 AS BIGINT) AS own_pairs, CAST((n_all - n) * (n_all - n - 1) / 2 AS BIGINT) AS out_pairs, CAST(n * n_all AS BIGINT) AS invall_pairs,
CASE WHEN n >= 2 THEN round((1 + ((ss - n) / 2) / (n * (n - 1) / 2)) / 2, 6) END AS own_sim, CASE WHEN n_all - n >= 2 THEN round((1 + ((oo - (n_all - n)) / 2) / ((n_all - n) * (n_all - n - 1) / 2)) / 2, 6) END AS out_sim,
CASE WHEN n > 0 THEN round((1 + sa / (n * n_all)) / 2, 6) END AS invall_sim FROM g"""


def _similarities(n: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = vectors.lagged_sums(panels._vector_months(spark, sf), panels.DIMS, n, 1)
        s = vectors.with_pairs(vectors.similarities(w, panels.DIMS, ["month_idx"]))
        return s.select("entity", "month_idx", "n", "n_out", "own_pairs", "out_pairs", "invall_pairs", "own_sim", "out_sim", "invall_sim")

    run.__doc__ = f"Similarities over windows of {n} months with their numbers of vectors and pairs."
    query(_similarity_sql(n), f"vec_window_sims_{n}m")(run)


for _n in (1, 3, 6, 12):
    _similarities(_n)
