"""Queries over the generic tables: panels, registers, words, advisories, dates and names, lookups, vectors; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, text
from ..operators import advisory, embedding, lookup, panel, registers, tokens, vectors
from ..session import small
from ..sources.tables import table
from ..streaming import monthly

FIRST, LAST = 1995 * 12 + 1, 2001 * 12 + 12
MEASURES = ["n_orders", "cents"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


# --- entity-months -------------------------------------------------------------------------------------------------------------------

def _entity(fine: bool):
    """Nations, or nations by market segment, whose months have gaps."""
    return F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment") if fine else F.col("c_nationkey")


def _orders(spark: SparkSession, sf: str, fine: bool = False) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", _entity(fine).alias("entity"))
    d = o.join(c, o.o_custkey == c.c_custkey)
    return d.select("entity", dates.month_idx(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_idx"), "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def _facts(spark: SparkSession, sf: str, fine: bool = False) -> DataFrame:
    return _orders(spark, sf, fine).groupBy("entity", "month_idx").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("cents").alias("cents"))


def _panel(spark: SparkSession, sf: str, fine: bool = False, fill: int | None = None) -> DataFrame:
    entities = table(spark, sf, "customer").select(_entity(True).alias("entity")) if fine else table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"))
    return panel.dense(_facts(spark, sf, fine), entities, FIRST, LAST, MEASURES, fill)


def _entity_sql(fine: bool) -> str:
    return "c_nationkey || '/' || c_mktsegment" if fine else "c_nationkey"


def _facts_sql(fine: bool = False) -> str:
    return f"""facts AS (
  SELECT {_entity_sql(fine)} AS entity, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_idx, count(*) AS n_orders,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _panel_sql(fine: bool = False) -> str:
    entities = f"(SELECT DISTINCT {_entity_sql(True)} AS entity FROM customer)" if fine else "(SELECT n_nationkey AS entity FROM nation)"
    return f"""{_facts_sql(fine)},
panel AS (
  SELECT e.entity, CAST(m.m AS INTEGER) AS month_idx, f.n_orders, f.cents
  FROM {entities} e CROSS JOIN (SELECT unnest(range({FIRST}, {LAST + 1})) AS m) m LEFT JOIN facts f ON f.entity = e.entity AND f.month_idx = m.m)"""


@query(f"WITH {_facts_sql()} SELECT entity, month_idx, n_orders, cents FROM facts")
def entity_month_counts(spark, sf):
    return _facts(spark, sf)


@query(f"WITH {_panel_sql()} SELECT entity, month_idx, coalesce(n_orders, 0) AS n_orders, coalesce(cents, 0) AS cents FROM panel")
def dense_panel(spark, sf):
    return _panel(spark, sf, fill=0)


@query(f"""WITH {_panel_sql(True)}
SELECT *, CAST(sum(n_orders) OVER w AS BIGINT) AS n_orders_all, CAST(sum(n_orders) OVER w - coalesce(n_orders, 0) AS BIGINT) AS n_orders_out,
  CAST(sum(cents) OVER w AS BIGINT) AS cents_all, CAST(sum(cents) OVER w - coalesce(cents, 0) AS BIGINT) AS cents_out
FROM panel WINDOW w AS (PARTITION BY month_idx)""")
def own_out_all(spark, sf):
    return panel.own_out_all(_panel(spark, sf, True), MEASURES)


def _window_sql(n: int, lag: int, measures=MEASURES) -> str:
    w = f"(PARTITION BY entity ORDER BY month_idx RANGE BETWEEN {n + lag - 1} PRECEDING AND {lag} PRECEDING)"
    return ", ".join(f"CASE WHEN count({c}) OVER {w} = {n} THEN CAST(sum({c}) OVER {w} AS BIGINT) END AS {c}_{n}m" for c in measures)


def _lag_query(n: int, lag: int, name: str) -> None:
    sql = f"WITH {_panel_sql(True)} SELECT entity, month_idx, {_window_sql(n, lag)} FROM panel"
    query(sql, name)(lambda spark, sf: panel.lagged(_panel(spark, sf, True), MEASURES, [n], lag))


for _n in (1, 3, 6, 12):
    _lag_query(_n, 1, f"lag_sum_{_n}m")
_lag_query(3, 2, "lag_sum_lag2")


@query(f"""WITH {_panel_sql()},
x AS (SELECT *, count(n_orders) OVER w AS have, row_number() OVER (PARTITION BY entity ORDER BY month_idx) - 1 AS before, sum(n_orders) OVER w AS s FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY month_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, month_idx, CASE WHEN have = before AND before > 0 THEN CAST(s AS BIGINT) END AS n_orders_atime FROM x""")
def lag_sum_atime(spark, sf):
    return panel.lagged(_panel(spark, sf), ["n_orders"], [None], 1)


@query(f"""WITH {_panel_sql()}, o AS (SELECT *, sum(n_orders) OVER (PARTITION BY month_idx) AS n_all, sum(cents) OVER (PARTITION BY month_idx) AS c_all FROM panel),
x AS (SELECT entity, month_idx, {_window_sql(3, 1, ["n_orders", "cents", "n_all", "c_all"])} FROM o)
SELECT entity, month_idx, round(cents_3m / NULLIF(n_orders_3m, 0), 6) AS cents_per_order, round(cents_3m / NULLIF(c_all_3m, 0), 6) AS cents_share FROM x""")
def rolled_ratios(spark, sf):
    o = panel.own_out_all(_panel(spark, sf), MEASURES)
    w = panel.lagged(o, [*MEASURES, "cents_all"], [3], 1)
    return panel.ratios(w, {"cents_per_order": ("cents_3m", "n_orders_3m"), "cents_share": ("cents_3m", "cents_all_3m")}).select("entity", "month_idx", "cents_per_order", "cents_share")


@query(f"""WITH {_panel_sql(True)}, x AS (SELECT entity, month_idx, {_window_sql(3, 1)}, {_window_sql(12, 1)} FROM panel)
SELECT c AS column_name, CAST(n_null AS BIGINT) AS n_null, CAST(n_rows AS BIGINT) AS n_rows FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS n_null, count(*) AS n_rows FROM x" for c in ["entity", "month_idx", "n_orders_3m", "cents_3m", "n_orders_12m", "cents_12m"])})""")
def null_coverage(spark, sf):
    return panel.coverage(panel.lagged(_panel(spark, sf, True), MEASURES, [3, 12], 1))


@query(f"""WITH {_panel_sql(True)}, {", ".join(f"x{n} AS (SELECT entity, month_idx, {_window_sql(n, 1)} FROM panel)" for n in (1, 3, 6, 12))}
SELECT * FROM x1 FULL JOIN x3 USING (entity, month_idx) FULL JOIN x6 USING (entity, month_idx) FULL JOIN x12 USING (entity, month_idx)""")
def windows_united(spark, sf):
    p = _panel(spark, sf, True)
    return panel.united([panel.lagged(p, MEASURES, [n], 1) for n in (1, 3, 6, 12)], ["entity", "month_idx"])


@query("""SELECT c_nationkey AS entity, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS BIGINT) AS "1-URGENT", CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS BIGINT) AS "5-LOW" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def long_to_wide(spark, sf):
    o, c = table(spark, sf, "orders").select("o_custkey", "o_orderpriority"), table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    long = registers.counts(o.join(c, o.o_custkey == c.c_custkey), ["entity", "o_orderpriority"], "n")
    return panel.widened(long, ["entity"], "o_orderpriority", ["1-URGENT", "5-LOW"], "n")


# --- registers -----------------------------------------------------------------------------------------------------------------------

def _lines(spark: SparkSession, sf: str) -> DataFrame:
    ln = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    d = ln.join(s, ln.l_suppkey == s.s_suppkey)
    return d.select(F.col("s_nationkey").alias("entity"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.dayofmonth("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "R", "Accident").otherwise("Incident").alias("kind"))


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("entity", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"))


_EVENTS_SQL = """a AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT s_nationkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day, CASE WHEN l_returnflag = 'R' THEN 'Accident' ELSE 'Incident' END AS kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_KEYS = ["entity", "year", "month"]


@query(f"WITH {_EVENTS_SQL} SELECT entity, year, month, count(*) FILTER (kind = 'Incident') AS n_incidents, count(*) FILTER (kind = 'Accident') AS n_accidents FROM b GROUP BY 1, 2, 3")
def event_class_pivot(spark, sf):
    return registers.class_counts(_lines(spark, sf), _KEYS, "kind", {"n_incidents": "Incident", "n_accidents": "Accident"})


def _union(spark, sf):
    a = registers.counts(_order_days(spark, sf), _KEYS, "n_a")
    b = registers.class_counts(_lines(spark, sf), _KEYS, "kind", {"n_incidents": "Incident", "n_accidents": "Accident"})
    return registers.union_totals([a, b], _KEYS, ["n_a", "n_incidents", "n_accidents"])


_UNION_SQL = """u AS (SELECT entity, year, month, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_incidents) AS BIGINT) AS n_incidents, CAST(sum(n_accidents) AS BIGINT) AS n_accidents FROM (
  SELECT entity, year, month, 1 AS n_a, 0 AS n_incidents, 0 AS n_accidents FROM a UNION ALL SELECT entity, year, month, 0, CAST(kind = 'Incident' AS INTEGER), CAST(kind = 'Accident' AS INTEGER) FROM b) GROUP BY 1, 2, 3)"""


@query(f"WITH {_EVENTS_SQL}, {_UNION_SQL} SELECT *, n_a + n_incidents + n_accidents AS total FROM u")
def register_union_totals(spark, sf):
    return _union(spark, sf).withColumn("total", F.col("n_a") + F.col("n_incidents") + F.col("n_accidents"))


_OVERLAP_SQL = """o AS (SELECT x.entity, x.year, x.month, CAST(sum(least(x.n, y.n)) AS BIGINT) AS n_overlap FROM (SELECT entity, year, month, day, count(*) AS n FROM a GROUP BY ALL) x
  JOIN (SELECT entity, year, month, day, count(*) AS n FROM b GROUP BY ALL) y USING (entity, year, month, day) GROUP BY 1, 2, 3)"""


@query(f"WITH {_EVENTS_SQL}, {_OVERLAP_SQL} SELECT * FROM o")
def register_overlap(spark, sf):
    return registers.overlap(_order_days(spark, sf), _lines(spark, sf), [*_KEYS, "day"], _KEYS)


@query(f"WITH {_EVENTS_SQL}, {_UNION_SQL}, {_OVERLAP_SQL} SELECT u.*, coalesce(n_overlap, 0) AS n_overlap, n_a + n_incidents + n_accidents - coalesce(n_overlap, 0) AS total_nodups FROM u LEFT JOIN o USING (entity, year, month)")
def register_joined(spark, sf):
    shared = registers.overlap(_order_days(spark, sf), _lines(spark, sf), [*_KEYS, "day"], _KEYS)
    return registers.with_overlap(_union(spark, sf), shared, _KEYS).withColumn("total_nodups", F.col("n_a") + F.col("n_incidents") + F.col("n_accidents") - F.col("n_overlap"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def allowlist_semi(spark, sf):
    allow = table(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.allowed(table(spark, sf, "orders"), "o_custkey", allow).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def missing_anti(spark, sf):
    return lookup.missing(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT DISTINCT entity, year, month FROM (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders JOIN customer ON o_custkey = c_custkey)")
def distinct_entity_months(spark, sf):
    return _order_days(spark, sf).select(*_KEYS).distinct()


# --- words ---------------------------------------------------------------------------------------------------------------------------

_CLEAN_SQL = "list_filter(string_split(regexp_replace({}, '[[:punct:]]', ' ', 'g'), ' '), lambda x: x <> '')"
_SPACED_SQL = r"list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"), "source", "report_month")


@query(f"SELECT word, count(*) AS ct FROM (SELECT unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM documents) GROUP BY 1")
def token_counts(spark, sf):
    return tokens.word_counts(_docs(spark, sf), "text")


@query(f"SELECT word, count(*) AS ct FROM (SELECT unnest({_SPACED_SQL.format('t')}) AS word FROM (SELECT DISTINCT lower(text) AS t FROM documents)) GROUP BY 1")
def whitespace_counts_dedup(spark, sf):
    return tokens.word_counts(_docs(spark, sf), "text", clean=False, distinct_texts=True)


@query(f"SELECT source, report_month, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, round(avg(n), 6) AS avg_words FROM (SELECT source, report_month, coalesce(len({_CLEAN_SQL.format('lower(text)')}), 0) AS n FROM documents) GROUP BY 1, 2")
def doc_word_stats(spark, sf):
    return tokens.document_stats(_docs(spark, sf), ["source", "report_month"], "text")


# Small dictionaries in the words of the test texts.
DICTIONARIES = [
    ("nasa", "apch", "approach"), ("nasa", "rwy", "runway"), ("nasa", "hdg", "heading"), ("nasa", "flt", "flight"),
    ("faa", "twr", "tower"), ("faa", "acft", "aircraft"), ("faa", "tfc", "traffic"), ("faa", "rwy", "runway strip"),
    ("casa", "wx", "weather"), ("casa", "gs", "glide slope"), ("iata", "the", "teheran"), ("iata", "lag", "lagos"), ("iata", "flow", "flores"),
    ("hand", "maint", "maintenance"), ("hand", "atc", "air traffic control"), ("hand2", "fms", "flight management system"), ("hand2", "inbound", "coming in"),
]
STOP = ["the", "a", "an", "and", "of", "to", "in", "on", "was", "were", "at", "for", "by", "with", "that", "it"]
HAND_WORDS = ["callsign", "readback", "jumpseater"]
HAND_ABBREVS = ["gs", "maint"]
CATEGORIES = [("affect", "confusing"), ("affect", "sudden"), ("affect", "minor"), ("time", "after"), ("time", "before"), ("time", "minutes"), ("social", "captain"), ("social", "crew"), ("social", "controller"), ("time", "sudden")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)


def tagged_words(spark, sf, v):
    """The words of v with their full forms, flags and tags."""
    d = spark.createDataFrame(DICTIONARIES, "dict string, acronym string, fullform string")
    one = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    ref = table(spark, sf, "airport_reference")
    lists = {
        "english": tokens.word_counts(table(spark, sf, "eval_items").select(F.lower("text").alias("text")), "text").select("word"),
        "stop": one(STOP), "city": ref.select(F.explode(F.split(F.lower("city"), " ")).alias("word")), "airport": ref.select(F.lower("loc_id").alias("word")),
        "hand_word": one(HAND_WORDS), "hand_abbrev": one(HAND_ABBREVS),
    }
    return tokens.tagged(tokens.flags(tokens.with_dictionaries(v, d, ["nasa", "faa", "casa", "iata", "hand", "hand2"]), lists))


def _vocabulary(spark, sf):
    return tagged_words(spark, sf, tokens.word_counts(_docs(spark, sf), "text", clean=False, distinct_texts=True))


_TAG_SQL = f"""v AS (SELECT word, count(*) AS ct FROM (SELECT unnest({_SPACED_SQL.format('t')}) AS word FROM (SELECT DISTINCT lower(text) AS t FROM documents)) GROUP BY 1),
d(dict, acronym, fullform) AS (VALUES {_values(DICTIONARIES)}),
en AS (SELECT DISTINCT unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM eval_items),
ci AS (SELECT DISTINCT unnest(string_split(lower(city), ' ')) AS word FROM airport_reference),
f AS (SELECT word, ct, {", ".join(f"(SELECT min(fullform) FROM d WHERE acronym = word AND dict = '{k}') AS {k}" for k in ("nasa", "faa", "casa", "iata", "hand", "hand2"))},
  word IN (SELECT word FROM en) AS english, word IN ({", ".join(f"'{w}'" for w in STOP)}) AS stop, word IN (SELECT word FROM ci) AS city, word IN (SELECT lower(loc_id) FROM airport_reference) AS airport,
  word IN ({", ".join(f"'{w}'" for w in HAND_WORDS)}) AS hand_word, word IN ({", ".join(f"'{w}'" for w in HAND_ABBREVS)}) AS hand_abbrev FROM v),
g AS (SELECT word, ct, lower(coalesce(nasa, faa, casa, hand, iata)) AS fullform, CASE
  WHEN coalesce(nasa, faa, casa, iata, hand) IS NULL THEN CASE WHEN hand2 IS NOT NULL THEN '' WHEN stop THEN 'neg_stopword' WHEN english THEN 'neg_word' WHEN city THEN 'neg_nonword_city_exception'
    WHEN regexp_matches(word, '[^A-Za-z]') THEN 'neg_nonalpha_abrev' WHEN airport THEN 'neg_airport' WHEN hand_word THEN 'neg_word_hand2' ELSE 'neg_nonword' END
  WHEN english AND NOT stop AND iata IS NOT NULL AND casa IS NULL AND faa IS NULL THEN 'pos_iata_only_words' WHEN hand_abbrev THEN 'pos_handcoded_abrev' WHEN stop THEN 'pos_stopword'
  WHEN NOT english THEN 'pos_nonword' ELSE 'pos_word' END AS tag FROM f),
t AS (SELECT *, CAST(tag IN ('neg_nonword', 'pos_handcoded_abrev', 'pos_nonword') AS INTEGER) AS abrev FROM g)"""


@query(f"WITH {_TAG_SQL} SELECT word, ct, tag, abrev FROM t")
def word_tags(spark, sf):
    return _vocabulary(spark, sf).select("word", "ct", "tag", "abrev")


@query(f"WITH {_TAG_SQL}, s AS (SELECT tag, sum(ct) AS ct, count(*) AS n_unique FROM t GROUP BY 1) SELECT tag, CAST(ct AS BIGINT) AS ct, n_unique, round(ct / sum(ct) OVER (), 6) AS share, round(n_unique / sum(n_unique) OVER (), 6) AS share_unique FROM s")
def tag_summary(spark, sf):
    return tokens.tag_summary(_vocabulary(spark, sf))


DICTS = ["nasa", "faa", "casa", "iata", "hand", "hand2"]


@query(f"WITH {_TAG_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS dict, CAST(coalesce(sum(ct), 0) AS BIGINT) AS ct, count(*) AS n_unique FROM f WHERE coalesce({c}) IS NOT NULL" for n, c in [*((d, f"{d}, NULL") for d in DICTS), ("any", ", ".join(DICTS))]))
def dictionary_summary(spark, sf):
    return tokens.dictionary_summary(_vocabulary(spark, sf), DICTS)


@query(f"WITH {_TAG_SQL}, k AS (SELECT f.*, t.tag, t.abrev FROM f JOIN t USING (word)) SELECT 'abrvs' AS dict, word FROM k WHERE abrev = 1 UNION ALL SELECT 'pos_nonword', word FROM k WHERE tag = 'pos_nonword' " + " ".join(f"UNION ALL SELECT '{d}', word FROM k WHERE abrev = 1 AND {d} IS NOT NULL" for d in DICTS))
def dictionary_sets(spark, sf):
    return tokens.dictionary_sets(_vocabulary(spark, sf), DICTS)


@query(f"""WITH {_TAG_SQL}, r AS (SELECT word, fullform FROM t WHERE abrev = 1 AND fullform IS NOT NULL), w AS (SELECT source, unnest({_SPACED_SQL.format('lower(text)')}) AS word FROM documents),
x AS (SELECT source, unnest(string_split(coalesce(fullform, w.word), ' ')) AS word FROM w LEFT JOIN r ON r.word = w.word), c(category, word) AS (VALUES {_values(CATEGORIES)})
SELECT source, category, count(*) AS n_words FROM x JOIN c ON c.word = x.word GROUP BY 1, 2""")
def category_counts_expanded(spark, sf):
    d = tokens.expanded(_docs(spark, sf), "text", tokens.replacements(_vocabulary(spark, sf)), "full")
    counts = tokens.word_counts(d, "full", ["source"], clean=False)
    return tokens.dictionary_counts(counts, ["source"], spark.createDataFrame(CATEGORIES, "category string, word string"), "category").select("source", "category", "n_words")


@query(f"""WITH {_TAG_SQL}, r AS (SELECT word, fullform FROM t WHERE abrev = 1 AND fullform IS NOT NULL),
w AS (SELECT doc_id, unnest({_SPACED_SQL.format('lower(text)')}) AS word, unnest(range(len({_SPACED_SQL.format('lower(text)')}))) AS pos FROM documents)
SELECT d.doc_id, coalesce(x.s, '') AS expanded FROM documents d LEFT JOIN (SELECT doc_id, string_agg(coalesce(fullform, w.word), ' ' ORDER BY pos) AS s FROM w LEFT JOIN r ON r.word = w.word GROUP BY 1) x ON x.doc_id = d.doc_id WHERE d.text IS NOT NULL""")
def abbrev_expand(spark, sf):
    r = tokens.replacements(_vocabulary(spark, sf))
    return tokens.expanded(_docs(spark, sf).filter("text is not null"), "text", r, "expanded").select("doc_id", "expanded")


@query(f"""WITH v AS (SELECT source, unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM documents), c AS (SELECT source, word, count(*) AS ct FROM v GROUP BY 1, 2), d(dict, word, fullform) AS (VALUES {_values(DICTIONARIES)})
SELECT source, dict, CAST(sum(ct) AS BIGINT) AS n_words, count(DISTINCT c.word) AS n_unique FROM c JOIN (SELECT DISTINCT dict, word FROM d) x ON x.word = c.word GROUP BY 1, 2""")
def dictionary_counts(spark, sf):
    counts = tokens.word_counts(_docs(spark, sf), "text", ["source"])
    return tokens.dictionary_counts(counts, ["source"], spark.createDataFrame(DICTIONARIES, "dict string, word string, fullform string"))


@query(f"""WITH v AS (SELECT report_month, unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM documents), d(dict, word, fullform) AS (VALUES {_values(DICTIONARIES)})
SELECT report_month, dict, count(DISTINCT v.word) AS n_unique FROM v JOIN d ON d.word = v.word GROUP BY 1, 2""")
def dictionary_unique(spark, sf):
    counts = tokens.word_counts(_docs(spark, sf), "text", ["report_month"])
    return tokens.dictionary_counts(counts, ["report_month"], spark.createDataFrame(DICTIONARIES, "dict string, word string, fullform string")).select("report_month", "dict", "n_unique")


@query(f"""WITH v AS (SELECT source AS entity, CAST(report_month // 100 * 12 + report_month % 100 AS INTEGER) AS month_idx, unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM documents WHERE source IS NOT NULL AND report_month IS NOT NULL),
d(category, word) AS (VALUES {_values(CATEGORIES)}), c AS (SELECT entity, month_idx, category, count(*) AS n FROM v JOIN d ON d.word = v.word GROUP BY 1, 2, 3)
SELECT *, CAST(sum(n) OVER w AS BIGINT) AS n_all, CAST(sum(n) OVER w - n AS BIGINT) AS n_out, round(n / sum(n) OVER w, 6) AS share FROM c WINDOW w AS (PARTITION BY month_idx, category)""")
def category_counts_panel(spark, sf):
    d = _docs(spark, sf).filter("source is not null and report_month is not null").select(F.col("source").alias("entity"), dates.month_idx(*dates.yyyymm(F.col("report_month")).values()).alias("month_idx"), "text")
    categories = spark.createDataFrame(CATEGORIES, "category string, word string")
    c = tokens.dictionary_counts(tokens.word_counts(d, "text", ["entity", "month_idx"], only=categories), ["entity", "month_idx"], categories, "category").select("entity", "month_idx", "category", F.col("n_words").alias("n"))
    total = c.groupBy("month_idx", "category").agg(F.sum("n").alias("n_all"))
    return c.join(total, ["month_idx", "category"]).select("entity", "month_idx", "category", "n", "n_all", (F.col("n_all") - F.col("n")).alias("n_out"), F.round(F.col("n") / F.col("n_all"), 6).alias("share"))


@query(f"""WITH v AS (SELECT unnest({_SPACED_SQL.format('lower(text)')}) AS word FROM documents), c AS (SELECT word, count(*) AS ct FROM v GROUP BY 1)
SELECT {", ".join(f"round(sum(CASE WHEN regexp_matches(word, '{p.replace(chr(39), chr(39) * 2)}') THEN ct ELSE 0 END) / sum(ct), 6) AS pattern_{i + 1}" for i, p in enumerate(text.SHARE_PATTERNS))},
round(sum(CASE WHEN regexp_matches(word, '[^A-Za-z]') THEN ct ELSE 0 END) / sum(ct), 6) AS nonalpha FROM c""")
def nonalpha_share(spark, sf):
    return tokens.pattern_shares(tokens.word_counts(_docs(spark, sf), "text", clean=False))


@query(f"""WITH v AS (SELECT DISTINCT unnest({_SPACED_SQL.format('lower(text)')}) AS word FROM documents)
SELECT word, CASE {" ".join(f"WHEN regexp_matches(word, '{p.replace(chr(39), chr(39) * 2)}') THEN regexp_extract(word, '{p.replace(chr(39), chr(39) * 2)}', {g})" for p, g in text.CLEANING)} END AS cleaned FROM v""")
def cleaned_words(spark, sf):
    return tokens.word_counts(_docs(spark, sf), "text", clean=False).select("word", text.cleaned_word(F.col("word")).alias("cleaned"))


_MONTH_WORDS_SQL = f"v AS (SELECT DISTINCT source AS entity, CAST(report_month // 100 * 12 + report_month % 100 AS INTEGER) AS month_idx, unnest({_CLEAN_SQL.format('lower(text)')}) AS word FROM documents WHERE source IS NOT NULL AND report_month IS NOT NULL)"


def _month_words(spark, sf):
    d = _docs(spark, sf).filter("source is not null and report_month is not null").select(F.col("source").alias("entity"), dates.month_idx(*dates.yyyymm(F.col("report_month")).values()).alias("month_idx"), "text")
    return tokens.word_counts(d, "text", ["entity", "month_idx"])


@query(f"WITH {_MONTH_WORDS_SQL} SELECT month_idx, count(DISTINCT word) AS n_words FROM v GROUP BY 1")
def month_distinct_words(spark, sf):
    return _month_words(spark, sf).select("month_idx", "word").distinct().groupBy("month_idx").agg(F.count(F.lit(1)).alias("n_words"))


@query(f"WITH {_MONTH_WORDS_SQL} SELECT entity, month_idx, count(DISTINCT word) AS n_words FROM (SELECT entity, CAST(unnest(range(month_idx + 1, month_idx + 4)) AS INTEGER) AS month_idx, word FROM v) WHERE month_idx <= {2019 * 12 + 12} GROUP BY 1, 2")
def lag_distinct_words(spark, sf):
    return panel.lagged_distinct(_month_words(spark, sf), 3, 1, 2019 * 12 + 12)


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents")
def dup_flag(spark, sf):
    return lookup.duplicate_flag(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "duplicated")


@query()
def seeded_sample(spark, sf):
    return lookup.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 1000)


@query("SELECT acn, lower(coalesce(narrative, '') || ' ' || coalesce(callback, '') || ' ' || coalesce(synopsis, '')) AS joined_text, narrative IS NOT NULL AND callback IS NOT NULL AS both_there, narrative IS NOT NULL OR callback IS NOT NULL AS either_there FROM asrs_reports")
def report_texts(spark, sf):
    d = table(spark, sf, "asrs_reports")
    a, b = F.col("narrative").isNotNull(), F.col("callback").isNotNull()
    return d.select("acn", text.joined(F.col("narrative"), F.col("callback"), F.col("synopsis")).alias("joined_text"), (a & b).alias("both_there"), (a | b).alias("either_there"))


# --- advisories ----------------------------------------------------------------------------------------------------------------------

def _found(spark, sf):
    one = lookup.keep_first(table(spark, sf, "leftovers"), ["row_id"], [F.col("atcadvisory")])
    return one.select("row_id", F.coalesce("atcadvisory", F.lit("")).alias("text")).withColumn("found", advisory.facilities(F.col("text")))


_P = advisory.PATTERN
_FOUND_SQL = f"""l AS (SELECT DISTINCT row_id, coalesce(atcadvisory, '') AS text FROM leftovers),
x AS (SELECT row_id, unnest(regexp_extract_all(text, '{_P}', 1)) AS type, unnest(regexp_extract_all(text, '{_P}', 2)) AS code, coalesce(unnest(regexp_extract_all(text, '{_P}', 3)), '') AS suffix, unnest(range(len(regexp_extract_all(text, '{_P}', 1)))) AS pos FROM l)"""


@query(f"WITH {_FOUND_SQL} SELECT row_id, CAST(pos AS INTEGER) AS pos, type, code, suffix FROM x")
def advisory_extract(spark, sf):
    return _found(spark, sf).select("row_id", F.posexplode("found").alias("pos", "e")).select("row_id", "pos", "e.type", "e.code", "e.suffix")


@query(f"""WITH l AS (SELECT DISTINCT row_id, coalesce(atcadvisory, '') AS text FROM leftovers),
f AS (SELECT row_id, list_reduce(list_prepend(replace(replace(replace(text, ' ; ', ' '), '; ', ' '), ' ;', ' '), regexp_extract_all(text, '{_P}', 0)), lambda a, b: replace(a, b, '')) AS s FROM l),
r AS (SELECT row_id, CASE WHEN len(list_filter(string_split(s, ' '), lambda w: w NOT IN ('TRACON', 'Tower', ''))) = 0 THEN '' ELSE s END AS residue FROM f)
SELECT row_id, residue FROM r WHERE NOT regexp_full_match(residue, ' *\n?')""")
def advisory_residue(spark, sf):
    left = _found(spark, sf).select("row_id", advisory.residue(F.col("text"), F.col("found")).alias("residue"))
    return left.filter(~F.col("residue").rlike("^ *$"))


@query(f"WITH {_FOUND_SQL} SELECT code AS value, count(*) AS ct FROM x GROUP BY 1 ORDER BY ct DESC, value LIMIT 10")
def code_frequency(spark, sf):
    return advisory.frequency(_found(spark, sf), "found", "code").orderBy(F.desc("ct"), "value").limit(10)


@query(f"WITH {_FOUND_SQL} SELECT type AS value, count(*) AS ct FROM x GROUP BY 1")
def code_type_frequency(spark, sf):
    return advisory.frequency(_found(spark, sf), "found", "type")


@query(f"""WITH {_FOUND_SQL}, p AS (SELECT row_id, code, type, min(pos) AS pos FROM x GROUP BY 1, 2, 3)
SELECT row_id, code, arg_min(type, pos) AS ident_type, count(*) AS n_codes FROM p GROUP BY 1, 2 UNION ALL SELECT row_id, NULL, NULL, 0 FROM l WHERE row_id NOT IN (SELECT row_id FROM x)""")
def expand_entities(spark, sf):
    return advisory.per_code(_found(spark, sf), "row_id", "found")


@query(f"WITH {_FOUND_SQL}, p AS (SELECT DISTINCT row_id, code, type FROM x) SELECT row_id, {', '.join(f'''count(*) FILTER (type = '{t}') AS {t.lower().replace(' ', '_')}_ident_ct''' for t in advisory.TYPES)} FROM p GROUP BY 1")
def ident_counts(spark, sf):
    return advisory.type_counts(_found(spark, sf), "row_id", "found")


@query(f"""WITH {_FOUND_SQL} SELECT l.row_id, {", ".join(f"coalesce(max(type) FILTER (pos = {i}), '') AS atc_type{i}, coalesce(max(code) FILTER (pos = {i}), '') AS atc_code{i}, coalesce(max(suffix) FILTER (pos = {i}), '') <> '' AS atc_repeated{i}" for i in range(6))}
FROM l LEFT JOIN x USING (row_id) GROUP BY 1""")
def advisory_slots(spark, sf):
    return _found(spark, sf).select("row_id", *advisory.slots(F.col("found"), "atc"))


# --- dates, names, codes, lookups ----------------------------------------------------------------------------------------------------

_MON = ", ".join(f"'{m}'" for m in dates.MONTH_NAMES)


@query(f"""SELECT incident_id, received_ts, CASE WHEN len(p) = 3 THEN TRY_CAST(p[1] AS INTEGER) END AS day, CASE WHEN len(p) = 3 THEN CAST(nullif(list_position([{_MON}], upper(p[2])), 0) AS INTEGER) END AS month,
CASE WHEN len(p) = 3 THEN CASE WHEN TRY_CAST(p[3] AS INTEGER) BETWEEN 78 AND 99 THEN 1900 + TRY_CAST(p[3] AS INTEGER) WHEN TRY_CAST(p[3] AS INTEGER) < 78 THEN 2000 + TRY_CAST(p[3] AS INTEGER) ELSE TRY_CAST(p[3] AS INTEGER) END END AS year
FROM (SELECT incident_id, received_ts, string_split(localeventdate, '-') AS p FROM faa_incidents)""")
def two_digit_dates(spark, sf):
    return table(spark, sf, "faa_incidents").select("incident_id", "received_ts", *[c.alias(k) for k, c in dates.day_month_year(F.col("localeventdate")).items()])


@query("""SELECT ntsb_id, received_ts, CASE WHEN len(p) = 3 THEN TRY_CAST(p[1] AS INTEGER) END AS month, CASE WHEN len(p) = 3 THEN TRY_CAST(p[2] AS INTEGER) END AS day, CASE WHEN len(p) = 3 THEN TRY_CAST(p[3] AS INTEGER) END AS year
FROM (SELECT ntsb_id, received_ts, string_split(event_date, '/') AS p FROM ntsb_incidents)""")
def slash_dates(spark, sf):
    return table(spark, sf, "ntsb_incidents").select("ntsb_id", "received_ts", *[c.alias(k) for k, c in dates.slashed(F.col("event_date")).items()])


def _full_sql(words: str) -> str:
    cases = " ".join("WHEN '" + k + "' THEN [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in names.FULL_WORDS.items())
    return f"flatten(list_transform({words}, lambda w: CASE w {cases} ELSE [w] END))"


_NAME_SQL = rf"""list_transform(list_filter({_full_sql("string_split(lower(eventairport), ' ')")}, lambda w: w <> '-'), lambda w: regexp_replace(regexp_replace(w, '^[(/]', ''), '[)/,\-]$', ''))"""
_PAIR_SQL = rf"""flatten(list_transform({_NAME_SQL}, lambda w: CASE WHEN regexp_matches(w, '^[a-z]+[-/][a-z]+') THEN [regexp_extract(w, '^([a-z]+)[-/]([a-z]+)', 1), regexp_extract(w, '^([a-z]+)[-/]([a-z]+)', 2)] ELSE [w] END))"""


@query(f"SELECT incident_id, received_ts, array_to_string({_full_sql(_PAIR_SQL)}, ' ') AS clean_name FROM faa_incidents")
def name_clean(spark, sf):
    return table(spark, sf, "faa_incidents").select("incident_id", "received_ts", names.clean_name(F.col("eventairport")).alias("clean_name"))


@query("""SELECT ntsb_id, received_ts, CASE WHEN len(p) IN (2, 3) THEN lower(trim(p[1])) END AS city, CASE WHEN len(p) IN (2, 3) THEN lower(trim(p[2])) END AS state, CASE WHEN len(p) = 3 THEN lower(trim(p[3])) END AS country
FROM (SELECT ntsb_id, received_ts, string_split(location_text, ',') AS p FROM ntsb_incidents)""")
def location_parts(spark, sf):
    return table(spark, sf, "ntsb_incidents").select("ntsb_id", "received_ts", *[c.alias(k) for k, c in names.place_parts(F.col("location_text")).items()])


@query("""SELECT ntsb_id, received_ts, code, CASE WHEN length(code) = 4 AND code[1] = 'K' THEN code[2:] ELSE code END AS short_code, round(TRY_CAST(trim(latitude) AS DOUBLE), 5) AS lat, round(TRY_CAST(trim(longitude) AS DOUBLE), 5) AS lon
FROM (SELECT *, nullif(upper(trim(replace(replace(replace(lower(trim(airport_code)), 'n/a', ''), 'none', ''), 'na', ''))), '') AS code FROM ntsb_incidents)""")
def code_cleaning(spark, sf):
    d = table(spark, sf, "ntsb_incidents").withColumn("code", names.clean_code(F.col("airport_code")))
    return d.select("ntsb_id", "received_ts", "code", names.short_code(F.col("code")).alias("short_code"), names.coordinate(F.col("latitude")).alias("lat"), names.coordinate(F.col("longitude")).alias("lon"))


FIRST_NAMES = [("Brand#1", "one"), ("Brand#2", "two")]
SECOND_NAMES = [("Brand#2", "zwei"), ("Brand#3", "drei")]


@query(f"""WITH a(k, v) AS (VALUES {_values(FIRST_NAMES)}), b(k, v) AS (VALUES {_values(SECOND_NAMES)})
SELECT p_partkey, coalesce(b.v, a.v, p_brand) AS label FROM part LEFT JOIN a ON a.k = left(p_brand, 7) LEFT JOIN b ON b.k = left(p_brand, 7)""")
def lookup_priority(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_brand", F.substring("p_brand", 1, 7).alias("k"))
    d = lookup.lookup(d, "k", spark.createDataFrame(FIRST_NAMES, "a string, v string"), "a", "v", "first")
    d = lookup.lookup(d, "k", spark.createDataFrame(SECOND_NAMES, "a string, v string"), "a", "v", "second")
    return d.select("p_partkey", F.coalesce("second", "first", "p_brand").alias("label"))


OVERRIDES = [(1, 1, "early"), (2, 1, "late"), (3, 5, "?"), (4, 7, "seven"), (5, 7, "?")]


@query("WITH o(ord, p_size, v) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in OVERRIDES) + """), l AS (SELECT p_size, v FROM o WHERE v <> '?' QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY ord DESC) = 1)
SELECT p_partkey, coalesce(l.v, p_type) AS label FROM part LEFT JOIN l USING (p_size)""")
def override_last_wins(spark, sf):
    o = spark.createDataFrame(OVERRIDES, "ord int, p_size int, v string")
    d = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_type").alias("label"))
    return lookup.override(d, ["p_size"], o, "v", "ord", "label").select("p_partkey", "label")


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def keep_first(spark, sf):
    return lookup.keep_first(table(spark, sf, "part"), ["p_brand"], [F.col("p_partkey")]).select("p_brand", "p_partkey", "p_name")


@query("SELECT count(*) AS n_rows, count(*) FILTER (airport_code IS NOT NULL) AS with_code, count(*) FILTER (airport_name IS NOT NULL) AS with_name, count(*) FILTER (airport_code IS NULL AND airport_name IS NULL) AS with_neither FROM ntsb_incidents")
def register_statistics(spark, sf):
    c, n = F.col("airport_code").isNotNull(), F.col("airport_name").isNotNull()
    return registers.statistics(table(spark, sf, "ntsb_incidents"), {"with_code": c, "with_name": n, "with_neither": ~c & ~n})


@query("SELECT entity || ' ' || y || '/' || m AS packed, entity, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM (SELECT DISTINCT n_name AS entity, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)")
def packed_keys(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"), "n_name")
    d = _order_days(spark, sf).select(*_KEYS).distinct().join(small(n), "entity")
    d = d.select(F.concat("n_name", F.lit(" "), F.col("year").cast("string"), F.lit("/"), F.col("month").cast("string")).alias("packed"))
    return d.select("packed", *[c.alias(k) for k, c in dates.entity_month(F.col("packed")).items()])


# --- vectors -------------------------------------------------------------------------------------------------------------------------

DIMS = 64


def _sums(spark, sf):
    return vectors.unit_sums(table(spark, sf, "embeddings").withColumnRenamed("label", "entity"), ["entity"], "embedding", DIMS)


_VEC_SQL = """u AS (SELECT vec_id, label AS entity, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS e FROM embeddings),
x AS (SELECT vec_id, entity, unnest(e) AS v, unnest(range(len(e))) AS j FROM u)"""
_GROUPS_SQL = f"""{_VEC_SQL}, s AS (SELECT entity, j, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2), a AS (SELECT j, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
g AS (SELECT entity, max(s.n) AS n, max(a.n) AS n_all, sum(s.s * s.s) AS ss, sum(s.s * a.s) AS sa, sum((a.s - s.s) * (a.s - s.s)) AS oo FROM s JOIN a USING (j) GROUP BY 1)"""


@query(f"WITH {_GROUPS_SQL} SELECT entity, round((1 + ((ss - n) / 2) / (n * (n - 1) / 2)) / 2, 6) AS own_sim FROM g")
def vec_own_sim(spark, sf):
    return vectors.similarities(_sums(spark, sf), DIMS).select("entity", "own_sim")


@query(f"WITH {_GROUPS_SQL} SELECT entity, round((1 + sa / (n * n_all)) / 2, 6) AS invall_sim, round((1 + (sa - ss) / (n * (n_all - n))) / 2, 6) AS invout_sim FROM g")
def vec_invall_sim(spark, sf):
    return vectors.similarities(_sums(spark, sf), DIMS).select("entity", "invall_sim", "invout_sim")


@query(f"WITH {_GROUPS_SQL} SELECT entity, CAST(n_all - n AS BIGINT) AS n_out, round((1 + ((oo - (n_all - n)) / 2) / ((n_all - n) * (n_all - n - 1) / 2)) / 2, 6) AS out_sim FROM g")
def vec_out_sim(spark, sf):
    return vectors.similarities(_sums(spark, sf), DIMS).select("entity", "n_out", "out_sim")


def _vector_months(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("entity"), (F.col("vec_id") % 12).cast("int").alias("month_idx"), "embedding")
    sums = vectors.unit_sums(e, ["entity", "month_idx"], "embedding", DIMS)
    grid = e.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("month_idx"))
    zero = F.array(*[F.lit(0.0)] * DIMS)
    return grid.join(sums, ["entity", "month_idx"], "left").select("entity", "month_idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", zero).alias("s"))


@query(f"""WITH {_VEC_SQL}, s AS (SELECT entity, CAST(vec_id % 12 AS INTEGER) AS month_idx, j, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2, 3),
gr AS (SELECT entity, CAST(m AS INTEGER) AS month_idx, j FROM (SELECT DISTINCT label AS entity FROM embeddings) CROSS JOIN (SELECT unnest(range(12)) AS m) CROSS JOIN (SELECT unnest(range({DIMS})) AS j)),
w AS (SELECT entity, month_idx, j, sum(coalesce(s, 0)) OVER f AS s, sum(coalesce(n, 0)) OVER f AS n FROM gr LEFT JOIN s USING (entity, month_idx, j) WINDOW f AS (PARTITION BY entity, j ORDER BY month_idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
g AS (SELECT entity, month_idx, coalesce(max(n), 0) AS n, sum(s * s) AS ss FROM w GROUP BY 1, 2)
SELECT entity, month_idx, CAST(n AS BIGINT) AS n, CASE WHEN n >= 2 THEN round((1 + ((ss - n) / 2) / (n * (n - 1) / 2)) / 2, 6) END AS own_sim FROM g""")
def vec_lag_sim(spark, sf):
    w = vectors.lagged_sums(_vector_months(spark, sf), DIMS, 3, 1)
    return vectors.similarities(w, DIMS, ["month_idx"]).select("entity", "month_idx", "n", "own_sim")


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def report_pair_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("SELECT md5(text) AS text_id, count(*) AS n_rows FROM documents GROUP BY 1")
def document_ids(spark, sf):
    return embedding.document_ids(table(spark, sf, "documents"), "text")


@query()
def trained_similarity(spark, sf):
    """Own, outside and overall similarity of sources by word vectors trained on all texts."""
    d = _docs(spark, sf).filter("source is not null").select(F.col("source").alias("entity"), "text")
    v = embedding.document_vectors(d, "text", embedding.trained(d, "text"))
    return vectors.similarities(vectors.unit_sums(v, ["entity"], "vector", 20), 20)


_CODES_SQL = "a AS (SELECT DISTINCT tracon_code AS code FROM faa_incidents WHERE tracon_code IS NOT NULL), b AS (SELECT DISTINCT facility_code AS code FROM asrs_reports WHERE facility_code IS NOT NULL)"


@query(f"WITH {_CODES_SQL} SELECT 'union' AS what, code FROM (SELECT code FROM a UNION SELECT code FROM b) UNION ALL SELECT 'both', code FROM (SELECT code FROM a INTERSECT SELECT code FROM b) UNION ALL SELECT 'first only', code FROM (SELECT code FROM a EXCEPT SELECT code FROM b)")
def code_sets(spark, sf):
    a = table(spark, sf, "faa_incidents").select(F.col("tracon_code").alias("code")).filter("code is not null").distinct()
    b = table(spark, sf, "asrs_reports").select(F.col("facility_code").alias("code")).filter("code is not null").distinct()
    named = lambda df, what: df.select(F.lit(what).alias("what"), "code")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "both")).union(named(a.subtract(b), "first only"))


# --- events --------------------------------------------------------------------------------------------------------------------------

@query("SELECT user_id AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n_events FROM events GROUP BY 1, 2")
def daily_event_counts(spark, sf):
    return monthly.windowed_counts(table(spark, sf, "events"), "user_id", "ts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
