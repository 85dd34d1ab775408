"""The queries of this subpackage over the project's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, small
from ..sources.tables import table
from ..operators.timestamps import latest, normalised, with_zone
from . import canonical, leakage, linkage, lookalike, packing, termfreq


def airports(spark: SparkSession, sf: str) -> DataFrame:
    """airport_reference as a list of entries."""
    return table(spark, sf, "airport_reference").select(F.col("loc_id").alias("id"), F.col("airport_name").alias("name"), "city", F.col("state_code").alias("state"), F.col("full_state"), "loc_id", "icao", "latitude", "longitude")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "faa_incidents"), "incident_id", "received_ts", ["eventairport_conv", "eventcity", "eventstate"])
    rows = rows.filter("coalesce(eventairport_conv, eventcity, eventstate) is not null")
    listed = table(spark, sf, "airport_reference").select(F.col("airport_name").alias("eventairport_conv"), F.col("city").alias("eventcity"), F.col("state_code").alias("eventstate"))
    rows = rows.join(small(listed), ["eventairport_conv", "eventcity", "eventstate"], "left_anti")
    got = canonical.map_to_entries(rows, "eventairport_conv", "eventcity", "eventstate", airports(spark, sf), ["loc_id", "icao"], keep=["incident_id"])
    return got.select("incident_id", F.coalesce("entry_id", F.lit("NONE")).alias("loc_id"))


def p1_unmatched_values(spark: SparkSession, sf: str) -> DataFrame:
    """How often each typed airport came out as unlisted."""
    rows = latest(table(spark, sf, "faa_incidents"), "incident_id", "received_ts", ["eventairport_conv", "eventcity", "eventstate"])
    got = canonical.map_to_entries(rows, "eventairport_conv", "eventcity", "eventstate", airports(spark, sf), ["loc_id", "icao"], keep=["eventairport_conv"])
    return got.filter("entry_id is null").groupBy("eventairport_conv").agg(F.count(F.lit(1)).alias("n_records"))


# Short forms of flight phases.
PHASES = {"clb": "climb", "tof": "takeoff", "ldg": "landing", "txi": "taxi", "std": "standing", "crz": "cruise", "enroute": "cruise", "dst": "descent", "apr": "approach"}


def _attributes(rows: DataFrame) -> DataFrame:
    """What both registers say in the same way: tail, make, model, phase; empty is null."""
    none = lambda c: F.nullif(c, F.lit(""))
    model = F.trim(F.regexp_replace(F.lower("acft_model"), "[^a-z0-9]+", " "))
    phase = F.lower(F.trim("flight_phase"))
    short = F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumns({
        "tail": none(F.regexp_replace(F.upper("tail_mark"), "[^A-Z0-9*]", "")),
        "make": none(F.substring_index(model, " ", 1)),
        "model": F.when(model.contains(" "), F.substring_index(model, " ", -1)),
        "phase": none(F.coalesce(F.try_element_at(short, phase), phase)),
    })


def _pair_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both registers in the columns that linkage compares; their times and places are read in one go."""
    ref, offices = airports(spark, sf), table(spark, sf, "field_offices")
    cols = ["acft_model", "tail_mark", "flight_phase", "persons_aboard", "office_code"]
    a = latest(table(spark, sf, "faa_incidents"), "incident_id", "received_ts", ["localeventdate", "eventairport_conv", "eventcity", "eventstate", "tracon_code", *cols])
    none = F.lit(None).cast("string")
    a = a.select(F.lit(0).alias("side"), F.col("incident_id").alias("id"), F.col("localeventdate").alias("date"), F.col("eventairport_conv").alias("name"), F.col("eventcity").alias("city"), F.col("eventstate").alias("state"), F.col("tracon_code").alias("code"), none.alias("latitude"), none.alias("longitude"), *cols)
    b = latest(table(spark, sf, "ntsb_incidents"), "ntsb_id", "received_ts", ["airport_code", "airport_name", "latitude", "longitude", "location_text", "event_date", *cols])
    where = F.split("location_text", ",")
    b = b.select(F.lit(1).alias("side"), F.col("ntsb_id").alias("id"), F.col("event_date").alias("date"), F.col("airport_name").alias("name"), F.trim(F.try_element_at(where, F.lit(1))).alias("city"), F.trim(F.try_element_at(where, F.lit(2))).alias("state"), F.col("airport_code").alias("code"), "latitude", "longitude", *cols)
    both = settled(normalised(with_zone(a.unionByName(b), "office_code", offices, "office_code", "tz_name"), "date", "tz_of_row"))
    both = canonical.map_to_entries(both, "name", "city", "state", ref, ["loc_id", "icao"], keep=["side", "id", "local_day", "code", "latitude", "longitude", *cols])
    codes = ref.select("loc_id", F.explode(F.array("loc_id", "icao")).alias("_code")).groupBy("_code").agg(F.min("loc_id").alias("loc_id"))
    both = both.withColumn("_code", F.when(F.col("side") == 1, F.upper(F.trim("code")))).join(small(codes), "_code", "left")
    # register A gives a code only where it found the airport as listed
    both = both.withColumn("loc", F.coalesce(F.when(F.col("side") == 0, F.col("code")), "loc_id", "entry_id")).drop("loc_id")
    places = small(ref.select(F.col("loc_id").alias("loc"), F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon"), F.col("state").alias("state_of")))
    both = _attributes(both.join(places, "loc", "left")).withColumns({"lat": F.coalesce(F.trim("latitude").try_cast("double"), "ref_lat"), "lon": F.coalesce(F.trim("longitude").try_cast("double"), "ref_lon")})
    out = ["side", "id", F.unix_date("local_day").alias("day"), "loc", F.col("state_of").alias("state"), "lat", "lon", "tail", "make", "model", "phase", F.col("persons_aboard").alias("persons"), F.col("office_code").alias("office")]
    both = settled(both.select(*out))
    return both.filter("side = 0").drop("side"), both.filter("side = 1").drop("side")


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    """Linked records of the two registers with the confidence of each link."""
    a, b = _pair_sides(spark, sf)
    return linkage.linked(a, b).select(F.col("a_id").alias("incident_id"), F.col("b_id").alias("ntsb_id"), "confidence")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_links(spark, sf).select("incident_id", "ntsb_id")


TEXT_FIELDS = ["narrative", "synopsis", "combined"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return termfreq.term_frequencies(table(spark, sf, "asrs_reports"), "acn", TEXT_FIELDS).filter("freq_mark is not null").select("field_name", "term", "freq_mark")


def p2_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of the three fields with its counts."""
    return termfreq.term_frequencies(table(spark, sf, "asrs_reports"), "acn", TEXT_FIELDS).select("field_name", "term", "n_occurrences", "n_records")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, in pieces where it is longer than a container, with its container of 2,048 tokens."""
    sizes = packing.token_counts(table(spark, sf, "documents"), "doc_id", "text")
    return packing.fill(sizes, "doc_id", "n_tokens")


def p8_fill_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers are full to which tenth."""
    used = p8_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.groupBy(F.floor(F.col("used") * 10 / packing.CAPACITY).alias("tenths_full")).agg(F.count(F.lit(1)).alias("n_containers"), F.sum(packing.CAPACITY - F.col("used")).alias("unused_tokens"))


def p8_fill_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, those assigned, tokens, those assigned, containers above capacity, documents divided without need, divided ones whose pieces aren't as few as can be."""
    sizes = settled(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    placed = settled(packing.fill(sizes, "doc_id", "n_tokens"))
    cap = F.lit(packing.CAPACITY)
    over = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > cap).alias("n_over_capacity"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    per = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t"))
    least = F.greatest(F.ceil(F.col("t") / cap), F.lit(1))
    each = per.agg(F.count(F.lit(1)).alias("n_assigned"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens_assigned"), F.count_if((F.col("t") <= cap) & (F.col("pieces") > 1)).alias("n_needless"), F.count_if(F.col("pieces") > least).alias("n_too_many_pieces"))
    scalars = lambda df: [df.select(c).scalar().alias(c) for c in df.columns]
    got = spark.range(1).select(*scalars(whole), *scalars(each), *scalars(over))
    return got.select("n_documents", (F.col("n_documents") - F.col("n_assigned")).alias("n_missing"), (F.col("n_tokens") - F.col("n_tokens_assigned")).alias("tokens_missing"), "n_over_capacity", "n_needless", "n_too_many_pieces")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text").select("item_id", "doc_id")


#: Where a public confusables.txt (UTS #39) is, if look-alikes beyond the built-in ones shall count.
CONFUSABLES = os.environ.get("CONFUSABLES_FILE")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_pairs(table(spark, sf, "documents"), "doc_id", "text", lookalike.confusables(CONFUSABLES)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_look_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document that shares its look with different characters, with its class."""
    return lookalike.look_classes(table(spark, sf, "documents"), "doc_id", "text", lookalike.confusables(CONFUSABLES))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched_values, p2_found, p2_term_frequencies, p5_found, p5_links, p8_containers, p8_fill_report, p8_fill_checks, p9_found, p10_found, p10_look_classes)}

_TERMS_SQL = """
WITH one AS (SELECT * FROM asrs_reports QUALIFY row_number() OVER (PARTITION BY acn ORDER BY received_ts DESC) = 1),
f AS (
  SELECT 'narrative' AS field_name, acn, narrative AS t FROM one WHERE narrative IS NOT NULL
  UNION ALL SELECT 'synopsis', acn, synopsis FROM one WHERE synopsis IS NOT NULL
  UNION ALL SELECT 'combined', acn, combined FROM one WHERE combined IS NOT NULL),
n AS (SELECT field_name, count(*) AS n_all FROM f GROUP BY 1),
w AS (
  SELECT field_name, acn, unnest(list_filter(string_split_regex(regexp_replace(lower(t), '[[:punct:]]', ' ', 'g'), '[\\s\\x{a0}\\x{2007}\\x{2009}\\x{202f}\\x{3000}\\x0b]+'), lambda x: x <> '')) AS term FROM f),
c AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT acn) AS n_records FROM w GROUP BY 1, 2)
"""

ORACLE: dict[str, str] = {
    "p8_fill_checks": "SELECT count(*) AS n_documents, 0 AS n_missing, 0 AS tokens_missing, 0 AS n_over_capacity, 0 AS n_needless, 0 AS n_too_many_pieces FROM documents",
    "p2_found": _TERMS_SQL + "SELECT c.field_name, term, CASE WHEN n_records < 3 THEN 'rare' ELSE 'common' END AS freq_mark FROM c JOIN n ON c.field_name = n.field_name WHERE n_records < 3 OR n_records > 0.4 * n_all",
    "p2_term_frequencies": _TERMS_SQL + "SELECT field_name, term, CAST(n_occurrences AS BIGINT) AS n_occurrences, CAST(n_records AS BIGINT) AS n_records FROM c",
}
