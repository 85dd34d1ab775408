"""Sources: parquet tables, delimited text, legacy encodings, pages of links, ragged category lists."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], load_saved: bool = True) -> DataFrame:
    """The parquet table at path if there is one and load_saved holds; else the built one, written there first."""
    if load_saved:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType, *, sep: str = ",", encoding: str = "UTF-8", skip: str | None = None) -> DataFrame:
    """Delimited text with a header row and a declared schema; header names are trimmed by the schema's own. skip: a glob of file names left out of a folder. Encodings beyond the usual four (cp437 and the like) need the session's switch for legacy charsets, which is then set."""
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1", "utf-16"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if skip:
        df = df.filter(~F.element_at(F.split(F.input_file_name(), "/"), -1).like(skip.replace("*", "%")))
    return df


def csv_second_header(spark: SparkSession, path: str | list[str], schema: str | T.StructType, *, sep: str = ",") -> DataFrame:
    """Delimited text whose second row names the columns and whose first only groups them.

    The first row is the header to the reader; a row that holds just the column names is the second and is left out, wherever a split of the file begins. Values are cast to the schema; what can't be cast is null.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    rows = csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in fields]), sep=sep)
    named = F.coalesce(F.array(*[F.col(f"`{f.name}`") for f in fields]) == F.array(*[F.lit(f.name) for f in fields]), F.lit(False))
    return rows.filter(~named).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def excel(spark: SparkSession, path: str, schema: str | T.StructType, *, sheet: int = 1, skip_rows: int = 1) -> DataFrame:
    """A sheet of the .xlsx files at a path, one row per sheet row after the first skip_rows; columns by place, values cast to the schema, what can't be cast null.

    Each file is read by one task, as a workbook can't be split. Missing cells are null; formulas give their stored values; a workbook without the sheet gives no rows.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = [[r.get(i) for i in range(len(fields))] for r in _sheet_rows(raw, sheet)][skip_rows:]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(fields))], names=[f.name for f in fields])

    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, text).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def _sheet_rows(raw: bytes, sheet: int) -> list[dict[int, str]]:
    """The cells of a sheet's rows by their column's place."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    have = set(book.namelist())
    local = lambda e: e.tag.rpartition("}")[2]
    texts = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    shared = [texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in have else []
    name = f"xl/worksheets/sheet{sheet}.xml"
    out = []
    for row in ElementTree.fromstring(book.read(name)).iter() if name in have else []:
        if local(row) != "row":
            continue
        cells, at = {}, -1
        for c in row:
            letters = re.match("[A-Z]*", c.get("r") or "").group()
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else at + 1
            value = next((e.text for e in c if local(e) == "v"), None)
            if c.get("t") == "inlineStr":
                value = texts(c)
            elif c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            if value is not None:
                cells[at] = value
        out.append(cells)
    return out


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells): the rows of all tables of a page in order, from 0, with the texts of their cells; tags inside cells are taken out, white space made one blank. Null pages and rows without cells give none."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")), "&amp;", "&"), r"\s+", " "))
    cells = F.transform(F.regexp_extract_all(F.col("_r"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return rows.select(key, "row", cells.alias("cells")).filter(F.size("cells") > 0)


def link_words(pages: DataFrame, html: str, first: str, last: str) -> DataFrame:
    """The distinct lower-case words of a page's link texts between two texts, both included.

    Null pages and pages without both texts give no rows.
    """
    texts = pages.select(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<td[^>]*>\s*<a\b[^>]*>([^<]*)</a>"), F.lit(1)).alias("t"))
    a, b = F.array_position("t", F.lit(first)), F.array_position("t", F.lit(last))
    cut = F.when((a > 0) & (b >= a), F.slice("t", a.cast("int"), (b - a + 1).cast("int")))
    return texts.select(F.explode(cut).alias("t")).select(F.explode(F.split(F.lower(F.trim("t")), r"\s+")).alias("word")).filter("word != ''").distinct()


def ragged_groups(cells: DataFrame) -> DataFrame:
    """(category, word) from cells (col_idx, header, word): a group is the columns since the last header up to the column that names it.

    Columns after the last header belong to no group and are left out; null and empty words too.
    """
    heads = cells.select("col_idx", "header").distinct()
    w = Window.orderBy("col_idx").rowsBetween(1, Window.unboundedFollowing)
    named = heads.withColumn("category", F.first("header", ignorenulls=True).over(w))
    return cells.join(small(named.select("col_idx", "category")), "col_idx").filter(F.col("category").isNotNull() & F.col("word").isNotNull() & (F.col("word") != "")).select("category", "word").distinct()


def dictionary(df: DataFrame, name: str, acronym: str, fullform: str, ordinal: str | None = None, *, strip_parens: bool = False, first_only: bool = False) -> DataFrame:
    """(dict, acronym, fullform) of one dictionary table.

    Keys are trimmed; null keys and full forms are dropped; strip_parens removes a bracketed remark; first_only keeps the first row of a key by ordinal.
    """
    key: Column = F.trim(acronym)
    full: Column = F.trim(F.regexp_replace(fullform, r"\(.+\)", "")) if strip_parens else F.trim(fullform)
    out = df.select(F.lit(name).alias("dict"), F.lower(key).alias("acronym"), full.alias("fullform"), (F.col(ordinal) if ordinal else F.lit(0)).alias("ord")).filter("acronym is not null and acronym != '' and fullform is not null and fullform != ''")
    if first_only:
        w = Window.partitionBy("dict", "acronym").orderBy("ord", "fullform")
        out = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return out.drop("ord")


def flagged_words(df: DataFrame, word: str, flag: str) -> DataFrame:
    """The words whose annotation column is filled."""
    return df.filter(F.col(flag).isNotNull()).select(F.col(word).alias("word")).distinct()


def after_last_flag(df: DataFrame, ordinal: str, word: str, flags: list[str]) -> DataFrame:
    """The words after the last row that carries any annotation; all words if none does."""
    any_flag = F.greatest(*[F.col(c).isNotNull() for c in flags]) if len(flags) > 1 else F.col(flags[0]).isNotNull()
    last = df.agg(F.coalesce(F.max(F.when(any_flag, F.col(ordinal))), F.lit(-1)))
    return df.filter(F.col(ordinal) > last.scalar()).select(word)


def volume_report(lines: DataFrame, number_cols: list[str]) -> DataFrame:
    """Facility volumes with thousands separators taken out of the number columns; what isn't a number is null."""
    return lines.select(*[F.expr(f"try_cast(replace(trim(`{c}`), ',', '') as bigint)").alias(c) if c in number_cols else F.col(c) for c in lines.columns])
