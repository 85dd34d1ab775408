"""Session set-up and what operators share about the running cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No table above so many rows, or so many characters and bytes, is ever broadcast by a hint of ours.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("monthloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they are started in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for reliable checkpoints; a temporary one is set only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="monthloom_")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder; later reads don't recompute it and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df as compressed columns in the shared folder, for tables of which each reader needs some columns; removed at the end, so what is made of it must be settled by then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _is_small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows, of at most BROADCAST_BYTES together; what is measured stops at the limit."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    r = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()
    return r["n"] <= limit and r["b"] <= BROADCAST_BYTES


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count and a sum of sizes that stop at the limit prove it small; else df as it is, for a shuffled join."""
    return F.broadcast(df) if _is_small(df, BROADCAST_ROWS if limit is None else limit) else df



#: Parts over which the rows of one key are spread.
SALTS = 16


def spread_lookup(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows left-joined to found, which has one row a key: broadcast if proven small, else each key's rows are spread over SALTS parts, so that a key that very many rows share isn't one task."""
    if _is_small(found, BROADCAST_ROWS):
        return rows.join(F.broadcast(found), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))  # from the row itself, so that a task run again gives the same
    return salted.join(found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], "left").drop("_salt")
