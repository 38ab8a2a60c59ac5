"""Readers and writers: source texts, aligned keyword lists, nested JSON indexes, TOML changes, tables, text and CSV."""

from __future__ import annotations

import tempfile
import tomllib
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, source: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """Keyword rows from an aligned text: a header line, then a name and after two blanks or more an abbreviation."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value").where("seq > 0 and trim(value) <> ''")
    parts = F.split(F.trim("value"), " {2,}", 2)
    short = F.trim(F.get(parts, F.lit(1)))
    return lines.select("seq", F.trim(F.get(parts, F.lit(0))).alias("name"), F.lit(True).alias("reserved"), F.when(short != "", short).alias("min_abbreviation"), F.lit(None).cast("string").alias("keyword_type"), F.lit(None).cast("string").alias("doc_url"))


_ENTRY = "title string, url string, childEntries array<string>"


def json_index(spark: SparkSession, path: str) -> DataFrame:
    """title, url of every entry of a nested index (childEntries), of any depth: one level of explode after the other.

    An entry's children stay JSON texts until their level is reached.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_ENTRY}>>").alias("a"))
    level = whole.select(F.explode("a").alias("e")).select("e.*")
    out = level.where("title is not null").select("title", "url")
    while not (children := level.select(F.explode("childEntries").alias("c"))).isEmpty():
        level = children.select(F.from_json("c", _ENTRY).alias("e")).select("e.*")
        out = out.union(level.where("title is not null").select("title", "url"))
    return out


_CHANGES = "seq long, action string, name string, reserved boolean, keyword_type string, min_abbreviation string, doc_url string"


def toml_changes(spark: SparkSession, path: str) -> DataFrame | None:
    """Changes to a dictionary from a TOML file with tables add, override and remove; a missing or broken file gives None."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError):
        return None
    rows = [(a, r) for a in ("remove", "override", "add") for r in found.get(a, [])]
    return spark.createDataFrame([(i, a, r.get("name"), r.get("reserved"), r.get("keyword_type"), r.get("min_abbreviation"), r.get("doc_url")) for i, (a, r) in enumerate(rows)], _CHANGES)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def csv(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """IMPORT's form: fields parted by blanks, texts in double quotes."""
    return spark.read.schema(schema).csv(path, sep=sep, quote='"', escape='"')


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def export(df: DataFrame, path: str, sep: str = " ") -> None:
    """EXPORT's form, in as many files as df has partitions."""
    df.write.mode("overwrite").csv(path, sep=sep, quote='"', escape='"')


def write_lines(df: DataFrame, path: str) -> None:
    """One text column as lines of one file; for generated files of known small size."""
    df.coalesce(1).write.mode("overwrite").text(path)


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share; in local mode without one, in a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/rowloom-{spark.sparkContext.applicationId}"
    folder = f"{where}/files/{name}-{uuid.uuid4().hex}"
    if hasattr(spark, "_jvm"):  # the folder goes when the session's process ends
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/data"


def temp_table(df: DataFrame, name: str) -> None:
    """A named view that programs can loop over."""
    df.createOrReplaceTempView(name)
