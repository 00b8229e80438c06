"""Readers of study material and job logs, and writers of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "schemaVersion string, sourceType string, sourceFile string, sourcePath string, chunks array<struct<id:string,type:string,text:string,confidence:double>>, warnings array<string>"
EVENT = "event string, phase string, timestamp timestamp, jobId string, source string, route string, payload map<string,string>"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk with its bundle's fields; an unreadable file is one row with `broken` set."""
    raw = spark.read.schema(BUNDLE + ", broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return raw.withColumn("chunk", F.explode_outer("chunks")).drop("chunks").select("*", "chunk.*").drop("chunk")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """File, line_no (blank lines and directives count), front, back (first and second non-empty field), tags."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    directive = F.regexp_extract("line", r"^#tags column:\s*([0-9]+)", 1).try_cast("int")
    tags = lines.where(F.startswith("line", F.lit("#"))).groupBy("file").agg(F.coalesce(F.max(directive), F.lit(0)).alias("column"))
    cards = lines.where((F.trim("line") != "") & ~F.startswith("line", F.lit("#"))).join(tags, "file", "left").withColumn("f", F.split("line", "\t"))
    full = F.filter("f", lambda x: F.trim(x) != "")
    return cards.select("file", (F.col("p") + 1).alias("line_no"), F.get(full, F.lit(0)).alias("front"), F.get(full, F.lit(1)).alias("back"), F.when(F.col("column") > 0, F.get("f", F.col("column") - 1)).alias("tags"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, line_no, line."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return text.select("file", F.posexplode(F.split("value", "\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...], after: str | None = None) -> DataFrame:
    """Path, modified, size and digest of files with one of the suffixes (lower-case), without dotfiles."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("modifiedAfter", after) if after else reader).load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(name, s))
    return files.where(wanted & ~F.startswith(name, F.lit("."))).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value) that begin with `BIC_PROGRESS ` and hold a JSON object; batch or stream."""
    prefix = "BIC_PROGRESS "
    body = F.substring("value", len(prefix) + 1, 2**30)
    return lines.where(F.startswith("value", F.lit(prefix)) & F.startswith(F.trim(body), F.lit("{"))).select(F.from_json(body, EVENT).alias("e")).select("e.*").where("event IS NOT NULL")


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "source_type") -> None:
    """Parquet, JSON or CSV, in a folder for each source type."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def read_adapted(spark: SparkSession, source_type: str, path: str) -> DataFrame:
    """Chunks (file, place, text) of a source by its registered adapter; an unknown type is an error that lists them."""
    if source_type not in ADAPTERS:
        raise ValueError(f"unknown source type {source_type}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source_type](spark, path)


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cards": lambda s, p: read_cards(s, p).select("file", F.col("line_no").alias("place"), F.concat_ws("\n", "front", "back").alias("text")),
    "transcript": lambda s, p: read_lines(s, p).where("trim(line) <> ''").select("file", F.col("line_no").alias("place"), F.col("line").alias("text")),
    "bundle": lambda s, p: read_bundles(s, p).select(F.col("sourceFile").alias("file"), F.col("id").alias("place"), "text"),
}
