"""Scans and sinks of line-delimited logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ENTRIES, TURNS
from .files import numbered

#: Types that grow by day.
SERIES = ("auditlog", "worklog")


def scan_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turn rows; a bad field becomes null, a bad line and the header row go (SRC-1)."""
    return spark.read.schema(TURNS).json(path).where("type = 'turn'")


def stream_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TURNS).json(path).where("type = 'turn'")


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, value) of every line under root, dot-directories left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")


def scan_entries(spark: SparkSession, root: str, *, audit: bool = False) -> DataFrame:
    """Entries of a tree: bad and non-object lines skipped (SRC-2), or kept with the number of each line and the text of a bad one in ``bad`` (SRC-3)."""
    lines = numbered(spark, root, "*.jsonl").where(F.trim("value") != "") if audit else raw_lines(spark, root)
    parsed = lines.withColumn("e", F.from_json("value", f"{ENTRIES}, bad STRING", {"columnNameOfCorruptRecord": "bad"}))
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    bad = F.when(~object_, F.col("value")).otherwise(F.col("e.bad"))
    out = parsed.select("path", *(["line"] if audit else []), "e.*", bad.alias("_bad")).drop("bad").withColumnRenamed("_bad", "bad")
    return out if audit else out.where("bad IS NULL").drop("bad")


def first_of(entries: DataFrame, *order: str, key: str = "id") -> DataFrame:
    """The first row of each key by the given order (SRC-4); descending columns give the last (SRC-5)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return entries.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def append_new(new: DataFrame, existing: DataFrame, path: str, *, key: str = "id") -> None:
    """Appends rows whose key is not yet there (SNK-2)."""
    new.join(existing.select(key), key, "left_anti").dropDuplicates([key]).write.mode("append").json(path)


def compact(entries: DataFrame, path: str, *, prefixes: dict[str, str] | None = None, series: tuple[str, ...] = SERIES) -> None:
    """One folder per type, ordered by time and id; rows are dealt by type and a hash, so that no type falls to one task (SNK-3).

    The type is the one whose prefix begins the id, where ``prefixes`` names one; else the row's own. Types that are time series stay as they are and are left out.
    """
    kind = F.col("type")
    for name, prefix in sorted((prefixes or {}).items(), key=lambda x: len(x[1])):
        kind = F.when(F.startswith("id", F.lit(prefix)), name).otherwise(kind)
    rows = entries.withColumn("type", kind).where(~F.coalesce(F.col("type").isin(*series), F.lit(False)))
    dealt = rows.repartition("type", F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt.sortWithinPartitions("type", "created_at", "id").write.partitionBy("type").mode("overwrite").json(path)
