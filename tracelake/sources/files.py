"""Finding inputs: listings of trees as tables, input sets, runtime logs by scope, numbered lines (SRC-11, SRC-6, SRC-3).

A listing reads names, times and lengths, never contents; an empty file has no time. Spark leaves out files and folders whose names begin with a dot or an underscore below the folder that is named.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the logs of a repository stand.
WORK_MEMORY, TURNS = "agent-context/work-memory", ".mso-context/conversation/turns.jsonl"
LISTED = "path string, modified timestamp, length bigint"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files under a folder, or of one file; nothing where there is none."""
    if not exists(spark, root):
        return spark.createDataFrame([], LISTED)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    # A scan leaves out empty files; their names are in the listing that the driver holds to plan any scan.
    names = spark.createDataFrame([(p,) for p in found.inputFiles()], "name string").withColumn("_at", F.regexp_replace("name", "^file:/+", "file:/"))
    met = names.join(found.select("path", "modificationTime", "length"), F.col("_at") == F.regexp_replace("path", "^file:/+", "file:/"), "left")
    return met.select(F.coalesce("path", "_at").alias("path"), F.col("modificationTime").alias("modified"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length"))


def discover(spark: SparkSession, targets: list[str], *, patterns: tuple[str, ...] = ("*.abox.ttl", "*.inferred.ttl"), named: str = "*.ttl") -> DataFrame:
    """(path, rank, length), each file once: what the targets name or hold, by rank and path (SRC-11).

    A folder gives the files under it that match a pattern, a file itself if it is like ``named``. The rank is the place of the first pattern that the name matches, so stored files come before
    inferred ones; a file of another name stands with the first. A named file of the first pattern brings its siblings of the others along. Each folder is listed once, however many patterns there are.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(name.rlike(fnmatch.translate(p).replace(r"\z", r"\Z")), i).otherwise(rank)
    out = spark.createDataFrame([], LISTED + ", given boolean")
    for t in targets:
        base = t.rsplit("/", 1)[-1]
        if fnmatch.fnmatch(base, named) and exists(spark, t):
            out = out.unionByName(listing(spark, t).withColumn("given", F.lit(True)))
            stem = base.removesuffix(patterns[0].removeprefix("*"))
            for p in patterns[1:] if stem != base else ():
                out = out.unionByName(listing(spark, t.removesuffix(base) + stem + p.removeprefix("*")).withColumn("given", F.lit(True)))
        else:
            out = out.unionByName(listing(spark, t).withColumn("given", F.lit(False)))
    ranked = out.withColumn("rank", F.coalesce(rank, F.when(F.col("given"), 0))).where("rank IS NOT NULL")
    return ranked.groupBy("path").agg(F.min("rank").alias("rank"), F.max("length").alias("length")).orderBy("rank", "path")


def runtime_files(spark: SparkSession, root: str) -> DataFrame:
    """(scope, path, length) of a repository's logs: memory, audit, worklog and intent (SRC-6). Memory is what stands in no folder named auditlog or worklog."""
    root = root.rstrip("/")
    memory = f"{root}/{WORK_MEMORY}"
    under = F.substring_index("path", f"/{WORK_MEMORY}/", -1)
    scope = F.when(F.startswith(under, F.lit("auditlog/")), "audit").when(F.startswith(under, F.lit("worklog/")), "worklog").when(~under.rlike("(^|/)(auditlog|worklog)/"), "memory")
    logs = listing(spark, memory, "*.jsonl").select(scope.alias("scope"), "path", "length").where("scope IS NOT NULL")
    return logs.unionByName(listing(spark, f"{root}/{TURNS}").select(F.lit("intent").alias("scope"), "path", "length"))


def numbered(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, line, value) of the lines under a folder, numbered from 1, blank ones included (SRC-3).

    A line's place in its block of a file comes from the scan, the lines of earlier blocks are added: a file may be read by many tasks.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, line bigint, value string")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path", "_block").orderBy("_id")))
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(blocks.withColumn("_before", before).drop("_lines"), ["path", "_block"]).select("path", (F.col("_before") + F.col("_n")).alias("line"), "value")


def runtime_lines(spark: SparkSession, root: str) -> DataFrame:
    """(scope, path, line, value) of the lines of ``runtime_files`` (SRC-6)."""
    root = root.rstrip("/")
    lines = numbered(spark, f"{root}/{WORK_MEMORY}", "*.jsonl").unionByName(numbered(spark, f"{root}/{TURNS}"))
    files = runtime_files(spark, root).select("scope", F.regexp_replace("path", "^file:/+", "/").alias("_path"))
    return lines.join(files, F.regexp_replace("path", "^file:/+", "/") == F.col("_path")).select("scope", "path", "line", "value")


def runtime_counts(spark: SparkSession, root: str) -> DataFrame:
    """(scope, files, records, bad) of all four scopes: files, lines with text, and how many of these are no JSON object (SRC-6, AGG-10)."""
    scopes = spark.createDataFrame([(s,) for s in ("memory", "audit", "worklog", "intent")], "scope string")
    files = runtime_files(spark, root).groupBy("scope").agg(F.count("*").alias("files"))
    bad = F.coalesce(~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(True))
    told = runtime_lines(spark, root).where(F.trim("value") != "").groupBy("scope").agg(F.count("*").alias("records"), F.count_if(bad).alias("bad"))
    return scopes.join(files, "scope", "left").join(told, "scope", "left").na.fill(0)
