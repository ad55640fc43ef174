"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of a finished write; else they stay as long as the driver holds the plan.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark keeps the text of each plan that ran in the driver's memory, with all numbers of its constants; so many characters of it will do.
_TEXT = "spark.sql.maxPlanStringLength"
_WRITING = {_CLEAN: "true", _TEXT: "50000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share. Where it is unset: an error, but in local mode a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def stored(df: DataFrame, *, partition_by: str | None = None, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends here. It goes with ``discard`` or with the session. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path, partitionBy=partition_by)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        _files(t.sparkSession, t.stored_at).delete(t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at), True)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
