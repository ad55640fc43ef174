"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, shared_dir, stored  # noqa: F401 - for the modules of this package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What stands between words of lower-case letters, digits and everything outside ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, lower-cased in ASCII. Null has none. (split takes a fifth of regexp_extract_all's time.)"""
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def row_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def covered(spans: Column) -> Column:
    """How many positions an array of struct(s, e), ends exclusive, covers."""
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, x: F.struct(
            F.greatest(a["e"], x["e"]).alias("e"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
