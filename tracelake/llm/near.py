"""Near-duplicate groups: texts whose sets of word shingles are alike, together with SimHash's links.

Two texts link if the Jaccard similarity of their sets of ``shingle`` words in a row is at least ``threshold``, or if their
SimHash fingerprints link (see simhash.py, with its own parameters). Groups are the connected components of all links.

The set join is exact. Texts with equal sets are one class. The shingles of each set are ordered by rarity (counted in
``BUCKETS`` buckets, a table of fixed size; any fixed order is exact); two sets match only if they share one of the
``n - ceil(t * n) + 1`` first of each, and if sizes and positions allow it. What passes is verified by the whole sets. The
classes that share a prefix shingle first meet the smallest of them only; then those that lie outside the largest
component of such a group meet the rest of it. So a large group of near copies costs a step a member, not all its pairs.

Shingles are compared by 64-bit hashes. A text of fewer words than ``shingle`` has one shingle, a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, row_key, stored

WORDS = 5
THRESHOLD = 0.8
BUCKETS = 65_536
#: Bits of the table that says which texts pairs need.
NAMED = 1 << 23
#: Words whose hash a Python worker keeps.
_KEPT = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int, seen: dict[bytes, int]) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending. Words are those of simhash.fingerprint."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(seen) > _KEPT:
        seen.clear()
    for w in set(words):
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w, seed=7)
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    n = max(len(words) - shingle + 1, 1)
    out = np.full(n, min(shingle, len(words)), np.uint64)
    for i in range(min(shingle, len(words))):
        out = (out ^ h[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=11)


def _signed(numbers) -> pa.Array:
    return pa.array(np.array(numbers, dtype=np.uint64).view(np.int64), pa.int64())


def _least(n: Column, threshold: float) -> Column:
    """ceil(threshold * n), safe from rounding."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """The rank of each bucket by the number of shingles in it."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(BUCKETS, np.int64), {}
        for b in parts:
            for t in b.column("text").to_pylist():
                n += np.bincount((shingles(t, shingle, seen) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) if t else 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["b", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[r["b"]] = r["n"]
    ranks = np.empty(BUCKETS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    return ranks


def _rows(docs: DataFrame, ranks: np.ndarray, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, key, fp, cid, n, prefix) of every row: a hash of its text, its fingerprint, its class, and the prefix shingles of that.

    A set too small to match any but its equal has an empty prefix.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in parts:
            texts = b.column("text").to_pylist()
            fps, cids, sizes, prefixes = [], [], [], []
            for t in texts:
                s = shingles(t, shingle, seen)
                n = len(s)
                k = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n / (n + 1) >= threshold - 1e-9 else 0
                prefixes.append(s[np.lexsort((s, ranks[(s % np.uint64(BUCKETS)).astype(np.int64)]))[:k]].view(np.int64))
                fps.append(simhash.fingerprint(t))
                cids.append(_class(s))
                sizes.append(n)
            ends = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), _signed(fps), _signed(cids), pa.array(sizes, pa.int32()), prefix], names=["doc_id", "key", "fp", "cid", "n", "prefix"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key(F.col("text")).alias("key"), "text").mapInArrow(work, f"doc_id {id_type}, key bigint, fp bigint, cid bigint, n int, prefix array<bigint>")


def _verified(pairs: DataFrame, keys: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets match, as a stored table. keys: (cid, key), a text for each class.

    A table of a fixed number of bits says which texts no pair needs; their shingles are not worked out. When it fills up, the joins decide.
    """
    pairs = stored(pairs)
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(keys, "cid"))
    spot = F.col("key").bitwiseAND(F.lit(NAMED - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))
    table = np.zeros(NAMED // 64, np.int64)
    got = named.groupBy(F.shiftright(spot, 6).alias("k")).agg(F.bit_or(bit).alias("v")).toArrow()  # at most NAMED / 64 rows
    table[got["k"].to_numpy()] = got["v"].to_numpy()
    bits = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in parts:
            k = b.column("key").to_numpy().view(np.uint64)
            low = k & np.uint64(NAMED - 1)
            wanted = (bits.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
            b = b.filter(pa.array(wanted))
            for key, t in zip(b.column("key"), b.column("text").to_pylist(), strict=True):
                s = shingles(t, shingle, seen)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["key", "h"])

    # Equal texts have equal sets; one of each is enough.
    found = docs.select(row_key(F.col("text")).alias("key"), "text").mapInArrow(sets, "key bigint, h array<bigint>")
    of = stored(named.join(found.groupBy("key").agg(F.first("h").alias("h")), "key").select("cid", "h"))
    met = pairs.join(of.select(F.col("cid").alias("a"), F.col("h").alias("ha")), "a").join(of.select(F.col("cid").alias("b"), F.col("h").alias("hb")), "b")
    both = met.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("shared"), (F.size("ha") + F.size("hb")).alias("of"))
    out = stored(both.where(F.col("shared") >= _least(F.col("of") - F.col("shared"), threshold)).select("a", "b"))
    discard(pairs, named, of)
    return out


def set_links(rows: DataFrame, docs: DataFrame, *, shingle: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges that connect all classes whose sets match, directly or through others. rows are those of docs."""
    classes = stored(rows.groupBy("cid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    keys = classes.select("cid", "key")
    tokens = classes.select("cid", "n", F.posexplode("prefix").alias("i", "x"))
    heads = tokens.groupBy("x").agg(F.min(F.struct("cid", "n", "i")).alias("head"), F.count("*").alias("g")).where("g > 1").drop("g")
    groups = stored(tokens.join(heads, "x"))

    def fits(a: str, b: str) -> Column:
        """Length and positional filters for two rows that share a prefix shingle."""
        need = _least(F.col(f"{a}n") + F.col(f"{b}n"), threshold / (1 + threshold))
        return (
            (F.col(f"{a}n") >= _least(F.col(f"{b}n"), threshold)) & (F.col(f"{b}n") >= _least(F.col(f"{a}n"), threshold))
            & (F.least(F.col(f"{a}n") - F.col(f"{a}i"), F.col(f"{b}n") - F.col(f"{b}i")) >= need)
        )

    near = groups.where((F.col("cid") != F.col("head.cid")) & fits("", "head.")).select(F.col("cid").alias("a"), F.col("head.cid").alias("b")).distinct()
    matched = _verified(near, keys, docs, shingle, threshold)
    label = simhash.components(matched).withColumnRenamed("node", "cid")

    # What a component holds is connected already: only pairs across components are left, and one of such a pair lies outside the largest.
    labelled = stored(groups.drop("head").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    discard(groups)
    sizes = labelled.groupBy("x", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("x").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = stored(labelled.join(main.drop("labels"), "x"))
    discard(labelled)
    left = mixed.where("label <> main").select("x", *[F.col(c).alias(f"b_{c}") for c in ("cid", "n", "i", "label")])
    rest = mixed.select("x", *[F.col(c).alias(f"a_{c}") for c in ("cid", "n", "i", "label")])
    pairs = left.join(rest, "x").where((F.col("a_label") != F.col("b_label")) & fits("a_", "b_"))
    pairs = pairs.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    out = _verified(pairs, keys, docs, shingle, threshold).unionByName(matched)
    discard(mixed)
    return out


def near_groups(docs: DataFrame, *, shingle: int = WORDS, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest doc_id of its component). ``options`` are those of SimHash."""
    rows = stored(_rows(docs, _ranks(docs, shingle), shingle, threshold))
    # Every fingerprint is stood for by the smallest class that has it, so all links are links of classes.
    reps = stored(rows.groupBy("fp").agg(F.min("cid").alias("rep")))
    alike = rows.select("fp", "cid").join(reps, "fp").where("cid <> rep").select(F.col("cid").alias("a"), F.col("rep").alias("b")).distinct()
    by_fp = simhash.links(reps, **options).join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    edges = set_links(rows, docs, shingle=shingle, threshold=threshold).unionByName(alike).unionByName(by_fp.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    label = simhash.components(stored(edges)).withColumnRenamed("node", "cid")
    labelled = stored(rows.select("doc_id", "cid").join(label, "cid", "left").select("doc_id", F.coalesce("label", "cid").alias("label")))
    discard(rows, reps)
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "label").select("doc_id", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay. All columns unchanged."""
    found = near_groups(docs, **options)
    first = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where(F.col("doc_id") != F.col("c")).select(F.col("doc_id").alias("_later"))
    return docs.join(first, docs["doc_id"] == first["_later"], "left_anti")
