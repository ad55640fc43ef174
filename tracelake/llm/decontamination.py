"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of ``window`` consecutive words; an item with fewer words, but not
none, is one window. A window is a set of shingles, each with its position. A document contains the whole window only
if it contains every shingle, so for containment 1 the necessary prefix is the one shingle that is rarest in the
documents. The join is on that shingle. Then the positional bound (the window must start at or after the document's
first word), the length bound (it must end at or before the last) and a comparison of the words themselves decide.

The passes over the documents are scans with a hash probe; only counts, hits and the rows' keys are shuffled. The window table is
broadcast if it has at most ``broadcast_rows`` rows, else the same joins are shuffled on the shingle, of which Spark can split hot ones, and only places
that pass the bounds meet their text.

Defined cases: a null text has no words and no hits; a null item text has no window; a null item_id marks words but
counts as no item; equal rows of ``docs`` give equal rows; rows with one doc_id but other texts are judged each by
its own text; a null doc_id is kept as a key; empty tables give empty or clean results. Only doc_id and text are read,
so that other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, read, row_key, words

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 500_000


def _shingles(of, size: int):
    """xxhash64 of each run of ``size`` words, in order; equal hashes are told apart by the later word comparison."""
    n = F.size(of) - F.lit(size - 1)
    runs = F.transform(F.slice(of, 1, n), lambda w, i: F.xxhash64(w, *[F.get(of, i + k) for k in range(1, size)]))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wwords, items): each distinct window with the ids of the items that hold it."""
    w = items.select("item_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    cut = F.when(n >= window, F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).otherwise(F.array("w"))
    return w.where(n > 0).select("item_id", F.explode(cut).alias("wwords")).groupBy("wwords").agg(F.collect_set("item_id").alias("items"))


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, spans (array of struct(s, e) of words), items (array of item_id)."""
    wins = item_windows(items, window).withColumn("len", F.size("wwords"))
    seen = wins.groupBy(F.least("len", F.lit(shingle)).alias("k")).agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).collect()
    sizes = sorted(r["k"] for r in seen) or [shingle]
    small = sum(r["tokens"] for r in seen) <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    # explode_outer throughout: for explode() Catalyst infers a filter on the array's size and works the array out twice.
    tokens = None
    for k in sizes:
        part = wins.where(F.least("len", F.lit(shingle)) == k).select("wwords", "len", "items", F.lit(k).alias("k"), F.posexplode_outer(_shingles(F.col("wwords"), k)).alias("off", "h"))
        tokens = part if tokens is None else tokens.unionByName(part)

    # Rarity over all documents, counted for the shingles of the items only.
    hashes = F.concat(*[_shingles(F.col("w"), k) for k in sizes])
    spread = base.select(hashes.alias("hs")).select(F.explode_outer("hs").alias("h"))
    rarity = spread.join(hint(tokens.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n"))

    # The prefix of a window: its rarest shingle, with a fixed order among equally rare ones.
    ranked = tokens.join(rarity, "h", "left").groupBy("wwords").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off", "k")).alias("r"), F.first("len").alias("len"), F.first("items").alias("items")
    )
    # A shingle that no document has can't lead to a hit.
    prefix = ranked.where(F.col("r.n") > 0).select(F.col("r.h").alias("h"), F.col("r.k").alias("k"), F.col("r.off").alias("off"), "len", "wwords", "items")
    found = None
    for k in sizes:
        mine = prefix.where(F.col("k") == k).drop("k")
        placed = base.select("doc_id", "text_key", *(["w"] if small else []), F.size("w").alias("n_words"), F.posexplode_outer(_shingles(F.col("w"), k)).alias("p", "h"))
        start = F.col("p") - F.col("off")
        met = placed.join(hint(mine), "h").withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        if not small:  # whole texts don't travel with every shingle: what passes the bounds meets its text again
            own = base.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "w").dropDuplicates(["_id", "_key"])
            met = met.join(own, met["doc_id"].eqNullSafe(own["_id"]) & (met["text_key"] == own["_key"]))
        met = met.where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("wwords"))
        part = met.select("doc_id", "text_key", F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")).alias("span"), "items")
        found = part if found is None else found.unionByName(part)
    hits = found.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans", "items")
    rows = base.select("doc_id", "text_key", F.size("w").alias("n_words"))
    met = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["text_key"] == hits["_key"]), "left")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType))
    return met.select("doc_id", "text_key", "n_words", none("spans").alias("spans"), none("items").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without a hit word, all columns unchanged."""
    found = find_contamination(docs, items, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (row_key(docs["text"]) == found["_key"]), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = covered(F.col("spans"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[s + 1:s + least(len(w), 10)], ' ') t FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') t FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, t)),
hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
