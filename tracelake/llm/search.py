"""Ranked lexical search with bit-sliced Bloom signatures.

Index: documents are packed into blocks of at most ``BLOCK``, long ones apart from short ones by their number of different terms. A block holds a Bloom signature, stored by slice: one
bitmap over its documents for each of its bits. Each term of a document sets ``HASHES`` bits, and again for each floor of ``TIERS`` that its count reaches. The bits of a block follow from
the most keys that one of its documents has, ``BITS`` for each.

Bound: the slices of a term, ANDed, overestimate which documents hold it that often. Weighted sums of these over an item's terms, one sum for each floor, together with the documents' lengths
bound the scores from above, as a score rises with each count. The numbers are whole and, below 2**53, exact in doubles; bounds are rounded up by a billionth for those beyond.

Threshold: the documents with the highest bounds of each item are scored exactly; the k-th best of these scores can only be too low. Then every document whose bound reaches an item's threshold
is scored exactly, from its text and term by term, and the k best remain. A document is left out only if its bounds prove that it is among the k best of no item.

Spark reads the documents once for the index, with the document counts of terms, and meets them again for those that are scored; a task keeps k candidates an item. Items go in groups of about
``GROUP`` characters, one group after the other; of a group the texts and their terms' counts pass the driver and are broadcast. Which terms the items have is told to the
index pass by a bit table of fixed size; what passes it by chance is dropped by the join with the terms.

Defined cases: a null text or item has no terms, and documents without terms take no part; each row of docs is a document, so equal rows rank one after the other, as do rows that
share a doc_id; equal scores go by doc_id, null last, then by a hash of the text; items that share an id and a text are one, those that share an id alone are ranked each by itself; a null
item_id is kept; empty tables give no rows. Only doc_id, item_id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, read, row_key, stored

K = 50
BLOCK = 1024
#: Documents are indexed and scored together up to so many bytes of text.
RUN = 4_000_000
HASHES, BITS = 4, 16
TIERS = (1, 2, 4, 8)
GROUP = 4_000_000
#: Log2 of the bits in the table of items' terms.
TABLE = 20
#: Candidates are broadcast to the scan of their texts up to so many rows.
BROADCAST_ROWS = 200_000
SATURATION, LENGTH_PART = 20, 50
_GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_GAPS + UPPER.encode(), b" " * len(_GAPS) + LOWER.encode())
_MIX = np.random.default_rng(13).integers(1, 2**63, HASHES * len(TIERS), dtype=np.uint64) | np.uint64(1)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of what is an ASCII letter, in lower case, an ASCII digit or outside ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def share(tf, m):
    """What a term that occurs tf times in a document adds for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + SATURATION * m)


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def _slices(hashes: np.ndarray, tier: int, bits: int) -> np.ndarray:
    """(term, HASHES): the slices of terms at one floor."""
    x = hashes[:, None] * _MIX[tier * HASHES : (tier + 1) * HASHES]
    x = (x ^ x >> np.uint64(29)) >> np.uint64(16) & np.uint64(0xFFFFFFFF)
    return (x * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _counted(words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, the terms, and of each document's terms (document, number of the term, count)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    held, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(number)) + codes, return_counts=True)
    doc, code = np.divmod(held, max(1, len(number)))
    return n, list(number), doc, code, tf


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list, list, list]]:
    """(type of doc_id, doc_ids, keys, texts) of some documents at a time."""
    rows, held, kind = [], 0, None
    for b in batches:
        kind = b.schema.field("doc_id").type
        for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            rows.append(row)
            held += len(row[2] or "")
            if held >= RUN:
                yield kind, *zip(*rows, strict=True)
                rows, held = [], 0
    if rows:
        yield kind, *zip(*rows, strict=True)


def index(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """A row for each block: the documents, their lengths and slices; in one block of several also how many documents hold the terms that the table ``asked`` knows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of_id, ids, keys, texts in _groups(batches):
            longs = pa.list_(pa.int64())
            schema = pa.schema({"ids": pa.list_(of_id), "keys": longs, "lengths": longs, "bits": pa.int32(), "slices": pa.binary(), "terms": pa.list_(pa.binary()), "counts": longs, "n_docs": pa.int64(), "n_terms": pa.int64()})
            n, terms, doc, code, tf = _counted([terms_of(t) for t in texts])
            hashes = _hashes(terms)
            at = hashes >> np.uint64(64 - TABLE)
            known = np.flatnonzero(table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            told = [terms[i] for i in known], np.bincount(code, minlength=len(terms))[known].tolist()
            own = np.bincount(doc, minlength=len(n))
            size = np.where(own > 0, np.ceil(np.log2(np.maximum(own, 32))), -1).astype(int)
            for c in np.unique(size[size >= 0]).tolist():
                alike = np.flatnonzero(size == c)
                for part in np.array_split(alike, -(-len(alike) // BLOCK)):
                    place = np.full(len(n), -1)
                    place[part] = np.arange(len(part))
                    mine = place[doc] >= 0
                    d, h, f = place[doc[mine]], hashes[code[mine]], tf[mine]
                    bits = BITS * int(np.bincount(d, sum((f >= x).astype(int) for x in TIERS)).max())
                    held = np.zeros((bits, len(part)), bool)
                    for k, floor in enumerate(TIERS):
                        up = f >= floor
                        held[_slices(h[up], k, bits), d[up][:, None]] = True
                    row = [[ids[i] for i in part], [keys[i] for i in part], n[part].tolist(), bits, np.packbits(held, axis=1).tobytes(), *told, len(part), int(n[part].sum())]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)
                    told = [], []

    out = f"ids array<{kind}>, keys array<bigint>, lengths array<bigint>, bits int, slices binary, terms array<binary>, counts array<bigint>, n_docs bigint, n_terms bigint"
    return docs.select("doc_id", row_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(work, out)


class Model:
    """The terms of some items with their weights, and what all documents have. N and L: documents, and terms with repeats."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], N: int, L: int):
        weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for t, d in df.items()}
        held = [[t for t in dict.fromkeys(ts) if weight.get(t, 0) > 0] for ts in items]
        self.number = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(held)))}
        self.hashes, self.N, self.L, self.n_items = _hashes(list(self.number)), N, L, len(items)
        self.weights = np.array([weight[t] for t in self.number], np.int64)
        self.sizes = np.array([len(ts) for ts in held], np.int64)
        self.terms = np.array([self.number[t] for ts in held for t in ts], np.int64)  # of one item after the other
        order = np.argsort(self.terms, kind="stable")
        self.items = np.repeat(np.arange(len(items)), self.sizes)[order]  # of one term after the other
        self.starts = np.searchsorted(self.terms[order], np.arange(len(self.number) + 1))

    def m(self, lengths) -> np.ndarray:
        return np.array([100 - LENGTH_PART + LENGTH_PART * int(n) * self.N // self.L for n in lengths], np.int64)

    def bounds(self, lengths: list[int], bits: int, slices: bytes) -> np.ndarray:
        """(item, document) of a block: no score is above."""
        wide = len(lengths)
        held = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m, out, below = self.m(lengths), np.zeros((self.n_items, wide)), np.zeros(wide, np.int64)
        full = np.flatnonzero(self.sizes)
        if not len(full):
            return out
        starts = np.concatenate([[0], np.cumsum(self.sizes)])[full]
        for k in range(len(TIERS)):
            rows = np.bitwise_and.reduce(held[_slices(self.hashes, k, bits)], axis=1)
            most = share(TIERS[k + 1] - 1, m) if k + 1 < len(TIERS) else np.full(wide, 1_000_000)
            some = np.flatnonzero(rows.any(axis=1))
            if len(some):
                sums = np.zeros((len(full), wide))
                place = np.full(len(rows), -1)
                place[some] = np.arange(len(some))
                mine = np.flatnonzero(place[self.terms] >= 0)
                weighted = np.unpackbits(rows[some], axis=1, count=wide) * self.weights[some, None].astype(float)
                item = np.searchsorted(starts, mine, "right") - 1
                first = np.flatnonzero(np.diff(item, prepend=-1))
                sums[item[first]] = np.add.reduceat(weighted[place[self.terms[mine]]], first, axis=0)
                out[full] += sums * (most - below)
            below = most
        return out * (1 + 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        """(item, document), exact."""
        n, terms, doc, code, tf = _counted([terms_of(t) for t in texts])
        own = np.array([self.number.get(t, -1) for t in terms], np.int64)[code] if len(terms) else code
        doc, own, tf = doc[own >= 0], own[own >= 0], tf[own >= 0]
        adds = self.weights[own] * share(tf, self.m(n)[doc])
        many = self.starts[own + 1] - self.starts[own]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[own], many)
        out = np.zeros((self.n_items, len(texts)), np.int64)
        np.add.at(out, (self.items[at], np.repeat(doc, many)), np.repeat(adds, many))
        return out


class _Best:
    """The k best of each item so far: (value, doc_id, key), equal values by doc_id, null last, then by key."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n_items)], np.zeros(n_items)

    def take(self, values: np.ndarray, ids: list, keys: list) -> None:
        item, at = np.nonzero((values >= self.least[:, None]) & (values > 0))
        cut = np.searchsorted(item, np.arange(len(self.rows) + 1))
        for i in np.unique(item).tolist():
            mine = at[cut[i] : cut[i + 1]]
            if len(mine) > 4 * self.k:  # no more than can stay; ties at the edge do
                v = values[i, mine]
                mine = mine[v >= np.partition(v, -self.k)[-self.k]]
            rows = self.rows[i] + [(values[i, j].item(), ids[j], keys[j]) for j in mine.tolist()]
            rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0, r[2]))
            self.rows[i] = rows[: self.k]
            if len(rows) >= self.k:
                self.least[i] = self.rows[i][-1][0]

    def batch(self, of_value: pa.DataType, of_id: pa.DataType) -> pa.RecordBatch:
        told = [(i, *r) for i, rows in enumerate(self.rows) for r in rows]
        item, value, ids, keys = zip(*told, strict=True) if told else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(value, of_value), pa.array(ids, of_id), pa.array(keys, pa.int64())], names=["item", "value", "doc_id", "key"])


def _k_best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("value").desc(), F.col("doc_id").asc_nulls_last(), "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _highest_bounds(blocks: DataFrame, kind: str, sent, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of_id = _Best(sent.value.n_items, k), None
        for b in batches:
            of_id = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                best.take(sent.value.bounds(r["lengths"], r["bits"], r["slices"]), r["ids"], r["keys"])
        if of_id is not None:
            yield best.batch(pa.float64(), of_id)

    return blocks.select("ids", "keys", "lengths", "bits", "slices").mapInArrow(work, f"item int, value double, doc_id {kind}, key bigint")


def _not_excluded(blocks: DataFrame, kind: str, sent, least: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bound = sent.value.bounds(r["lengths"], r["bits"], r["slices"])
                at = np.flatnonzero(((bound >= least[:, None]) & (bound > 0)).any(axis=0)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([r["ids"][i] for i in at], b.schema.field("ids").type.value_type), pa.array([r["keys"][i] for i in at], pa.int64())], names=["doc_id", "key"])

    return blocks.select("ids", "keys", "lengths", "bits", "slices").mapInArrow(work, f"doc_id {kind}, key bigint")


def _scored(docs: DataFrame, some: DataFrame, kind: str, sent, k: int) -> DataFrame:
    """The k best of each item among the rows of docs that ``some``, a stored table of (doc_id, key), names."""
    own = some.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    own = F.broadcast(own) if some.count() <= BROADCAST_ROWS else own
    rows = docs.select("doc_id", row_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    met = rows.join(own, (rows["key"] == own["_key"]) & rows["doc_id"].eqNullSafe(own["_id"]), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of_id = _Best(sent.value.n_items, k), None
        for of_id, ids, keys, texts in _groups(batches):  # noqa: B007
            best.take(sent.value.scores(texts), ids, keys)
        if of_id is not None:
            yield best.batch(pa.int64(), of_id)

    return _k_best(met.mapInArrow(work, f"item int, value bigint, doc_id {kind}, key bigint"), k)


def _table(items: list[str]) -> np.ndarray:
    at = _hashes(list({w for t in items for w in terms_of(t)})) >> np.uint64(64 - TABLE)
    out = np.zeros(1 << TABLE - 6, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def search(docs: DataFrame, items: DataFrame, *, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    n_groups = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP
    asked = stored(asked.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups))))
    groups = lambda: ((g, [tuple(r) for r in asked.where(F.col("g") == g).select("item_id", "text").collect()]) for g in range(n_groups))
    blocks = stored(index(docs, reduce(np.bitwise_or, (_table([t for _, t in rows]) for _, rows in groups()))))
    N, L = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counted = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    for _, rows in groups() if N else ():
        texts = [terms_of(t) for _, t in rows]
        mine = spark.createDataFrame([(bytearray(t),) for t in {t for ts in texts for t in ts}], "term binary")
        sent = spark.sparkContext.broadcast(Model(texts, {bytes(r["term"]): r["df"] for r in counted.join(mine, "term", "left_semi").collect()}, N, L))
        seeds = stored(_k_best(_highest_bounds(blocks, kind, sent, k), k).select("doc_id", "key"))
        least = np.zeros(len(rows))
        for r in _scored(docs, seeds, kind, sent, k).where(F.col("rank") == k).select("item", "value").collect():
            least[r["item"]] = r["value"]
        some = stored(_not_excluded(blocks, kind, sent, least))
        discard(seeds)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {item_kind}")
        found = _scored(docs, some, kind, sent, k).join(F.broadcast(names), "item")  # as many rows as the group has items
        out = out.unionByName(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("value").alias("score")))
    discard(blocks, asked)
    return out


def op13_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) t FROM benchmark),
n AS (SELECT count(*) docs, CAST(sum(len(w)) AS BIGINT) terms FROM d WHERE len(w) > 0),
c AS (SELECT r, doc_id, t, count(*) tf, any_value(m) m FROM (SELECT r, doc_id, 100 - 50 + (50 * len(w) * docs) // terms m, unnest(w) t FROM d, n) GROUP BY r, doc_id, t),
g AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) weight FROM c, n WHERE t IN (SELECT t FROM i) GROUP BY t, docs),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) score FROM i JOIN g USING (t) JOIN c USING (t) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0) WHERE rank <= 50
"""
