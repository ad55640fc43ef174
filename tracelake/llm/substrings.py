"""Substring dedup by seed and extend.

A window is ``window`` consecutive words. A word goes if it lies in a window whose word sequence also starts in a document
with a smaller doc_id; windows are judged on the input.

Seed: each window is led by its anchor, the least hash among its grams of ``gram`` words (winnowing: equal windows choose
equal anchors, and neighbouring windows mostly share one). Anchors that occur in one document only can't seed a repeat;
Spark counts them and a bit table of fixed size says which anchors may be shared.

Extend: around each seed that may be shared all windows that it leads are extended to both sides to their full length. The seeds of all
documents meet by anchor, one row for each occurrence with its extensions; there, in the order of doc_id, an extension
that a smaller doc_id has too is a repeat. Neighbouring repeats are handed on as ranges and merge to maximal runs, each at least ``window`` words long.

Hot passages: of equal windows in a run of ``RUN`` words only those of the smallest doc_id are sent on, as the others are repeats already; so a passage that a
third of all documents share costs a row in each run. The anchors of more than a ``HOT_SHARE``-th of all shared seeds, at most ``HOT_SHARE`` of
them, meet by window instead of by anchor. What a task holds at once is the different windows of one anchor.

Words are compared by 64-bit hashes: windows are equal if the 64-bit hashes of the window and of its anchor both are. Two different windows pass for equal
with a probability of about 2**-128, whatever text is compared; words themselves are not compared again.

The bit table holds at most ``slots`` 64-bit numbers: it only saves work. If it fills up, more windows pass it and the meeting decides as before.

Defined cases: a null text has no words and stays null; a text of fewer words than a window stays; rows with a null doc_id
are neither changed nor compared; rows that share a doc_id are one document, so they never repeat each other, but each
row is judged by its own text; all columns of the input are kept, and only text changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read, row_key, stored

WINDOW = 13
GRAM = 5
SLOTS = 1 << 19
#: Words are hashed in runs of about so many, to bound memory.
RUN = 500_000
#: An anchor is hot if it has more than this part of all shared seeds.
HOT_SHARE = 10_000
_WEIGHTS = np.random.default_rng(3).integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < 500_000:
            self[w] = h
        return h


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: only ASCII white space counts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        out += h[k : k + m] * _WEIGHTS[salt + k]
    return _mixed(out)


def anchored(texts: list[str | None], cache: _Hashes, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (text's number, window's first word, word hashes' place, anchor's hash, all hashes) of each window."""
    if not 0 <= window - gram < 16:
        raise ValueError("a window has 1 to 16 grams")
    at = 0
    while at < len(texts):
        lists, total, first = [], 0, at
        while at < len(texts) and total < RUN:
            lists.append(split_words(texts[at]))
            total += len(lists[-1])
            at += 1
        sizes = np.array([len(x) for x in lists], np.int64)
        h = np.fromiter(map(cache.__getitem__, chain.from_iterable(lists)), np.uint64, total)
        g = _grams(h, gram, 0)
        m = len(h) - window + 1
        if m <= 0:
            continue
        high = g & ~np.uint64(15)
        best = high[:m].copy()  # the least hash, and in its low bits which gram has it; the first of equal ones leads
        for k in range(1, window - gram + 1):
            np.minimum(best, high[k : k + m] | np.uint64(k), out=best)
        which = (best & np.uint64(15)).astype(np.int64)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(lists)), sizes)[:m]
        inside = np.arange(m) + window <= ends[text]
        place = np.flatnonzero(inside)
        yield text[place] + first, place - (ends - sizes)[text[place]], place, g[place + which[place]], which[place], h


def _slot(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(6)) % np.uint64(slots), np.uint64(1) << (h & np.uint64(63))


def _starts(changes: np.ndarray) -> np.ndarray:
    """Where a run begins: changes[i] says that i + 1 begins another."""
    return np.flatnonzero(np.r_[True, changes])


def _ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, how many) of the runs of consecutive starts, which come by row in ascending order."""
    if not len(row):
        return row, start, start
    at = _starts((row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
    return row[at], start[at], np.diff(np.r_[at, len(row)])


def _leaders(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, leader): rows sorted by keys, the last most significant, and for each of these the first row with the same values in all but the first key."""
    by = np.lexsort(keys)
    change = np.zeros(max(len(by) - 1, 0), bool)
    for x in keys[1:]:
        change |= x[by][1:] != x[by][:-1]
    at = _starts(change) if len(by) else np.empty(0, np.int64)
    return by, np.repeat(by[at], np.diff(np.r_[at, len(by)]))


def _extended(rows: np.ndarray, starts: np.ndarray, spots: np.ndarray, anchors: np.ndarray, wins: np.ndarray, order: np.ndarray, hot: np.ndarray) -> tuple:
    """((row, start, n) of known repeats, (key, row, start, offsets, windows) of what is still open)."""
    by, lead = _leaders(order, anchors, wins)
    late = np.empty(len(by), bool)
    late[by] = order[by] > order[lead]
    known = _ranges(rows[late], starts[late])
    rows, starts, spots, anchors, wins = (x[~late] for x in (rows, starts, spots, anchors, wins))
    apart = np.isin(anchors, hot)
    at = _starts((rows[1:] != rows[:-1]) | (spots[1:] != spots[:-1]) | (starts[1:] != starts[:-1] + 1) | apart[1:] | apart[:-1]) if len(rows) else np.empty(0, np.int64)
    return known, (np.where(apart, wins, anchors)[at], rows[at], starts[at], np.r_[at, len(rows)].astype(np.int32), wins)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, slots: int = SLOTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, text_key, start, n): ranges of first words of the windows of each row that a smaller doc_id has too. A stored table."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", row_key(F.col("text")).alias("text_key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in parts:
            for text, start, _, anchor, which, _ in anchored(b.column("text").to_pylist(), cache, window, gram):
                spot = start + which  # consecutive windows mostly share their anchor
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (spot[1:] != spot[:-1])
                yield pa.RecordBatch.from_arrays([_signed(anchor[new]), b.column("doc_id").take(pa.array(text[new]))], names=["a", "doc_id"])

    found = texts.select("doc_id", "text").mapInArrow(seeds, f"a bigint, doc_id {id_type}")
    shared = stored(found.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("a", "n"))
    slot = F.pmod(F.shiftrightunsigned("a", 6), F.lit(slots))
    bits = shared.groupBy(slot.alias("s")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("a").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    rows = bits.toArrow()  # at most ``slots`` rows
    table = np.zeros(slots, np.uint64)
    table[rows["s"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r["a"] for r in shared.where(F.col("n") > total / hot_share).select("a").collect()], np.int64).view(np.uint64)  # fewer than ``hot_share`` rows
    discard(shared)
    may_share = docs.sparkSession.sparkContext.broadcast((table, hot))

    def passes(h: np.ndarray) -> np.ndarray:
        s, bit = _slot(h, slots)
        return (may_share.value[0][s.astype(np.int64)] & bit) != 0

    def extend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in parts:
            ids, key = b.column("doc_id"), b.column("text_key").to_numpy(zero_copy_only=False)
            order = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
            for text, start, place, anchor, which, h in anchored(b.column("text").to_pylist(), cache, window, gram):
                ok = passes(anchor)
                t, p = text[ok], place[ok]
                known, (k, row, s, ends, wins) = _extended(t, start[ok], p + which[ok], anchor[ok], _grams(h, window, 16)[p], order[t], may_share.value[1])
                r, first, n = known
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(r) + 1, np.int32)), pa.array([], pa.int64()))
                yield _batch([pa.array(key[r] ^ first), ids.take(pa.array(r)), pa.array(key[r]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), none])
                open_ = pa.ListArray.from_arrays(pa.array(ends), _signed(wins))
                yield _batch([_signed(k), ids.take(pa.array(row)), pa.array(key[row]), pa.array(s.astype(np.int32)), pa.array(np.zeros(len(row), np.int32)), open_])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by k, then doc_id. Of the last k so far the windows are held with the first doc_id that has them."""
        held_w, held_ids, last = np.empty(0, np.int64), None, 0
        for b in parts:
            n = b.column("n").to_numpy()
            yield b.filter(pa.array(n > 0)).select(["doc_id", "text_key", "start", "n"])
            b = b.filter(pa.array(n == 0))
            if not b.num_rows:
                continue
            k, s, w = b.column("k").to_numpy(), b.column("start").to_numpy(), b.column("ws").flatten().to_numpy()
            size = np.diff(b.column("ws").offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + s[row]
            c = len(held_w)
            ids = b.column("doc_id") if held_ids is None else pa.concat_arrays([held_ids, b.column("doc_id")])
            of = np.r_[np.arange(c), c + row]  # the place of each window's doc_id in ids
            code = ids.dictionary_encode().indices.to_numpy()[of]
            all_w = np.r_[held_w, w]
            all_k = np.r_[np.full(c, last), k[row]]
            by, lead = _leaders(np.arange(len(all_w)), all_w, all_k)
            late = np.empty(len(by), bool)
            late[by] = code[by] != code[lead]
            first = np.unique(lead)
            first = first[all_k[first] == k[-1]]
            held_w, held_ids, last = all_w[first], ids.take(pa.array(of[first])), k[-1]
            r, start, n = _ranges(row[late[c:]], at[late[c:]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), b.column("text_key").take(pa.array(r)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "text_key", "start", "n"])

    open_rows = texts.mapInArrow(extend, f"k bigint, doc_id {id_type}, text_key bigint, start int, n int, ws array<bigint>")
    met = open_rows.repartition("k").sortWithinPartitions("k", "doc_id")
    return stored(met.mapInArrow(meet, f"doc_id {id_type}, text_key bigint, start int, n int"))


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["k", "doc_id", "text_key", "start", "n", "ws"])


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, slots: int = SLOTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs with the repeated words taken out of text, and columns n_words, n_removed and runs (array of struct(s, e) of words).

    The kept words are joined by one blank.
    """
    ranges = repeats(docs, window=window, gram=gram, slots=slots, hot_share=hot_share)
    gone = ranges.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("at"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("at.start").alias("_start"), F.col("at.n").alias("_n"))
    met = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (row_key(docs["text"]) == gone["_key"]), "left")

    @F.pandas_udf("struct<kept:string,n_words:bigint,n_removed:bigint,runs:array<struct<s:int,e:int>>>")
    def cut(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at, n in zip(texts, starts, counts, strict=True):
            w = split_words(text)
            runs: list[dict] = []
            for s, k in zip(at, n, strict=True) if at is not None else ():
                if runs and s <= runs[-1]["e"]:  # runs that overlap or touch are one
                    runs[-1]["e"] = max(runs[-1]["e"], int(s + k) + window - 1)
                else:
                    runs.append({"s": int(s), "e": int(s + k) + window - 1})
            kept, end = [], 0
            for r in runs:
                kept += w[end : r["s"]]
                end = r["e"]
            kept += w[end:]
            out.append((None if text is None else b" ".join(kept).decode(), len(w), len(w) - len(kept), runs))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "runs"])

    got = met.select(*[docs[c] for c in docs.columns], cut(docs["text"], F.col("_start"), F.col("_n")).alias("_cut"))
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "runs")]
    return got.select(*[F.col("_cut.kept").alias("text") if c == "text" else F.col(c) for c in keep], "_cut.n_words", "_cut.n_removed", "_cut.runs")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 13], ' ') t FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) s FROM d)),
f AS (SELECT t, min(doc_id) first_id FROM v GROUP BY t HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) p FROM v JOIN f USING (t) WHERE doc_id > first_id),
x AS (SELECT doc_id, unnest(w) x, unnest(range(0, len(w))) p FROM d),
k AS (SELECT x.doc_id, count(c.p) n_removed, coalesce(string_agg(CASE WHEN c.p IS NULL THEN x.x END, ' ' ORDER BY x.p), '') kept FROM x LEFT JOIN c USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
