"""Periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``least`` words and ``times`` periods, which no neighbouring
word extends. Words are appended to a catcher. For each power of two C it holds the fingerprint of every completed block of C words; each appended word completes
one suffix of C words, which is compared with the block before the one it starts in (for the smallest C also with that one). As a run of period q, C <= q < 2C, is
at least three periods long, it holds a whole block whose copy stands q words later: that comparison reports a square. A square inside a known run of a smaller period is
part of it. Any other is extended to both sides by comparing fingerprints of falling size, open ones go on with the next words, and what covers the same stretch is one run.

A word costs one fingerprint and one comparison for each power of two up to the document's length; appended words are worked on together in numpy. Fingerprints have 64 bits;
each run is verified word by word in the end and cut to what holds, and equal words never differ in fingerprints, so results are exact. Documents are
independent: nothing is shuffled. A task holds ``WORDS`` words, or one document, at about 8 bytes for each power of two and word.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; each row gives one row, whatever its doc_id, so repeated rows repeat; of runs that cover the
same words the smallest period counts; all columns are kept, and ones named like the result column are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

LEAST, TIMES = 24, 3
#: Documents are worked on together up to so many words.
WORDS = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.all, self.n = np.empty(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            wider = np.empty(max(2 * len(self.all), self.n + len(more)), self.all.dtype)
            wider[: self.n] = self.all[: self.n]
            self.all = wider
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self.all[: self.n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return x


class SquareCatcher:
    """Takes words as numbers, a few or many at a time. A negative number stands between documents and must occur only once."""

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 3:
            raise ValueError("a run has at least three periods")
        self.least, self.times = least, times
        self.words = _Growing(np.int64)
        self.prints: list[_Growing] = [_Growing(np.uint64)]  # by power of two: of the words from each place on
        self.base = max(0, ((least + 2) // 3).bit_length() - 1)  # any run of a period below 2 ** base holds a block of 2 ** base and its copy
        self.longest = self.since = 0  # words of the longest document, and of the last one
        self.open = np.empty((0, 2), np.int64)  # (start, period) of squares that reach the end
        self.closed: list[np.ndarray] = []  # (start, end, period)

    def append(self, words: np.ndarray) -> None:
        before = self.words.n
        self.words.extend(words)
        cuts = np.flatnonzero(words < 0)
        edges = np.concatenate([[-1 - self.since], cuts, [len(words)]])
        self.longest = max(self.longest, int(np.diff(edges).max()) - 1)
        self.since = int(edges[-1] - edges[-2] - 1)
        fresh = []  # by power of two: the first place whose fingerprint is new
        for k in range(max(1, self.longest.bit_length())):
            if k == len(self.prints):
                self.prints.append(_Growing(np.uint64))
            mine = self.prints[k]
            fresh.append(mine.n)
            if k == 0:
                mine.extend(_mixed(words.astype(np.uint64)))
                continue
            half = 1 << k - 1
            lower = self.prints[k - 1].now
            if len(lower) - half > mine.n:
                x = lower[mine.n : len(lower) - half] * _ODD[k + 2]
                x += lower[mine.n + half :]
                x ^= x >> np.uint64(31)
                x *= _ODD[2]
                mine.extend(x)
        self._go_on(before)
        for k in range(self.base, len(fresh)):
            self._catch(k, fresh[k])

    def _go_on(self, before: int) -> None:
        """Open squares grow with the new words."""
        if len(self.open):
            s, q = self.open.T
            self.open = self.open[:0]
            self._keep(s, before + self._equal(np.full(len(q), before) - q, np.full(len(q), before)), q)

    def _catch(self, k: int, first: int) -> None:
        """Suffixes of 2 ** k words from place ``first`` on meet the catchers of the block before, at the smallest size also of their own."""
        c, h = 1 << k, self.prints[k].now
        if first >= len(h):
            return
        low = first // c
        blocks = h[max(0, low - 1) * c :: c]  # those that can be met
        found = []
        for back in (1, 0) if k == self.base else (1,):
            at = max(first, back * c)
            if at >= len(h):
                continue
            own = np.repeat(blocks[at // c - back - max(0, low - 1) :], c)[at % c : at % c + len(h) - at]
            met = np.flatnonzero(h[at : at + len(own)] == own) + at
            block = (met // c - back) * c
            found.append(np.stack([block, met - block], 1)[met > block])
        s, q = np.concatenate(found).T if found else (np.empty(0, np.int64),) * 2
        if len(s):
            known = [x for x in self.closed if len(x)]
            if known or len(self.open):
                all_known = np.concatenate([*known, np.stack([self.open[:, 0], np.full(len(self.open), self.words.n), self.open[:, 1]], 1)])
                all_known = all_known[all_known[:, 2] < c]
                if len(all_known):
                    all_known = all_known[np.argsort(all_known[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(all_known[:, 1])
                    under = np.searchsorted(all_known[:, 0], s, "right") - 1
                    apart = (under < 0) | (reach[under] < s + q + c)
                    s, q = s[apart], q[apart]
        if len(s):
            order = np.lexsort((s, q))
            s, q = s[order], q[order]
            new = np.ones(len(s), bool)
            new[1:] = (q[1:] != q[:-1]) | (s[1:] - s[:-1] != c)  # the next block at the same distance is of the same square
            s, q = s[new], q[new]
            self._keep(s - self._equal(s, s + q, -1), s + q + self._equal(s, s + q), q)

    def _equal(self, x: np.ndarray, y: np.ndarray, way: int = 1) -> np.ndarray:
        """How many words from x and from y on, y after x, are equal; to the left with way -1."""
        x0, x, y = x, x.copy(), y.copy()
        for k in range(len(self.prints) - 1, -1, -1):
            c, h = 1 << k, self.prints[k].now
            if not len(h):
                continue
            a, b = (x, y) if way > 0 else (x - c, y - c)
            same = (a >= 0) & (b < len(h))
            same &= h[np.where(same, a, 0)] == h[np.where(same, b, 0)]
            x, y = x + way * c * same, y + way * c * same
        return np.abs(x - x0)

    def _keep(self, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> None:
        ends = e == self.words.n
        self.open = np.unique(np.concatenate([self.open, np.stack([s, q], 1)[ends]]), axis=0)
        enough = ~ends & (e - s >= np.maximum(self.least, self.times * q))
        self.closed.append(np.stack([s, e, q], 1)[enough])

    def runs(self) -> np.ndarray:
        """(start, end, period) of the runs so far, by start, then period."""
        s, q = self.open.T
        found = np.concatenate([*self.closed, np.stack([s, np.full(len(s), self.words.n), q], 1)]) if self.closed or len(s) else np.empty((0, 3), np.int64)
        found = np.unique(found[found[:, 1] - found[:, 0] >= np.maximum(self.least, self.times * found[:, 2])], axis=0)
        if len(found):
            found = np.concatenate([self._verified(*r) for r in found.tolist()])
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            first = np.ones(len(found), bool)
            first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
            found = found[first]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return found

    def _verified(self, s: int, e: int, q: int) -> np.ndarray:
        """The run itself, or what is left of it if different words had one fingerprint."""
        w = self.words.now
        same = w[s : e - q] == w[s + q : e]
        if same.all():
            return np.array([[s, e, q]])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        parts = np.stack([s + edge[::2], s + edge[1::2] + q, np.full(len(edge) // 2, q)], 1)
        return parts[parts[:, 1] - parts[:, 0] >= np.maximum(self.least, self.times * q)]


def runs_of(words: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    starts = np.cumsum([0, *(len(ws) + 1 for ws in words)])
    stream = np.concatenate([np.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), -1 - i) for i, ws in enumerate(words)])
    catcher = SquareCatcher(least, times)
    for at in range(0, len(stream), WORDS):
        catcher.append(stream[at : at + WORDS])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for s, e, q in catcher.runs().tolist():
        d = int(np.searchsorted(starts, s, "right")) - 1
        out[d].append((s - int(starts[d]), e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (by start, then period) and collapsed, the text with each run cut to its first period, words joined by one blank."""

    @F.arrow_udf(f"struct<n_words:bigint,runs:{RUNS},collapsed:string>")
    def scan(texts: pa.Array) -> pa.Array:
        n, runs, kept = [], [], []

        def work(part: list[list[bytes]]) -> None:
            for ws, found in zip(part, runs_of(part, least, times), strict=True):
                n.append(len(ws))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                kept.append(b" ".join(collapsed(ws, found)))

        part, held = [], 0
        for t in texts:
            part.append((t.as_py() or "").encode().split())  # bytes: at the six ASCII blanks alone
            held += len(part[-1])
            if held >= WORDS:
                work(part)
                part, held = [], 0
        if part:
            work(part)
        one = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, one), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    name = max(docs.columns, key=len) + "_found"  # a name that no column has
    return docs.withColumn(name, scan(F.col(text))).withColumns({c: F.col(f"{name}.{c}") for c in ("n_words", "runs", "collapsed")}).drop(name)


def repeated_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the documents, chosen by crc32 of the id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    at = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + floor(h / 10) % 8) as int)"))
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast(1 + (n - a) div p as int)")))
    planted = F.array_join(F.slice(F.concat(F.slice("w", 1, F.col("a")), cycle), 1, F.col("n")), " ")
    return at.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(repeated_ends(read(spark, sf_dir, "documents"))).drop("text")
    better = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1).otherwise(0)
    order = lambda x, y: F.when(better(x, y) != 0, better(x, y)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))
    best = F.when(F.size("runs") > 0, F.get(F.array_sort("runs", order), 0))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
