"""SentencePiece encoding by sampling without replacement, and decoding.

The lattice of a text has an arc for every piece of the vocabulary that matches somewhere; a segmentation is a path. Piece
ranks become log-probabilities by Zipf's law (-log of the rank, times ``alpha``), and a path's probability is the product of
its pieces', normalised over all paths. Gumbel top-k without replacement takes the k paths whose perturbed log-probability
(log p plus Gumbel noise, seeded by the row's key) is largest.

The search is best-first over the lattice, as A-star with an exact bound: the perturbed maximum of a set of paths is itself
a Gumbel variable, so the best path is drawn arc by arc from the root, and at every arc the alternatives not taken
are one open node whose bound is a Gumbel draw with their total mass, truncated at its parent's. The best open node is
the next to be followed. After k paths the best open bound is the threshold kappa, and the inclusion score of a path is
1 - exp(-exp(log p - kappa)), the probability to be among the k.

No piece crosses a blank except at its start, so the lattice is a chain of small lattices of a word each; a task keeps those of
the words that it has met, up to ``ARCS`` arcs. Characters without a piece are arcs of their bytes, and so is a literal U+2581, which pieces
use for the blank; so decoding gives back every text exactly. Memory is bounded by ``RUN`` words and ``ARCS`` arcs, and by the longest single text.
A sample depends on its text, its key and the parameters alone, not on the rows around it.

Defined cases: null and empty texts have one segmentation, the empty one, with inclusion score 1; texts with fewer than k
segmentations have as many rows; repeated rows give equal samples; a null key is a key; an empty table gives an empty one; columns named like
an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
ALPHA = 1.0
SEED = 17
RUN = 25_000
ROWS = 256
#: Arcs of kept lattices; about 24 bytes each.
ARCS = 3_000_000
BLANK = "▁"
_UNIT = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces by length, as sorted arrays of hashes, for vectorised look-up."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        pieces: list[tuple[str, int]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.bytes_of[i] = p.replace(BLANK, " ").encode()
                if BLANK in p.lstrip(BLANK):
                    raise ValueError("a piece crosses a blank")
                pieces.append((p, i))
        rank = {i: r + 1 for r, (_, i) in enumerate(sorted(pieces, key=lambda x: (-sp.get_score(x[1]), x[1])))}
        self.logw = np.zeros(n)
        for _, i in pieces:
            self.logw[i] = -np.log(rank[i] + 1.0)
        self.unknown = -np.log(n + 1.0)
        self.longest = max(len(p) for p, _ in pieces)
        self.whole: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        # Bit tables say which hashes may be a piece of this length, or the beginning of a longer one.
        self.maybe: list[np.ndarray] = [_table(np.empty(0, np.uint64))]
        self.heads: list[np.ndarray] = [_table(np.empty(0, np.uint64))]
        heads: list[list[np.ndarray]] = [[] for _ in range(self.longest + 1)]
        for size in range(1, self.longest + 1):
            own = [(p, i) for p, i in pieces if len(p) == size]
            cps = np.frombuffer("".join(p for p, _ in own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for c in range(size):
                if c:
                    heads[c].append(h)
                h = _next(h, cps[:, c])
            o = np.argsort(h)
            self.whole.append((h[o], np.array([i for _, i in own], np.int64)[o]))
            self.maybe.append(_table(h))
        self.heads += [_table(np.concatenate([*x, np.empty(0, np.uint64)])) for x in heads[1:]]


_P = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def _next(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    h = (h ^ cp) * _P
    return h ^ (h >> np.uint64(29))


_BITS = np.uint64((1 << 16) - 1)


def _table(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(h & _BITS).astype(np.int64)] = True
    return out


def _among(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return sorted_[at] == h, at


class Lattices:
    """The lattices of many words: arcs sorted by their start, with the probability to be taken from there."""

    def __init__(self, units: list[str], v: Vocabulary, alpha: float):
        sizes = np.array([len(u) for u in units], np.int64)
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        spelt = cp.astype(np.uint64)  # as pieces spell it: the blank as U+2581, a literal U+2581 as nothing that a piece has
        spelt[cp == ord(BLANK)] = 1 << 21
        spelt[cp == ord(" ")] = ord(BLANK)
        # Each word has a node before each character and one at its end.
        first = np.cumsum(sizes + 1) - sizes - 1
        unit = np.repeat(np.arange(len(units)), sizes)
        node = np.arange(n) + unit
        left = (first + sizes)[unit] - node  # characters from here to the word's end
        nodes = n + len(units)
        src, dst, piece, w = [], [], [], []
        at, h = np.arange(n), np.zeros(n, np.uint64)
        single = np.zeros(n, bool)
        for size in range(1, v.longest + 1):
            fits = left[at] >= size
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = _next(h, spelt[at + size - 1])
            low = (h & _BITS).astype(np.int64)
            may = np.flatnonzero(v.maybe[size][low])
            hit, k = _among(v.whole[size][0], h[may])
            if hit.any():
                here, ids = at[may[hit]], v.whole[size][1][k[hit]]
                src.append(node[here])
                dst.append(node[here] + size)
                piece.append(ids)
                w.append(alpha * v.logw[ids])
                if size == 1:
                    single[here] = True
            go = v.heads[size][low]
            at, h = at[go], h[go]
        odd = np.flatnonzero(~single)  # no piece: an arc of its bytes, marked by the negative code point
        c = cp[odd].astype(np.int64)
        src.append(node[odd])
        dst.append(node[odd] + 1)
        piece.append(-1 - c)
        w.append(alpha * v.unknown * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        src, dst, piece, w = (np.concatenate(x) for x in (src, dst, piece, w))
        o = np.argsort(src, kind="stable")
        src, dst, self.piece, w = src[o], dst[o], piece[o].astype(np.int32), w[o]
        self.dst = dst.astype(np.int32)
        self.begin = np.searchsorted(src, np.arange(nodes + 1))  # the arcs of node x are begin[x] .. begin[x + 1]
        # Backwards: the log of the mass of all ways from a node to its word's end.
        beta = np.zeros(nodes)
        to_end = np.zeros(nodes, np.int64)
        to_end[node] = left
        far = to_end[src]
        by_left = np.argsort(far.astype(np.uint16) if n and left.max() < 1 << 16 else far, kind="stable")  # short numbers sort by radix
        bounds = np.r_[0, np.cumsum(np.bincount(far, minlength=1)[1:])]
        for d in range(len(bounds) - 1):
            a = by_left[bounds[d] : bounds[d + 1]]
            if not len(a):
                continue
            val = w[a] + beta[dst[a]]
            cut = np.flatnonzero(np.r_[True, src[a][1:] != src[a][:-1]])
            top = np.maximum.reduceat(val, cut)
            total = np.add.reduceat(np.exp(val - np.repeat(top, np.diff(np.r_[cut, len(a)]))), cut)
            beta[src[a][cut]] = top + np.log(total)
        self.logp = np.minimum(w + beta[dst] - beta[src], 0.0)
        # The likeliest arc of a node first, so that a draw mostly ends at the first look.
        has = np.flatnonzero(self.begin[1:] > self.begin[:-1])
        lead = self.begin[has]
        likely = np.flatnonzero(self.logp == np.repeat(np.maximum.reduceat(self.logp, lead), np.diff(np.r_[lead, len(src)])))
        likely = likely[np.r_[True, src[likely][1:] != src[likely][:-1]]]
        for x in (self.dst, self.piece, self.logp):
            x[lead], x[likely] = x[likely], x[lead]
        # Summed node by node, arc after arc, so that it does not depend on the other words.
        self.upto = np.exp(self.logp)
        stop = self.begin[has + 1]
        at = lead + 1
        while len(at):
            go = at < stop
            at, stop = at[go], stop[go]
            self.upto[at] += self.upto[at - 1]
            at = at + 1
        self.upto[self.begin[has + 1] - 1] = 2.0  # the last arc takes what rounding leaves
        self.first, self.end, self.nodes = first, first + sizes, nodes
        self.room: dict[str, np.ndarray] = {}

    def extend(self, more: Lattices) -> None:
        arcs = len(self.dst)
        self.begin = self.begin[:-1]
        for name, shift in (("begin", arcs), ("dst", self.nodes), ("first", self.nodes), ("end", self.nodes), ("piece", 0), ("logp", 0), ("upto", 0)):
            old, new = getattr(self, name), getattr(more, name)
            n, room = len(old), self.room.get(name)
            if room is None or n + len(new) > len(room):  # twice as much each time, so that each number is moved a few times only
                room = self.room[name] = np.empty(2 * (n + len(new)), old.dtype)
                room[:n] = old
            room[n : n + len(new)] = new
            room[n : n + len(new)] += old.dtype.type(shift)
            setattr(self, name, room[: n + len(new)])
        self.nodes += more.nodes


class Words:
    """The lattices of the words met so far. With more than ``ARCS`` arcs it starts anew."""

    def __init__(self, v: Vocabulary, alpha: float):
        self.v, self.alpha = v, alpha
        self.index: dict[str, int] = {}
        self.lat: Lattices | None = None

    def numbers(self, lists: list[list[str]], total: int) -> np.ndarray:
        """The number of each word of lists, whose lattices are then in ``lat``."""
        if self.lat is not None and len(self.lat.dst) > ARCS:
            self.index, self.lat = {}, None
        fresh = [u for u in dict.fromkeys(chain.from_iterable(lists)) if u not in self.index]
        if fresh:
            self.index.update(zip(fresh, count(len(self.index))))
            new = Lattices(fresh, self.v, self.alpha)
            if self.lat is None:
                self.lat = new
            else:
                self.lat.extend(new)
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, total)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1), never at the ends."""
    return ((_mix(h) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def _walk(lat: Lattices, node: np.ndarray, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws a path from each node to its end: (arcs of all walks in order, arcs of each walk)."""
    live = np.flatnonzero(node != end)
    at, steps = node[live], []
    count = np.zeros(len(node), np.int64)
    k = 0
    while len(live):
        u, arc = _uniform(seed[live] + np.uint64(k * int(_P) & _ALL)), lat.begin[at]
        over = np.flatnonzero(u > lat.upto[arc])
        while len(over):
            arc[over] += 1
            over = over[u[over] > lat.upto[arc[over]]]
        steps.append((live, arc))
        count[live] += 1
        at = lat.dst[arc]
        go = at != end[live]
        live, at = live[go], at[go]
        k += 1
    offset = np.cumsum(count) - count
    arcs = np.empty(count.sum(), np.int64)
    for k, (rows, arc) in enumerate(steps):
        arcs[offset[rows] + k] = arc
    return arcs, count


def _below(mu: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with location mu, given that they are below bound."""
    return np.where(np.isneginf(mu), -np.inf, -np.logaddexp(-bound, -(mu - np.log(-np.log(u)))))


def _rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - p), -inf where nothing else is left."""
    with np.errstate(divide="ignore"):
        return np.where(logp > -1e-13, -np.inf, np.log(-np.expm1(np.minimum(logp, -1e-300))))


def sample_runs(texts: list[str | None], keys: np.ndarray, v: Vocabulary, *, k: int, alpha: float, words: Words | None = None) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text's number, rank from 1, piece ids, log-probability, perturbed value, inclusion score), by text, then rank.

    ``words`` may be handed from call to call; it saves work.
    """
    words = words or Words(v, alpha)
    at = 0
    while at < len(texts):
        lists: list[list[str]] = []
        first, total = at, 0
        while at < len(texts) and total < RUN:
            t = texts[at]
            lists.append(_UNIT.findall(" " + t) if t else [])
            total += len(lists[-1])
            at += 1
        numbers = words.numbers(lists, total)
        yield from _sample(words.lat, numbers, np.array([len(x) for x in lists], np.int64), keys[first:at], v, k, first)


def _sample(lat, numbers, sizes, keys, v, k, first):
    n = len(sizes)
    root = -np.log(-np.log(_uniform(keys)))  # the perturbed maximum of all paths of a text
    if not len(numbers):
        yield from ((first + t, 1, np.empty(0, np.int32), 0.0, float(root[t]), 1.0) for t in range(n))
        return
    ends = np.cumsum(sizes)
    begins = ends - sizes
    place = np.arange(len(numbers)) - np.repeat(begins, sizes)
    start, stop = lat.first[numbers], lat.end[numbers]
    # For each text: its paths (arcs, unit of each arc, perturbed value) and their open nodes (bounds by arc).
    paths: list[list[dict]] = [[] for _ in range(n)]
    begin_text, begin_unit, begin_node = np.arange(n), np.zeros(n, np.int64), np.full(n, -1)
    prefix: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
    value = root.copy()
    opened = np.zeros(n, np.int64)
    for rank in range(k):
        if not len(begin_text):
            break
        # All texts that go on walk at once, each from its own place.
        count = sizes[begin_text] - begin_unit
        which = np.repeat(np.arange(len(begin_text)), count)
        offset = np.cumsum(count) - count
        occ = np.arange(count.sum()) - offset[which] + (begins[begin_text] + begin_unit)[which]
        node = start[occ].copy()
        forced = np.flatnonzero(begin_node >= 0)
        node[offset[forced]] = begin_node[forced]
        seed = _mix(keys[begin_text[which]] + np.uint64((rank + 1) * 0xD1342543DE82EF95 & _ALL)) + place[occ].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        arcs, per_occ = _walk(lat, node, stop[occ], seed)
        unit_of = np.repeat(place[occ], per_occ)
        cut = np.r_[0, np.cumsum(per_occ)][np.r_[offset, len(occ)]]
        noise = _uniform(_mix(seed[np.repeat(np.arange(len(occ)), per_occ)] ^ np.uint64(0x5851F42D4C957F2D)) + np.arange(len(arcs), dtype=np.uint64) - cut[np.repeat(which, per_occ)].astype(np.uint64))
        logp = lat.logp[arcs]
        # The log-probability up to each arc is summed text by text, so that it does not depend on the run.
        bases = np.array([prefix[t][2] if prefix[t] else 0.0 for t in begin_text])
        before = np.empty(len(arcs))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            np.cumsum(logp[i:j], out=before[i:j])
        owner = np.repeat(np.arange(len(begin_text)), np.diff(cut))
        before += bases[owner] - logp
        bound = _below(before + _rest(logp), value[begin_text][owner], noise)
        for j, t in enumerate(begin_text):
            here = slice(cut[j], cut[j + 1])
            a, un, head = arcs[here], unit_of[here], prefix[t]
            skip = len(head[0]) if head else 0
            if head:
                a, un = np.concatenate([head[0], a]), np.concatenate([head[1], un])
            paths[t].append({"arcs": a, "units": un, "skip": skip, "bound": bound[here], "before": before[here], "logp": bases[j] + float(logp[here].sum()), "g": float(value[t]), "taken": {}})
        # The best open node of each text leads to its next path.
        texts_on, units_on, nodes_on = [], [], []
        for t in begin_text:
            best = max(paths[t], key=lambda p: p["bound"].max() if len(p["bound"]) else -np.inf)
            top = best["bound"].max() if len(best["bound"]) else -np.inf
            if np.isneginf(top):
                value[t] = -np.inf
                continue
            value[t] = top
            if rank + 1 == k:
                continue
            i = int(best["bound"].argmax())
            chosen = int(best["arcs"][best["skip"] + i])
            x = int(np.searchsorted(lat.begin, chosen, side="right")) - 1  # the node that the arc starts from
            taken = best["taken"].setdefault(i, [chosen])
            others = np.setdiff1d(np.arange(lat.begin[x], lat.begin[x + 1]), taken)
            p = np.exp(lat.logp[others])
            opened[t] += 1
            u = _uniform(keys[t : t + 1] ^ _mix(np.array([opened[t]], np.uint64)))
            arc = int(others[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u[0])), len(others) - 1)])
            taken.append(arc)
            left = p.sum() - np.exp(lat.logp[arc]) if len(others) > 1 else 0.0
            mu = best["before"][i] + np.log(left) if left > 1e-300 else -np.inf
            u2 = _uniform(keys[t : t + 1] ^ _mix(np.array([opened[t] + (1 << 32)], np.uint64)))
            best["bound"][i] = _below(np.array([mu]), np.array([top]), u2)[0]
            un = int(best["units"][best["skip"] + i])
            upto = best["skip"] + i
            prefix[t] = np.append(best["arcs"][:upto], arc), np.append(best["units"][:upto], un), float(best["before"][i] + lat.logp[arc])
            texts_on.append(t)
            units_on.append(un)
            nodes_on.append(lat.dst[arc])
        begin_text, begin_unit, begin_node = np.array(texts_on, np.int64), np.array(units_on, np.int64), np.array(nodes_on, np.int64)
    for t in range(n):
        for rank, p in enumerate(paths[t]):
            score = 1.0 if np.isneginf(value[t]) else float(-np.expm1(-np.exp(min(p["logp"] - value[t], 50.0))))
            yield first + t, rank + 1, _ids(lat.piece[p["arcs"]], v), p["logp"], p["g"], score


def _ids(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces.astype(np.int32)
    parts, last = [], 0
    for i in odd:
        c = chr(-1 - int(pieces[i]))
        parts += [pieces[last:i], v.byte_id[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)]]
        last = i + 1
    return np.concatenate([*parts, pieces[last:]]).astype(np.int32)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    """Read on the driver, which hands it to the tasks: they need no file."""
    if model not in _vocabularies:
        _vocabularies[model] = Vocabulary(model)
    return _vocabularies[model]


def encode_samples(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, alpha: float = ALPHA, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """Up to k rows for each row of docs: its columns but text, and rank, ids, log_prob, perturbed, inclusion, round_trip.

    round_trip: the ids decode to the text exactly, which is checked where they are made.
    """
    added = ["rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"]
    keep = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(added, (T.IntegerType(), T.ArrayType(T.IntegerType()), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    carried = docs.select(*keep, F.col(text).alias("_text"), F.col(key).cast("string").alias("_key"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        words = Words(v, alpha)
        for whole in parts:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                own = np.array([xxhash.xxh64_intdigest(x or "\0", seed=seed) for x in b.column("_key").to_pylist()], np.uint64)
                texts = b.column("_text").to_pylist()
                # A few rows at a time, so that what is held does not grow with the batch.
                held: list[tuple] = []
                weight = 0
                for got in sample_runs(texts, own, v, k=k, alpha=alpha, words=words):
                    held.append((*got, decode_ids(got[2].tolist(), v) == (texts[got[0]] or "")))
                    weight += len(got[2])
                    if weight > 100_000:
                        yield _batch(b, keep, held)
                        held, weight = [], 0
                if held:
                    yield _batch(b, keep, held)

    return carried.mapInArrow(batches, schema)


def _batch(b: pa.RecordBatch, keep: list[str], held: list[tuple]) -> pa.RecordBatch:
    rows = pa.array([x[0] for x in held])
    ends = np.r_[0, np.cumsum([len(x[2]) for x in held])].astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[2] for x in held]).astype(np.int32)))
    more = [pa.array([x[1] for x in held], pa.int32()), ids, *(pa.array([x[i] for x in held], pa.float64()) for i in (3, 4, 5)), pa.array([x[6] for x in held])]
    return pa.RecordBatch.from_arrays([b.column(c).take(rows) for c in keep] + more, names=[*keep, "rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])


def decode_ids(ids, v: Vocabulary) -> str:
    table = v.bytes_of
    out = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of piece ids; null for null."""
    shared = SparkSession.active().sparkContext.broadcast(vocabulary(model))

    @F.pandas_udf("string")
    def texts(arrays: pd.Series) -> pd.Series:
        v = shared.value
        return arrays.map(lambda a: None if a is None else decode_ids(a.tolist() if hasattr(a, "tolist") else a, v))

    return texts(ids)


def segmented(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, rank, ids, log_prob, inclusion, round_trip): what the pipeline returns."""
    return encode_samples(docs.select("doc_id", "text"), **options).select("doc_id", "rank", "ids", "log_prob", "inclusion", "round_trip")


def encoded(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, rank, n_pieces, ids_hash, log_prob, inclusion, round_trip): what the query returns."""
    got = encode_samples(docs.select("doc_id", "text"), **options)
    return got.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.round("log_prob", 6).alias("log_prob"), F.round("inclusion", 6).alias("inclusion"), "round_trip"
    )


def op10_segment(spark, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))
