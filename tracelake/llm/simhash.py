"""SimHash near-duplicates through vantage-point trees over Hamming distance.

A fingerprint has one bit for each bit position that more than half of a text's shingle hashes set. Two texts link if
their fingerprints differ in at most ``radius`` bits; groups are the connected components of the links.

The search has two levels, both vantage-point:

* A forest splits the distinct fingerprints into shards. The 64 bits are cut into ``blocks`` blocks, one tree each, and a
  tree measures the Hamming distance within its block, which never exceeds the distance over all bits. Of ``radius``
  differing bits at least one block gets no more than ``rho = radius // blocks``: that is the query radius in a tree. A node of a tree has a vantage
  point and a bound: points nearer than that are inside, the others outside. By the triangle inequality a query at distance d from the vantage point can have no partner
  inside if d - rho is over the bound, and none outside if d + rho isn't: that branch is pruned. Else the query visits both, so it
  reaches its own shard and those beyond whose boundary its ball extends; of two shards only one is visited from the other, as a pair needs to meet once.
* Inside a shard, points are sorted by distance to the shard's first point; a query compares only those whose
  distance differs by at most ``radius``, over all 64 bits.

The trees are grown on the driver from at most ``sample`` fingerprints, the least by a hash, until a shard has about ``leaf`` of all points or its part of the sample can't be
split; vantage points are those of the node's points that spread the others most. The sample only shapes the trees: every point is placed and searched, and any trees give the same links.

With the default of 3 blocks rho is 1, and a ball holds 22 or 23 values of its block, so a point lies in that many shards of a tree at most, whatever their number. One tree
over all 64 bits (``blocks=1``) is exact too, but prunes little: distances crowd around 32 +- 4, and a radius of 4 reaches over a median bound for two points in three.

A shard of more than ``chunk`` points is cut into chunks by a hash, and every pair of chunks is a group of its own, so a
group never holds more than about 2 * chunk points however many fall into one shard. A group returns a spanning forest of
its links, not all pairs. Components are found by Spark joins over those edges: every point takes the smallest label
around it, then its label's label, until nothing changes.

Exact copies share a fingerprint and are settled by grouping before any search.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null doc_id gets a fingerprint but
is nobody's smallest id (its component is that of the others, null if there are none); repeated rows give repeated rows;
an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read, stored

SHINGLE = 4
RADIUS = 4
BLOCKS = 3
LEAF = 512
SAMPLE = 1 << 17
CHUNK = 8192
#: Candidates for a node's vantage point, and points that they are tried on.
TRIED = (8, 256)
#: Home points that are compared at once.
ROWS = 64
_LANES = np.array([1 << k for k in range(64)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as an unsigned number."""
    w = (text or "").encode().lower().split()  # of bytes: only A-Z and ASCII white space count
    if not w:
        return 0
    n = max(len(w) - shingle + 1, 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), seed=42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for s in range(0, n, 65_536):
        ones += np.unpackbits(h[s : s + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_LANES[ones * 2 > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, fp bigint")


@dataclasses.dataclass
class Tree:
    """Nodes by number, 0 the root: vantage point, bound, and the nodes inside and outside. A leaf has no nodes; its number is that of the shard."""

    mask: np.uint64
    point: list[int]
    bound: list[int]
    inside: list[int]
    outside: list[int]

    def place(self, fp: np.ndarray, rho: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, shard) for all shards that the balls of radius rho around the points reach."""
        todo = [(0, np.arange(len(fp)))]
        while todo:
            node, rows = todo.pop()
            if not self.inside[node]:
                yield rows, np.full(len(rows), node, np.int64)
                continue
            d = np.bitwise_count((fp[rows] ^ np.uint64(self.point[node])) & self.mask).astype(np.int64)
            for to, go in ((self.inside[node], d - rho <= self.bound[node]), (self.outside[node], d + rho > self.bound[node])):
                if go.any():
                    todo.append((to, rows[go]))


def grow(points: np.ndarray, mask: np.uint64, least: int) -> Tree:
    """A tree whose leaves have fewer than ``least`` of the given points, as far as these can be told apart under the mask."""
    tree = Tree(mask, [], [], [], [])

    def add() -> int:
        for x in (tree.point, tree.bound, tree.inside, tree.outside):
            x.append(0)
        return len(tree.point) - 1

    rng = np.random.default_rng(1)
    todo = [(add(), points & mask)]
    while todo:
        node, own = todo.pop()
        if len(own) < max(least, 2):
            continue
        tried, on = own[rng.integers(0, len(own), TRIED[0])], own[rng.integers(0, len(own), TRIED[1])]
        spread = np.bitwise_count(tried[:, None] ^ on).astype(float).var(axis=1)
        point = tried[spread.argmax()]
        d = np.bitwise_count(own ^ point)
        bound = min(int(np.median(d)), int(d.max()) - 1)
        if bound < d.min():
            continue
        tree.point[node], tree.bound[node], tree.inside[node], tree.outside[node] = int(point), bound, add(), add()
        todo += [(tree.inside[node], own[d <= bound]), (tree.outside[node], own[d > bound])]
    return tree


def forest(sample: np.ndarray, blocks: int, least: int) -> list[Tree]:
    """A tree for each block of bits."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return [grow(sample, np.uint64(sum(1 << int(k) for k in range(edges[b], edges[b + 1]))), least) for b in range(blocks)]


def shards_of(fp: np.ndarray, trees: list[Tree], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shard, home) for every shard that a row lies in (home) or that its ball reaches (not home) and that has a larger number than its home."""
    rho = radius // len(trees)
    for t, tree in enumerate(trees):
        own = np.zeros(len(fp), np.int64)
        for rows, shard in tree.place(fp, 0):
            own[rows] = shard
        for rows, shard in tree.place(fp, rho):
            go = shard >= own[rows]
            yield rows[go], (shard[go] << 8) + t, (shard == own[rows])[go]


def _forest(fp: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group: (point, root) by value. Links between two visitors are not looked for."""
    d = np.bitwise_count(fp ^ fp.min()).astype(np.int64)
    by_ring = np.lexsort((fp, d))
    ring, pts, at_home = d[by_ring], fp[by_ring], home[by_ring]
    label = np.arange(len(pts))
    owners = np.flatnonzero(at_home)
    for s in range(0, len(owners), ROWS):
        own = owners[s : s + ROWS]
        lo, hi = np.searchsorted(ring, [ring[own[0]] - radius, ring[own[-1]] + radius + 1])
        near = np.bitwise_count(pts[lo:hi] ^ pts[own][:, None]) <= radius
        for r in np.flatnonzero(near.sum(1) > 1):  # others than the point itself
            i = own[r]
            for other in np.unique(label[np.flatnonzero(near[r]) + lo]):  # a label for each component so far, so a dense group costs one step a point
                if other != label[i]:
                    label[label == max(other, label[i])] = min(other, label[i])
    later = np.flatnonzero(label != np.arange(len(pts)))
    return [(int(pts[x]), int(pts[label[x]])) for x in later]


def links(points: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, leaf: int = LEAF, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints within ``radius`` of each other, few enough to store."""
    order = F.xxhash64("fp", F.lit(3))
    chosen = points.select("fp", order.alias("o")).orderBy("o").limit(sample).select("fp").toArrow()  # at most ``sample`` numbers
    chosen = chosen["fp"].to_numpy().view(np.uint64)
    # A shard's part of the sample that stands for ``leaf`` of all points.
    trees = points.sparkSession.sparkContext.broadcast(forest(chosen, blocks, max(2, leaf * len(chosen) // max(points.count(), 1))))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, shard, home in shards_of(fp, trees.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows].view(np.int64)), pa.array(shard), pa.array(home)], names=["fp", "shard", "home"])

    placed = points.select("fp").mapInArrow(place, "fp bigint, shard bigint, home boolean")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where((F.col("n") > 1) & (F.col("homes") > 0))
    k = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    # A shard of k chunks has a group for each pair of chunks; with k = 1 that is one group.
    dealt = placed.join(sizes, "shard").select(
        "fp", "shard", "home", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))).alias("pair")
    )

    def search(key, group: pd.DataFrame) -> pd.DataFrame:
        found = _forest(group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(dtype=bool), radius)
        return pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return dealt.select("fp", "home", "shard", "pair.i", "pair.j").groupBy("shard", "i", "j").applyInPandas(search, "a bigint, b bigint")


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's connected component. Every round is stored, so none is worked out twice."""
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    label = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        now = label.select("node", "label")
        near = both.join(now, both["y"] == now["node"]).groupBy("x").agg(F.min("label").alias("m"))
        step = now.join(near, now["node"] == near["x"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = now.select(F.col("node").alias("u"), F.col("label").alias("up"))
        new = stored(step.join(up, step["label"] == up["u"], "left").select("node", "old", F.least("label", "up").alias("label")))
        moved = new.where("label <> old").limit(1).count()
        discard(label)
        label = new
        if not moved:
            discard(both)
            return label.select("node", "label")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id of its component). ``options`` are those of ``links``."""
    fps = stored(fingerprints(docs, shingle=shingle))
    points = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(stored(links(points, **options)))
    labelled = points.join(comp, points["fp"] == comp["node"], "left").select(points["fp"], "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = labelled.select("fp", "label").join(smallest, "label").select(F.col("fp").alias("p"), "component_id")
    return fps.join(of_fp, fps["fp"] == of_fp["p"]).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay. All columns unchanged.

    Rows that share the kept doc_id all stay, as they can't be told apart by it.
    """
    found = near_duplicates(docs, **options)
    first = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where(F.col("doc_id") != F.col("c")).select(F.col("doc_id").alias("_later"))
    return docs.join(first, docs["doc_id"] == first["_later"], "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
