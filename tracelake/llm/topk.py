"""Exact top-k by inner product with a pivot table.

Vectors are turned into whole numbers, floor(scale * x). For each vector the table holds its distances to ``pivots``
reference vectors. The triangle inequality bounds the distance of a query q and a candidate x from below by
max |d(q, p) - d(x, p)| over all pivots, and |q|^2 + |x|^2 - that^2, halved, bounds their inner product from above. A query
evaluates candidates in the order of their bounds and stops when the next bound is below its k-th best score.

Candidates and queries are packed into blocks; each pair of a query block and a candidate block is a row of an
equi-join, searched on its own and returning k rows a query; the k best of those are taken per query. Blocks meet by
groups of up to ``TOGETHER`` of a side: a block stands once for each group of the other side, smaller groups where these give
too few tasks. Both sides are shuffled; copied like that, neither may be sent to all. Numbers are packed as narrow as they fit. A task holds one block of each, whatever the size of the table; the pivots are a bounded sample
(``pivots`` vectors in hash order) and the only thing that goes through the driver.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no part, nor does a null vec_id;
only vectors of one length are compared; equal scores go to the smaller vec_id; a query has no row for itself, but rows
that repeat its vec_id are left out with it; repeated rows are candidates each, as queries equal rows are one, while rows that share a vec_id but not a vector are queries each; with fewer than k candidates all are returned.
Scores are exact where they fit 64 bits; those beyond are given as the nearest number of 64 bits and tie, as are components of 2**63 and more. Distances and norms are doubles, stored as floats;
bounds have a margin for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored

K = 5
SCALE = 256
PIVOTS = 32
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
STEP = 512
#: Most blocks of a side in a group, and pairs of groups for each core at least, where blocks are enough.
TOGETHER = 64
FOR_A_CORE = 4


def scaled(vectors: DataFrame, *, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, v, dim): valid vectors only, their components as whole numbers."""
    v = F.col(embedding)
    fine = v.isNotNull() & (F.size(v) > 0) & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), F.size(v).alias("dim")).withColumn("key", F.xxhash64("v"))


def _packed(rows: DataFrame, block: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row per block: ids, vectors and distances to the pivots as binary."""

    def pack(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        v = np.stack(g["v"].to_numpy()).astype(np.int64)
        p = pivots[int(g["dim"].iloc[0])]
        d = np.stack([np.sqrt(((v.astype(float) - x) ** 2).sum(1)) for x in p.astype(float)], 1)
        v = v.astype(np.min_scalar_type(-_largest(v) - 1 if _largest(v) < 2**63 else -(2**63)))
        return pd.DataFrame({
            "dim": [int(g["dim"].iloc[0])], block: [int(g[block].iloc[0])], "ids": [g["id"].to_numpy(np.int64).tobytes()], "keys": [g["key"].to_numpy(np.int64).tobytes()],
            "width": [v.itemsize], "vs": [v.tobytes()], "ds": [d.astype(np.float32).tobytes()],
        })

    return rows.groupBy("dim", block).applyInPandas(pack, f"dim int, {block} int, ids binary, keys binary, width int, vs binary, ds binary")


def _unpacked(ids: bytes, width: int, vs: bytes, ds: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vs, f"i{width}").astype(np.int64).reshape(-1, dim), np.frombuffer(ds, np.float32).astype(float).reshape(len(i), -1)


def _largest(v: np.ndarray) -> int:
    return max(int(v.max()), -int(v.min()))


def best_of_block(q_ids, q, q_d, c_ids, c, c_d, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of the query, candidate, score) of the k best of each query in one block, and how many products were worked out."""
    q_norm, c_norm = (q.astype(float) ** 2).sum(1), (c.astype(float) ** 2).sum(1)
    most = float(max(_largest(q), 1)) * float(max(_largest(c), 1)) * q.shape[1]
    kind = float if most < 2**52 else np.int64 if most < 2**62 else object  # so that products and sums are exact
    q_w, c_w = q.astype(kind), c.astype(kind)
    far = np.ascontiguousarray(c_d.T)
    out, worked = [], 0
    for i in range(len(q_ids)):
        low = np.zeros(len(c_ids))
        for p in range(len(far)):
            np.maximum(low, np.abs(far[p] - q_d[i, p]), out=low)
        low = np.maximum(low - 1e-6 * (1 + q_d[i].max()) - 1e-6 * low, 0)  # for the rounding of roots and of the stored distances
        bound = (q_norm[i] + c_norm - low * low) / 2 + 1e-6 * (1 + q_norm[i]) + 1e-12 * c_norm
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for s in range(0, len(order), STEP):
            if len(scores) == k and bound[order[s]] < scores[-1]:
                break
            at = order[s : s + STEP]
            at = at[c_ids[at] != q_ids[i]]
            worked += len(at)
            got = c_w[at] @ q_w[i]
            got = np.array([min(max(x, 1 - 2**63), 2**63 - 1) for x in got], np.int64) if kind is object else got.astype(np.int64)
            if len(scores) == k:
                fit = got >= scores[-1]
                if not fit.any():
                    continue
                at, got = at[fit], got[fit]
            ids, scores = np.concatenate([ids, c_ids[at]]), np.concatenate([scores, got])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
        out.append((np.full(len(ids), i), ids, scores))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), worked


def groups(n_q: int, n_c: int, least: int) -> tuple[int, int]:
    """How many groups of query and of candidate blocks: no larger than TOGETHER, and ``least`` pairs of groups if blocks are enough, by more groups of candidates first."""
    q_groups = -(-n_q // TOGETHER)
    c_groups = min(n_c, max(-(-n_c // TOGETHER), -(-least // q_groups)))
    return min(n_q, max(q_groups, -(-least // c_groups))), c_groups


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, its own id left out."""
    own, all_c = scaled(queries, vec_id=vec_id, embedding=embedding, scale=scale).dropDuplicates(["id", "key"]), scaled(candidates, vec_id=vec_id, embedding=embedding, scale=scale)
    counts = {r["dim"]: r for r in all_c.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, np.ndarray] = {}
    for dim in counts:
        first = all_c.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        chosen[dim] = np.array([r["v"] for r in first], dtype=np.int64)
    if not chosen:
        return own.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    n_c = max(1, -(-max(r["n"] for r in counts.values()) // candidate_block))
    n_q = max(1, -(-own.count() // query_block))
    c_blocks = stored(_packed(all_c.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_c)).cast("int")), "cb", chosen))
    q_groups, c_groups = groups(n_q, n_c, FOR_A_CORE * queries.sparkSession.sparkContext.defaultParallelism)
    in_play = own.where(F.col("dim").isin(list(chosen)))
    q_blocks = _packed(in_play.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_q)).cast("int")), "qb", chosen)
    met = ["dim", "qg", "cg"]
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q_blocks.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "width", "vs", "ds")], F.pmod("qb", F.lit(q_groups)).alias("qg"), copies(c_groups).alias("cg"))
    held = c_blocks.select("*", F.pmod("cb", F.lit(c_groups)).alias("cg"), copies(q_groups).alias("qg"))
    n = q_groups * c_groups
    pairs = held.repartition(n, *met).join(asked.repartition(n, *met).hint("merge"), met)  # the second side's group is what a task holds

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for r in batch.to_pylist():
                dim = r["dim"]
                q_ids, q, q_d = _unpacked(r["q_ids"], r["q_width"], r["q_vs"], r["q_ds"], dim)
                a, b, s, _ = best_of_block(q_ids, q, q_d, *_unpacked(r["ids"], r["width"], r["vs"], r["ds"], dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(np.frombuffer(r["q_keys"], np.int64)[a]), pa.array(b), pa.array(s)], names=["query_id", "key", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id bigint, key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5
"""
