"""Exact top-k by weighted overlap, block by block.

A query and an entry score the sum of the products of their weights over the terms that both have, times the entry's scale, plus its own worth.

1. Entries are dealt into blocks of bounded size by their ids' hash, queries likewise. A block of entries meets a block of queries in one task, where the products are summed by NumPy: what is shuffled are the
   terms of the entries, once for each block of queries, and those of the queries, once for each block of entries; the pairs that share a term are never rows.
2. The pairs of the first blocks are judged in full: the k best can't be below the k-th of these. Of all others only the pairs that reach this threshold leave their block, with their exact scores.

Memory is bounded by the blocks, not by long posting lists, and no term is a key. Nothing passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

from ..tables import stored

#: Entries that are judged in full, entries and queries of a block, products that are held at once.
SEED, BLOCK, QUERIES, HELD = 8192, 2048, 1024, 2_000_000


def ranked(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _scorer(held_most: int = HELD):
    """What scores a block. It is made here so that it goes to the workers as a whole, which need not have this package."""

    def parts(rows: pa.Table, key: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The rows without term, and of those with one: which of the former each belongs to, the term, the weight."""
        own, terms = rows.filter(pc.is_null(rows["n"])), rows.filter(pc.is_valid(rows["n"]))
        at = pc.index_in(terms[key], value_set=own[key].combine_chunks())
        return own, at.to_numpy(), terms["n"].to_numpy(), terms["w"].to_numpy()

    def block(entries: pa.Table, queries: pa.Table) -> pa.Table:
        """(query, id, score) of the pairs of a block that reach the query's limit."""
        own, e, e_term, e_weight = parts(entries, "id")
        asked, q, q_term, q_weight = parts(queries, "query")
        scale, worth, bare = (own[c].to_numpy() for c in ("scale", "worth", "bare"))
        limit = asked["limit"].to_numpy()
        by_term, by_entry = np.argsort(q_term), np.argsort(e, kind="stable")
        q, q_term, q_weight = q[by_term], q_term[by_term], q_weight[by_term]
        e, e_term, e_weight = e[by_entry], e_term[by_entry], e_weight[by_entry]
        first = np.searchsorted(q_term, e_term)
        many = np.searchsorted(q_term, e_term, "right") - first
        held = np.cumsum(np.bincount(e, many, len(own)) + len(asked)) // held_most
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1), len(own)]
        found = []
        for a, z in zip(cuts, cuts[1:]):
            part = slice(*np.searchsorted(e, [a, z]))
            n = many[part]
            row = np.repeat(np.arange(len(n)), n)
            term = np.arange(len(row)) + np.repeat(first[part] - (np.cumsum(n) - n), n)
            cell = (e[part][row] - a) * len(asked) + q[term]
            score = np.bincount(cell, e_weight[part][row] * q_weight[term], (z - a) * len(asked)).reshape(z - a, len(asked)) * scale[a:z, None]
            i, j = np.nonzero(((score > 0) | bare[a:z, None]) & (score + worth[a:z, None] >= limit))
            found.append((i + a, j, score[i, j]))
        i, j, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": asked["query"].take(pa.array(j)), "id": own["id"].take(pa.array(i)), "score": score})

    return block


def top_k(queries: DataFrame, entries: DataFrame, known: DataFrame, allowed: DataFrame, *, k: int, order: list[Column], met: Column | None = None, most: float = 0, unit: bool = False, bare: Column | None = None, scale: Column | None = None, tiers: Column | None = None, seed: int = SEED, digits: int | None = None) -> DataFrame:
    """The k best entries of each query: query, id, score, rank and the other columns of known and allowed.

    queries (query, t, w) and entries (id, t, w): weights above 0, each term once. known (id, worth, others): every entry once. allowed (query, others): every query once.
    ``met`` says on columns of both which pairs count at all. ``bare``, on columns of known: entries that count even without a common term. ``scale``, above 0, likewise: what the sum is multiplied with.
    ``order`` sorts by score first, which is rounded to ``digits``; then it is there unrounded, too, as ``exact``. ``seed``: entries that are judged in full at first. ``most``, ``unit`` and ``tiers`` were limits of weights, which no step needs any more.
    """
    queries = stored(queries)
    terms = stored(queries.select("t").distinct().withColumn("n", F.monotonically_increasing_id()))
    whole = scale is None and all(isinstance(df.schema["w"].dataType, IntegralType) for df in (queries, entries))
    entries = stored(entries.join(terms, "t").select("id", "n", F.col("w").cast("double").alias("w")))
    size = min(BLOCK, seed)
    blocks, groups = max(1, math.ceil(known.count() / size)), max(1, math.ceil(allowed.count() / QUERIES))
    near = 1e-9 if digits is None else 10.0**-digits  # limits are kept below what rounding may do
    own = known.select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("w"), F.col("worth").cast("double").alias("worth"), (F.lit(1.0) if scale is None else scale).alias("scale"), (F.lit(False) if bare is None else bare).alias("bare"))
    dealt = own.unionByName(entries, allowMissingColumns=True).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    words = queries.join(terms, "t").select("query", "n", F.col("w").cast("double").alias("w"))
    form = StructType([StructField("query", queries.schema["query"].dataType), StructField("id", known.schema["id"].dataType), StructField("score", DoubleType())])

    def judged(limits: DataFrame, some: int) -> DataFrame:
        left = dealt.where(F.col("b") < some).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        asked = limits.unionByName(words, allowMissingColumns=True).withColumns({"g": F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(some - 1)))})
        found = left.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInArrow(_scorer(), form)
        out = found.join(known, "id").join(allowed, "query")
        out = out if met is None else out.where(met)
        total = F.col("score").cast("long" if whole else "double") + F.col("worth")
        return out.withColumn("score", total) if digits is None else out.withColumns({"exact": total, "score": F.round(total, digits)})

    free = allowed.select("query", F.lit(float("-inf")).alias("limit"), F.lit(None).cast("long").alias("n"))
    sample = math.ceil(seed / size)
    if blocks <= sample:
        return ranked(judged(free, blocks), k, order)
    least = ranked(judged(free, sample), k, order).where(F.col("rank") == k).select("query", (F.col("score") - near).alias("_least"))
    limits = stored(free.join(least, "query", "left").withColumn("limit", F.coalesce("_least", "limit")).drop("_least"))
    return ranked(judged(limits, blocks), k, order)
