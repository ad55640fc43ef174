"""License scan: an exact set-similarity join of template token sets with text blocks, in DataFrame functions only.

A block is any run of ``ceil(words of the template / threshold)`` consecutive words of a document (the whole document
if it is shorter). It meets a template if it holds at least ``threshold`` of the template's distinct tokens. The tokens
of a template are ordered by their frequency in all documents; a block that meets the template must hold one of its
``|T| - ceil(threshold * |T|) + 1`` rarest tokens (prefix filter), so the join is on those. Each match is then bounded by
length (the document must have enough words), by position (only blocks around the match, and the neighbourhood must hold
enough tokens at all) and verified by counting. Exact places are those where the template's words stand in a row.

The template table is small by construction; it is broadcast if it has at most ``broadcast_rows`` tokens, else the
same join is shuffled. Nothing but counts and matches is shuffled.

Defined cases: a null text is an empty one and gets a row with no places, empty labels and score 0; equal rows give equal
rows; rows with one doc_id but other texts are judged each by its own text; a null doc_id is kept. Only doc_id and text are
read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, words

THRESHOLD = 0.8
BROADCAST_ROWS = 500_000
#: The phrases and labels of the contract.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Phrases from the public license texts and their usual notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by", "creative commons attribution license"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "creative commons zero public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_rows(base=None, extra=None, threshold: float = THRESHOLD) -> list[tuple]:
    """(id, label, base, phrase words, distinct tokens, least overlap, block length)."""
    base = BASE if base is None else base
    extra = TEMPLATES if extra is None else extra
    out = []
    for n, (label, phrase, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in extra]):
        w = phrase.split()
        t = list(dict.fromkeys(w))
        out.append((n, label, is_base, w, t, math.ceil(threshold * len(t) - 1e-9), math.ceil(len(w) / threshold - 1e-9)))
    return out


def scan_licenses(docs: DataFrame, *, base=None, extra=None, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, places (array of struct(start, label)) and
    blocks (array of struct(label, containment, start) of the best block of each template)."""
    spark = docs.sparkSession
    rows = template_rows(base, extra, threshold)
    small = sum(len(r[4]) for r in rows) <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    templates = spark.createDataFrame(rows, "tid int, label string, is_base boolean, phrase array<string>, tokens array<string>, least int, block int")
    token_rows = templates.select("*", F.explode_outer("tokens").alias("x"))
    text = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))

    # How often each template token occurs in all documents.
    seen = text.select(F.explode_outer("w").alias("x")).join(hint(token_rows.select("x").distinct()), "x").groupBy("x").agg(F.count("*").alias("n"))
    ranked = token_rows.join(seen, "x", "left").groupBy("tid").agg(
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("phrase").alias("phrase"), F.first("tokens").alias("tokens"), F.first("least").alias("least"), F.first("block").alias("block"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))).alias("order"),
    )
    prefix = ranked.select("tid", "label", "is_base", "phrase", "tokens", "least", "block", F.posexplode(F.slice("order", 1, F.size("order") - F.col("least") + 1)).alias("rank", "o")).select(
        F.col("o.x").alias("x"), "tid", "label", "is_base", "phrase", "tokens", "least", "block", "rank", (F.array_position("phrase", F.col("o.x")) - 1).cast("int").alias("off")
    )
    placed = text.select("doc_id", "text_key", *(["w"] if small else []), F.size("w").alias("n_words"), F.posexplode_outer("w").alias("p", "x"))
    met = placed.join(hint(prefix), "x")
    if not small:  # whole texts don't travel with every word: what has a template's word meets its text again
        of = text.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "w").dropDuplicates(["_id", "_key"])
        met = met.join(of, met["doc_id"].eqNullSafe(of["_id"]) & (met["text_key"] == of["_key"]))
    near = F.slice("w", F.greatest(F.col("p") - F.col("block") + 1, F.lit(0)) + 1, 2 * F.col("block") - 1)
    met = met.where(F.size(F.array_intersect(near, "tokens")) >= F.col("least"))
    start = F.col("p") - F.col("off")
    exact = F.col("is_base") & (F.col("rank") == 0) & (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    last = F.least("p", F.greatest(F.col("n_words") - F.col("block"), F.lit(0)))
    starts = F.sequence(F.least(F.greatest(F.col("p") - F.col("block") + 1, F.lit(0)), last), last)
    best = F.array_max(F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(F.slice(F.col("w"), s + 1, F.col("block")), F.col("tokens"))).alias("n"), (-s).alias("s"))))
    found = met.select("doc_id", "text_key", "label", "least", F.size("tokens").alias("of"), F.when(exact, F.struct(start.alias("start"), F.col("label").alias("label"))).alias("place"), best.alias("best"))
    block = F.when(F.col("best.n") >= F.col("least"), F.struct("label", (F.col("best.n") / F.col("of")).alias("containment"), (-F.col("best.s")).alias("start")))
    hits = found.withColumn("block", block).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"), F.collect_set("block").alias("blocks"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "places", "blocks")
    rows = text.select("doc_id", "text_key", F.size("w").alias("n_words"))
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["text_key"] == hits["_key"]), "left")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return out.select("doc_id", "text_key", "n_words", none("places"), none("blocks"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"({r[0]}, '{r[1]}', {str(r[2]).lower()}, {r[3]!r}, {len(r[4])}, {r[5]}, {r[6]})" for r in template_rows())
    return (
        r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
t(tid, label, is_base, phrase, n_tokens, least, block) AS (VALUES """
        + rows
        + r"""),
tt AS (SELECT DISTINCT tid, unnest(phrase) x FROM t),
dw AS (SELECT doc_id, len(w) n, unnest(w) x, unnest(range(0, len(w))) p FROM d),
m AS (SELECT doc_id, n, p, x, tid, label, n_tokens, least, block FROM dw JOIN tt USING (x) JOIN t USING (tid)),
s AS (SELECT doc_id, tid, label, n_tokens, least, x, unnest(range(greatest(p - block + 1, 0), least(p, greatest(n - block, 0)) + 1)) s FROM m),
b AS (SELECT doc_id, label, max(c) / n_tokens c FROM (SELECT doc_id, tid, label, n_tokens, least, s, count(DISTINCT x) c FROM s GROUP BY ALL) WHERE c >= least GROUP BY doc_id, tid, label, n_tokens),
pl AS (SELECT doc_id, label, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) p FROM d) JOIN t ON is_base AND w[p + 1] = phrase[1] AND w[p + 1:p + len(phrase)] = phrase),
pa AS (SELECT doc_id, count(*) n_base, min(p) a, max(p) z, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM pl GROUP BY doc_id),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM pl) GROUP BY doc_id),
sc AS (SELECT doc_id, max(c) score FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(a AS BIGINT) first_word, CAST(z AS BIGINT) last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, CAST(coalesce(score, 0) AS DOUBLE) score
FROM d LEFT JOIN pa USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)
"""
    )


OP2_SQL = _sql()
