"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is a set of words. Two lines match if the Jaccard similarity of their sets is at least ``threshold``; of matching
lines the later ones (by doc_id, then line number) are removed. Matches are judged on the input: a line goes if any
earlier line matches it, also one that goes itself.

Lines with equal sets are one class, settled by grouping, so a line that a third of all documents repeat costs one row. For
the rest the words of each set are ordered by rarity. Two sets of sizes m and n match only if they share
``ceil(t / (1 + t) * (m + n))`` words, so they share one of the ``n - ceil(t * n) + 1`` rarest of each (prefix filter);
sizes must be within t of each other (length filter), and the words from the shared one on must suffice (positional
filter). Of each set the parity of its words in 64 or 128 bits is kept: sets differ in at least as many words as these
in bits. What passes is verified by the whole sets. Rarity is counted over all documents in ``BUCKETS`` buckets of words, a
table of fixed size, and told in ``LEVELS`` levels; any fixed order is exact, a rarer prefix only makes fewer candidates.

Crowds of near copies are thinned out first: classes that agree in a sketch (their three least or greatest word hashes)
with at least ``CROWD`` others meet the earliest of these alone. Whoever matches it has no need of other partners. All the rest
meet in the prefix join, whose hot words Spark can split, as both sides are shuffled for the join alone.

Words are told by 64-bit hashes, which decide a match, and a class by a 64-bit hash of these; in the prefix join words are told by their level and 26 bits,
where an accidental equality only makes a candidate more. Lines of fewer than ``min_words`` different words have no match and stay;
lines without words always stay.

Defined cases: a null text has no line and stays null; an empty line has no words and stays; an empty text stays empty; a text whose
lines all go becomes empty, its row stays; repeated rows are told apart by nothing and keep the same lines; a null
doc_id comes before all others; all columns of the input are kept, and only text changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, read, row_key, stored

THRESHOLD = 0.8
MIN_WORDS = 1
BUCKETS = 131_072
#: 64-bit numbers of the table of named lines.
NAMED = 65_536
#: Sketches that fewer classes share are left to the prefix join.
CROWD = 16
#: Sets of more words have 128 bits of parity.
LONG = 60
#: Two for each doubling of the words in a bucket; six bits.
LEVELS = 64
#: Bits of a word's hash that stand after its level in a sort key of 32 bits.
_KEPT = 26
#: What stands between words of a comparable line, as GAP. Single characters are looked up in one table, which is faster than ranges; what was taken is not given back.
_BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]++"
#: Words repeat, so a large dictionary makes their stored hashes short.
_DICTIONARY = {"parquet.dictionary.page.size": 16 << 20}


def _constant(numbers: list[int]) -> Column:
    """A table of a fixed number of rows as one folded constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _least(n: Column, threshold: float) -> Column:
    """ceil(threshold * n), safe from rounding."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)  # by the low six bits


def _comparable(line: Column) -> Column:
    """Equal for lines that are equal but for the case of A-Z, and made of the same words. (translate takes ten times as long.)

    lower() would also change letters outside ASCII. Read as Latin-1, the bytes of such letters may change, but no two of them become one: lower() only
    turns the first byte of a two-byte letter into that of a longer one.
    """
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")))


def _hashes(line: Column) -> Column:
    """The 64-bit hashes of the different words of a line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(_comparable(line), _BETWEEN), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def line_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, n, cid, hs, b1, b2) of every line: its size, class, the hashes of its words and parities.

    b1 has the parity of all words by the low six bits of their hashes, b2 of long sets that of the words with the bit above.
    """
    texts = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.split(F.col("text"), "\n").alias("ls"))
    at = texts.select("doc_id", "text_key", F.posexplode_outer("ls").alias("line_no", "line"))
    sets = at.select("doc_id", "text_key", "line_no", F.sort_array(_hashes(F.col("line"))).alias("hs"))
    none = F.lit(0).cast("bigint")
    low = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    parity = F.aggregate("hs", none, lambda a, h: a.bitwiseXOR(_shifted(F.lit(1).cast("bigint"), low(h))))
    above = F.aggregate("hs", none, lambda a, h: a.bitwiseXOR(_shifted(F.shiftright(h, 6).bitwiseAND(F.lit(1)), low(h))))
    return sets.select("*", F.size("hs").alias("n"), F.xxhash64("hs").alias("cid"), parity.alias("b1"), F.when(F.size("hs") > LONG, above).otherwise(none).alias("b2"))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _level_table(sets: DataFrame) -> Column:
    """For each bucket of words its level by the number of words in it, from -LEVELS / 2. Levels are short to write, as plans are kept as text, too."""
    seen = sets.select(F.explode("hs").alias("h")).groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("n")).toArrow()  # at most BUCKETS rows, whatever the input
    levels = [-LEVELS // 2] * BUCKETS
    for b, n in zip(seen["b"].to_pylist(), seen["n"].to_pylist(), strict=True):
        levels[b] += min(LEVELS - 1, int(2 * math.log2(n + 1)))
    return _constant(levels).cast("array<int>")


def line_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(cid, place, n, b1, b2, prefix, k1, k2): each class with its first place. A set too small to match any but its equal has no prefix."""
    table = _level_table(sets)
    level = lambda h: F.shiftleft(F.get(table, _bucket(h)), _KEPT)
    keys = F.transform("hs", lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 64 - _KEPT).cast("int")))
    size = F.when(F.col("n") >= _least(F.col("n") + 1, threshold), F.col("n") - _least(F.col("n"), threshold) + 1).otherwise(0)
    prefix = F.slice(F.sort_array(keys), 1, size)
    rows = sets.select(
        "cid", F.struct("doc_id", "line_no", "text_key").alias("place"), "n", "b1", "b2", prefix.alias("prefix"),
        F.xxhash64(F.slice("hs", 1, 3)).alias("k1"), F.xxhash64(F.slice("hs", -3, 3)).alias("k2"),
    )
    same = [F.first(c).alias(c) for c in ("n", "b1", "b2", "prefix", "k1", "k2")]  # functions of the set, so equal in a class
    return rows.groupBy("cid").agg(F.min("place").alias("place"), *same)


def _need(a_n: Column, b_n: Column, threshold: float) -> Column:
    return _least(a_n + b_n, threshold / (1 + threshold))


def _differing(a_n: Column, a_b1: Column, a_b2: Column, b_n: Column, b_b1: Column, b_b2: Column) -> Column:
    """Both sets together have at least so many words that the other lacks."""
    whole, above = a_b1.bitwiseXOR(b_b1), a_b2.bitwiseXOR(b_b2)
    return F.when((a_n > LONG) & (b_n > LONG), F.bit_count(above) + F.bit_count(whole.bitwiseXOR(above))).otherwise(F.bit_count(whole))


def _alike(a_n: Column, a_b1: Column, a_b2: Column, b_n: Column, b_b1: Column, b_b2: Column, threshold: float) -> Column:
    """The length filter, then the parities."""
    long_enough = (a_n >= b_n * (threshold - 1e-9)) & (b_n >= a_n * (threshold - 1e-9))
    return long_enough & (_differing(a_n, a_b1, a_b2, b_n, b_b1, b_b2) <= (a_n + b_n) * ((1 - threshold) / (1 + threshold) + 1e-9))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The cids of pairs (cid, mine, theirs) whose lines match, compared by their whole sets. A stored table.

    A table of a fixed number of bits says which lines no pair names; those are not shuffled. When it fills up, the joins decide.
    """
    pairs = stored(pairs)

    def spot(key: str, no: str) -> Column:
        return F.xxhash64(key, no).bitwiseAND(F.lit(NAMED * 64 - 1))

    named = pairs.select(spot("mine.text_key", "mine.line_no").alias("s")).unionAll(pairs.select(spot("theirs.text_key", "theirs.line_no")))
    bit = _shifted(F.lit(1).cast("bigint"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    bits = [0] * NAMED
    for r in named.groupBy(F.shiftright("s", 6).cast("int").alias("b")).agg(F.bit_or(bit).alias("v")).collect():  # at most NAMED rows
        bits[r["b"]] = r["v"]
    s = spot("text_key", "line_no")
    is_named = F.call_function("shiftright", F.get(_constant(bits), F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    lines = sets.where(is_named).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("line_no").alias("_no"), F.col("hs").alias("_h"))

    def hashes(df: DataFrame, place: str, out: str) -> DataFrame:
        met = df.join(lines, F.col(f"{place}.doc_id").eqNullSafe(F.col("_id")) & (F.col(f"{place}.text_key") == F.col("_key")) & (F.col(f"{place}.line_no") == F.col("_no")))
        return met.withColumnRenamed("_h", out).drop("_id", "_key", "_no")

    both = hashes(hashes(pairs, "theirs", "ha"), "mine", "hb").select("cid", F.size(F.array_intersect("ha", "hb")).alias("shared"), (F.size("ha") + F.size("hb")).alias("of"))
    out = stored(both.where(F.col("shared") >= _least(F.col("of") - F.col("shared"), threshold)).select("cid").distinct())
    discard(pairs)
    return out


def _of_crowds(classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(cid): classes that match the earliest of a crowd. Crowds are counted first, by their sketches alone, so only their members are ordered."""
    rows = classes.where(F.size("prefix") > 0).select(F.explode(F.array("k1", "k2")).alias("k"), "cid", "place", "n", "b1", "b2")
    crowds = stored(rows.groupBy("k").agg(F.count("*").alias("g")).where(F.col("g") >= CROWD).select("k"))
    rows = rows.join(crowds, "k", "left_semi")
    heads = rows.groupBy("k").agg(F.min(F.struct("place", "cid", "n", "b1", "b2")).alias("head"))
    both = [F.col(f"{side}{c}") for side in ("", "head.") for c in ("n", "b1", "b2")]
    near = F.min(F.struct(_differing(*both).alias("d"), F.col("head.place").alias("theirs")))
    met = rows.join(heads, "k").where((F.col("cid") != F.col("head.cid")) & _alike(*both, threshold))
    nearest = met.groupBy("cid").agg(F.min("place").alias("mine"), near.alias("near"))
    out = _verified(nearest.select("cid", "mine", "near.theirs"), sets, threshold)
    discard(crowds)
    return out


def _by_prefix(classes: DataFrame, matched: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(cid): classes, matched ones left out, that match an earlier one."""
    late = classes.join(matched.withColumn("late", F.lit(1)), "cid", "left").withColumn("late", F.coalesce("late", F.lit(0)))
    # Where ids are numbers they tell which of two is earlier: an earlier one has no use for a later one that is matched already, as the head of a crowd for its members.
    kind = classes.schema["place"].dataType["doc_id"].dataType
    order = F.coalesce(F.col("place.doc_id").cast("bigint"), F.lit(-(2**63))) if isinstance(kind, T.IntegralType) else F.lit(0).cast("bigint")
    tokens = late.select("cid", "n", "late", "b1", "b2", order.alias("d"), F.posexplode("prefix").alias("i", "x"))
    # Narrow rows: n, i and late in one number.
    packed = tokens.select("x", "cid", (_shifted(F.col("n").cast("bigint"), F.lit(32)) + 2 * F.col("i") + F.col("late")).alias("m"), "b1", "b2", "d")
    a, b = (packed.select("x", *[F.col(c).alias(f"{side}{c}") for c in ("cid", "m", "b1", "b2", "d")]) for side in ("a_", "b_"))
    met = a.join(b, (a["x"] == b["x"]) & (F.col("a_cid") < F.col("b_cid")) & _fits(threshold))
    is_late = lambda side: F.col(f"{side}m").bitwiseAND(F.lit(1)) == 1
    pairs = met.select("a_cid", is_late("a_").alias("a_late"), "b_cid", is_late("b_").alias("b_late")).distinct()
    places = classes.select("cid", "place")
    for side in ("a", "b"):
        pairs = pairs.join(places.select(F.col("cid").alias(f"{side}_cid"), F.col("place").alias(f"{side}_place")), f"{side}_cid")
    a_first = F.col("a_place") < F.col("b_place")
    turned = pairs.select(
        F.when(a_first, F.col("b_cid")).otherwise(F.col("a_cid")).alias("cid"), F.when(a_first, F.col("b_late")).otherwise(F.col("a_late")).alias("late"),
        F.greatest("a_place", "b_place").alias("mine"), F.least("a_place", "b_place").alias("theirs"),
    )
    return _verified(turned.where("NOT late").drop("late"), sets, threshold)


def _fits(threshold: float) -> Column:
    """All filters for two packed rows that share a prefix word; pairs whose later one is surely matched already are out."""
    unpacked = {f"{s}{c}": v for s in ("a_", "b_") for c, v in (
        ("n", F.shiftright(f"{s}m", 32).cast("int")), ("i", F.shiftright(F.col(f"{s}m").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")), ("late", F.col(f"{s}m").bitwiseAND(F.lit(1)) == 1), ("b1", F.col(f"{s}b1")), ("b2", F.col(f"{s}b2")),
    )}
    u = unpacked.__getitem__
    left = F.least(u("a_n") - u("a_i"), u("b_n") - u("b_i"))
    return _alike(*[u(f"{s}{c}") for s in ("a_", "b_") for c in ("n", "b1", "b2")], threshold) & (left >= _need(u("a_n"), u("b_n"), threshold)) & (~u("a_late") | (F.col("b_d") >= F.col("a_d"))) & (~u("b_late") | (F.col("a_d") >= F.col("b_d"))) & ~(u("a_late") & u("b_late"))


def removed_lines(docs: DataFrame, *, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line_no) of every line that an earlier line matches."""
    sets = stored(line_sets(docs), **_DICTIONARY)
    own = sets.where(F.col("n") >= max(min_words, 1))
    classes = stored(line_classes(own, threshold))
    crowded = _of_crowds(classes, sets, threshold)
    late = crowded.unionByName(_by_prefix(classes, crowded, sets, threshold)).withColumn("late", F.lit(True))
    # A line goes if its class has an earlier line, or if its class has an earlier match.
    judged = classes.select("cid", F.col("place").alias("first")).join(late, "cid", "left")
    at = own.select("cid", F.struct("doc_id", "line_no", "text_key").alias("place"))
    gone = stored(at.join(judged, "cid").where(F.col("late") | (F.col("place") > F.col("first"))).select("place.*").distinct())
    discard(sets, classes)
    return gone.select("doc_id", "text_key", "line_no")


def dedup_lines(docs: DataFrame, *, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """docs with the later matches of earlier lines taken out of text; ``removed`` names a column for their numbers."""
    gone = removed_lines(docs, threshold=threshold, min_words=min_words).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_gone")
    # Hashed, not sorted: whole texts are shuffled, but not ordered.
    met = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["_id"]) & (row_key(docs["text"]) == gone["_key"]), "left")
    ls = F.split(docs["text"], "\n")
    parts = F.array(F.struct(ls.alias("ls"), F.col("_gone").alias("gone")))  # named once, as a lambda works out again what it reads from outside
    numbers = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p["ls"]) - 1), p["gone"])
    kept = F.transform(parts, lambda p: F.array_join(F.transform(numbers(p), lambda i: F.get(p["ls"], i)), "\n"))
    text = F.when(F.col("_gone").isNull(), docs["text"]).otherwise(F.get(kept, F.lit(0)))
    out = met.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    return out.withColumnRenamed("_gone", removed) if removed else out.drop("_gone")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), removed="gone")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("gone"))
    return found.select("doc_id", n.cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line_no, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) w FROM l),
c AS (SELECT w, len(w) n, min((doc_id, line_no)) first, row_number() OVER () cid FROM s WHERE len(w) >= 1 GROUP BY w),
t AS (SELECT cid, n, unnest(w) x FROM c),
f AS (SELECT x, count(*) k FROM t GROUP BY x),
o AS (SELECT cid, n, x, row_number() OVER (PARTITION BY cid ORDER BY k, x) r FROM t JOIN f USING (x)),
p AS (SELECT * FROM o WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.cid a, b.cid b FROM p a JOIN p b ON a.x = b.x AND a.cid <> b.cid AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
m AS (SELECT DISTINCT b.cid FROM q JOIN c a ON a.cid = q.a JOIN c b ON b.cid = q.b
  WHERE a.first < b.first AND len(list_intersect(a.w, b.w)) >= 0.8 * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9),
g AS (SELECT s.doc_id, s.line_no FROM s JOIN c USING (w) LEFT JOIN m USING (cid) WHERE m.cid IS NOT NULL OR (s.doc_id, s.line_no) > c.first),
k AS (SELECT s.doc_id, count(g.line_no) n_removed, coalesce(string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY s.line_no), '') kept
  FROM s LEFT JOIN g USING (doc_id, line_no) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""
