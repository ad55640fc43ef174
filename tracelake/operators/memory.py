"""Memory log: validation, relations, traversal and release state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from . import matching

#: Relation name, types it may start from (empty: any), types it may point at (empty: any).
TYPED = [
    ("invalidated-by", [], ["release-note"]),
    ("resolved-by", [], ["trouble"]),
    ("rolls-back", ["release-note"], ["release-note"]),
]


def relations(entries: DataFrame) -> DataFrame:
    """(src, src_type, kind, dst) of every relation (MEM-2)."""
    e = entries.select("id", "type", F.explode("relations").alias("r"))
    return e.select(F.col("id").alias("src"), F.col("type").alias("src_type"), F.col("r.type").alias("kind"), F.col("r.target").alias("dst"))


def stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("type").agg(F.count("*").alias("cnt"))


def next_ids(entries: DataFrame) -> DataFrame:
    """The next free number of each id prefix (AGG-14)."""
    n = entries.select(F.regexp_extract("id", r"^([A-Z]+)-(\d+)$", 1).alias("prefix"), F.regexp_extract("id", r"^([A-Z]+)-(\d+)$", 2).try_cast("bigint").alias("n"))
    return n.where("n IS NOT NULL").groupBy("prefix").agg((F.max("n") + 1).alias("next"))


def typed_violations(entries: DataFrame) -> DataFrame:
    """Relations whose ends have the wrong type (MEM-5); ends that are not entries are external and pass."""
    spark = entries.sparkSession
    rules = spark.createDataFrame(TYPED, "kind string, from_types array<string>, to_types array<string>")
    dst = entries.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    r = relations(entries).join(rules, "kind").join(dst, "dst")
    bad_from = (F.size("from_types") > 0) & ~F.array_contains("from_types", F.col("src_type"))
    return r.where(bad_from | ((F.size("to_types") > 0) & ~F.array_contains("to_types", F.col("dst_type")))).select("src", "src_type", "kind", "dst", "dst_type")


#: Relation, types whose entries the rule is for (none: all), types it may lead to (none: any entry).
SHAPES = [
    ("followed-by", [], []), ("supersedes", [], []), ("refines", [], []), ("depends-on", [], []), ("released-in", [], ["release-note"]), ("verified-in", [], ["release-note"]), ("invalidated-by", [], ["release-note"]),
    ("resolved-by", ["issue-note"], ["trouble-shooting"]), ("raised", ["issue-note"], ["agent-decision", "alternatives-record", "user-decision"]), ("caused-by", ["trouble-shooting"], ["issue-note"]),
    ("analyzed-in", ["trouble-shooting"], ["episode"]), ("shows-pattern", ["episode"], ["pattern"]), ("generalized-in", ["episode"], ["pattern"]), ("rolls-back", ["release-note"], ["release-note"]),
    ("crystallized-in", ["pattern"], ["principle"]),
]
#: Relations that may start from these types only.
SUBJECTS = {"rolls-back": "release-note"}


def relation_issues(entries: DataFrame) -> DataFrame:
    """(src, src_type, kind, dst, dst_type, issue) of relations against all shapes (MEM-5): a target that is no entry or of the wrong type, a source of the wrong type. References may lead anywhere."""
    rules = entries.sparkSession.createDataFrame(SHAPES, "kind string, for_types array<string>, to_types array<string>")
    ends = entries.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"), F.lit(True).alias("known"))
    r = relations(entries).join(rules, "kind").join(ends, "dst", "left")
    meant = (F.size("for_types") == 0) | F.coalesce(F.array_contains("for_types", F.col("src_type")), F.lit(False))
    wrong = F.when(meant & F.col("known").isNull(), "target is no entry").when(meant & (F.size("to_types") > 0) & ~F.coalesce(F.array_contains("to_types", F.col("dst_type")), F.lit(False)), "target type")
    starts = F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])[F.col("kind")]
    issues = F.array_compact(F.array(wrong, F.when(starts.isNotNull() & ~F.coalesce(F.col("src_type") == starts, F.lit(False)), "source type")))
    return r.select("src", "src_type", "kind", "dst", "dst_type", F.explode(issues).alias("issue"))


def rolled_back(entries: DataFrame) -> DataFrame:
    return relations(entries).where("kind = 'rolls-back' AND src_type = 'release-note'").select(F.col("dst").alias("id")).distinct()


def current_release(entries: DataFrame) -> DataFrame:
    """(id, released): the newest release note that is no roll-back by its metadata and was not rolled back (MEM-7, TOP-2).

    Time is metadata.released_at, else created_at.
    """
    kind, at = F.try_element_at("metadata", F.lit("kind")), F.nullif(F.try_element_at("metadata", F.lit("released_at")), F.lit(""))
    notes = entries.where((F.col("type") == "release-note") & (F.coalesce(kind, F.lit("release")) != "rollback")).select("id", F.coalesce(at, F.col("created_at"), F.lit("")).alias("released"))
    return notes.join(rolled_back(entries), "id", "left_anti").orderBy(F.col("released").desc(), "id").limit(1)


def validity(entries: DataFrame) -> DataFrame:
    """(src, kind, dst, status): verified-in and invalidated-by edges, suspended where the target was rolled back (MEM-8)."""
    edges = relations(entries).where("kind IN ('verified-in', 'invalidated-by')").select("src", "kind", "dst")
    back = rolled_back(entries).select(F.col("id").alias("dst"), F.lit(True).alias("b"))
    return edges.join(back, "dst", "left").select("src", "kind", "dst", F.when(F.col("b"), "suspended").otherwise("active").alias("status"))


def revalidation(entries: DataFrame) -> DataFrame:
    """Entries whose invalidating release was rolled back, with the release that did it (MEM-10)."""
    by = relations(entries).where("kind = 'rolls-back' AND src_type = 'release-note'").select(F.col("dst"), F.col("src").alias("rollback"))
    return validity(entries).where("status = 'suspended' AND kind = 'invalidated-by'").join(by, "dst").select("src", "dst", "rollback")


def traverse(edges: DataFrame, roots: DataFrame, *, depth: int = 2, direction: str = "out") -> DataFrame:
    """(root, node, depth): every node within ``depth`` steps of each root, at its least depth (MEM-3).

    One join a round with an anti-join on what was seen; nothing is collected.
    """
    flip = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"out": edges.select("src", "dst"), "in": flip, "both": edges.select("src", "dst").unionByName(flip)}[direction].distinct()
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(steps, front["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


#: How the ids of a type begin.
PREFIXES = {"issue-note": "IN", "agent-decision": "AD", "user-decision": "UD", "alternatives-record": "AR", "trouble-shooting": "TS", "release-note": "RN", "episode": "EP", "pattern": "PT", "principle": "PR", "auditlog": "AU", "worklog": "WL"}
#: The names of relations. As predicates they are written in camel case.
RELATIONS = ("raised", "followed-by", "resolved-by", "caused-by", "released-in", "verified-in", "invalidated-by", "rolls-back", "analyzed-in", "shows-pattern", "generalized-in", "crystallized-in", "references", "supersedes", "refines", "depends-on")


def camel(name: Column) -> Column:
    """followed-by as followedBy (FN-11)."""
    words = F.initcap(F.regexp_replace(name, "[-_ ]+", " "))
    joined = F.replace(words, F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))


def all_triples(entries: DataFrame, *, types: tuple[str, ...] = tuple(PREFIXES), kinds: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(s, p, o) of entries in full: class, id, known type, texts, tags, metadata as a whole, by key and by value, relations by predicate (MEM-4).

    Targets of references that are no entries become external references with their value. Read are id, type, relations and, where there, title, text, created_at, source_path, author, tags and metadata.
    Each triple once.
    """
    e = entries.where("id <> ''")
    has = set(entries.columns)
    one = lambda p, o: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"))
    text = [one(p, F.nullif(F.col(c), F.lit(""))) for c, p in (("title", "title"), ("text", "text"), ("created_at", "createdAt"), ("source_path", "sourcePath"), ("author", "author")) if c in has]
    known_type = F.when(F.col("type").isin(*types), F.col("type"))
    rows = [F.array(one("type", F.lit("Entry")), one("entryId", F.col("id")), one("typeName", known_type), *text)]
    if "tags" in has:
        rows.append(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: one("tag", t)))
    if "metadata" in has:
        m = F.col("metadata")
        rows.append(F.when(m.isNotNull(), F.array(one("metadata", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))))).otherwise(F.array().cast("array<struct<p:string,o:string>>")))
        keys = F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))
        rows += [F.transform(keys, lambda x: one("metadataKey", x["key"])), F.transform(keys, lambda x: F.struct(F.concat(F.lit("meta/"), x["key"]).alias("p"), x["value"].alias("o")))]
    own = e.select(F.col("id").alias("s"), F.explode(F.concat(*rows)).alias("x")).select("s", "x.*").where("o IS NOT NULL")
    rel = relations(e).where(F.col("kind").isin(*kinds) & (F.col("dst") != ""))
    met = rel.join(e.select(F.col("id").alias("dst"), F.lit(True).alias("known")).distinct(), "dst", "left")
    outside = F.col("known").isNull() & (F.col("kind") == "references")
    target = F.when(outside, F.concat(F.lit("external:"), "dst")).otherwise(F.col("dst"))
    links = met.select(F.col("src").alias("s"), camel(F.col("kind")).alias("p"), target.alias("o"))
    away = met.where(outside).select(target.alias("s"), F.explode(F.array(one("type", F.lit("ExternalReference")), one("externalValue", F.col("dst")))).alias("x")).select("s", "x.*")
    return own.unionByName(links).unionByName(away).distinct()


def triples(entries: DataFrame) -> DataFrame:
    """(s, p, o) of scalar fields and relations; unknown targets of references become external (MEM-4)."""
    known = entries.select(F.col("id").alias("dst"), F.lit(True).alias("known"))
    scalars = [entries.select(F.col("id").alias("s"), F.lit(c).alias("p"), F.col(c).alias("o")) for c in ("type", "lang", "source", "created_at")]
    rel = relations(entries).join(known, "dst", "left")
    out = rel.select(F.col("src").alias("s"), F.col("kind").alias("p"), F.when(F.col("known"), F.col("dst")).otherwise(F.concat(F.lit("external:"), "dst")).alias("o"))
    for s in scalars:
        out = out.unionByName(s.where("o IS NOT NULL"))
    return out


def validate(entries: DataFrame, *, prefixes: dict[str, str] | None = None, types: tuple[str, ...] = ("release-note", "trouble", "user-decision", "episode"), kinds: tuple[str, ...] = ("references", "verified-in", "invalidated-by", "rolls-back", "resolved-by")) -> DataFrame:
    """(id, issue): missing fields, unknown types and relations, ids seen before and, with ``prefixes``, ids that don't begin as their type's do; of a line that is no entry (``bad``, see
    logs.scan_entries) the parse error alone (MEM-1)."""
    rules: list[Column] = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"missing {c}")) for c in ("id", "type", "created_at", "text")]
    rules.append(F.when(~F.col("type").isin(*types), F.concat(F.lit("unknown type "), "type")))
    rules.append(F.when(F.exists("relations", lambda r: ~r["type"].isin(*kinds)), F.lit("unknown relation")))
    rules.append(F.when(F.exists("relations", lambda r: r["target"].isNull()), F.lit("relation without target")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("created_at"))
    rules.append(F.when(F.col("id").isNotNull() & (F.col("_n") > 1), F.lit("duplicate id")))
    for kind, prefix in (prefixes or {}).items():
        rules.append(F.when((F.col("type") == kind) & (F.col("id") != "") & ~F.startswith("id", F.lit(prefix)), F.lit(f"id is not {prefix} of {kind}")))
    if "bad" in entries.columns:
        rules = [F.when(F.col("bad").isNull(), r) for r in rules] + [F.when(F.col("bad").isNotNull(), F.concat(F.lit("parse error: "), F.substring("bad", 1, 80)))]
    return entries.withColumn("_n", rank).select("id", F.explode(F.array_compact(F.array(*rules))).alias("issue"))


#: Weight of a shared tag, of a module among the tags, and of each type (0 if not named).
TAG_WEIGHT = 18
MODULE_WEIGHT = 12
TYPE_PRIORITIES = {"principle": 30, "pattern": 26, "user-decision": 24, "episode": 20, "trouble-shooting": 16, "issue-note": 14, "agent-decision": 12, "alternatives-record": 12}


def _tokens(*columns: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", *columns), F.lit("[A-Za-z0-9_.-]{3,}"), F.lit(0)), F.lower))


def relevance(nodes: DataFrame, entries: DataFrame, *, k: int = 5) -> DataFrame:
    """(node, id, score, rank): the k entries that score highest for each node (MEM-12, TOP-3).

    nodes: node, text, tags, types (the types allowed; null or empty: any). entries: id, type, title, text, tags, module,
    created_at. The score is the type's priority, 18 for each shared tag, 1 for each shared token, and 12 if the module is
    one of the node's tags; ties go by created_at, then id. An entry without overlap has its priority only, so of each type
    just the first k can rank: these count for all nodes, all others where something is shared (see ``matching.top_k``).
    """
    tok = lambda kind, *c: F.transform(_tokens(*c), lambda w: F.struct(F.concat(F.lit(kind), w).alias("t"), F.lit(1).alias("w")))
    low = lambda kind, c, w: F.transform(F.array_distinct(F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), F.lower)), lambda x: F.struct(F.concat(F.lit(kind), x).alias("t"), F.lit(w).alias("w")))
    asked = nodes.select(F.col("node").alias("query"), F.explode(F.concat(tok("word ", "text"), low("tag ", F.col("tags"), 1), low("module ", F.col("tags"), 1))).alias("x")).select("query", "x.*")
    module = F.array(F.nullif("module", F.lit("")))
    told = entries.select("id", F.explode(F.concat(tok("word ", "id", "type", "title", "text", "tags"), low("tag ", F.col("tags"), TAG_WEIGHT), low("module ", module, MODULE_WEIGHT))).alias("x")).select("id", "x.*")
    priority = F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_PRIORITIES.items() for x in p])[F.col("type")], F.lit(0))
    known = entries.select("id", "type", F.coalesce("created_at", F.lit("")).alias("created_at"), priority.alias("worth"))
    of_type = F.row_number().over(Window.partitionBy("type").orderBy("created_at", "id"))
    first = known.withColumn("_n", of_type).where(F.col("_n") <= k).select("id", F.lit(True).alias("first"))
    known = stored(known.join(first, "id", "left"))
    allowed = F.coalesce((F.size("types") == 0) | F.array_contains("types", F.col("type")), F.col("types").isNull())
    top = matching.top_k(
        asked, told, known, nodes.select(F.col("node").alias("query"), "types"), k=k, order=[F.col("score").desc(), F.col("created_at"), F.col("id")], met=allowed,
        bare=F.coalesce("first", F.lit(False)),
    )
    return top.select(F.col("query").alias("node"), "id", "score", "rank")


def active_invalidations(entries: DataFrame) -> DataFrame:
    """(src, src_type, dst, created_at) of each invalidation whose release stands, with its release's date (MEM-9)."""
    own = entries.select(F.col("id").alias("src"), F.col("type").alias("src_type"))
    release = entries.select(F.col("id").alias("dst"), "created_at")
    return validity(entries).where("status = 'active' AND kind = 'invalidated-by'").join(own, "src").join(release, "dst").select("src", "src_type", "dst", "created_at")


def digest(entries: DataFrame, *, invalidated: int = 10, candidates: int = 5) -> DataFrame:
    """(section, position, id, release): the current release, up to 10 active invalidations, how many more there are, up to 5 candidates for
    revalidation (MEM-11). Nothing where there is no release note; the current release is null where all were rolled back."""
    notes = entries.where("type = 'release-note'").select(F.lit("current").alias("section")).limit(1)
    current = notes.join(current_release(entries).withColumn("section", F.lit("current")), "section", "left").select("section", F.lit(1).alias("position"), "id", F.lit(None).cast("string").alias("release"))
    edges = validity(entries).where("kind = 'invalidated-by'")

    def first(status: str, section: str, k: int) -> DataFrame:
        top = edges.where(F.col("status") == status).orderBy("src", "dst").limit(k)
        return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("src", "dst")).alias("position"), F.col("src").alias("id"), F.col("dst").alias("release"))

    more = edges.where("status = 'active'").agg(F.count("*").alias("n")).where(F.col("n") > invalidated)
    more = more.select(F.lit("more").alias("section"), (F.col("n") - invalidated).cast("int").alias("position"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("release"))
    found = current.unionByName(first("active", "invalidated", invalidated)).unionByName(more).unionByName(first("suspended", "candidate", candidates))
    return found.join(notes.select(F.lit(True).alias("any")), F.lit(True) == F.col("any")).drop("any")


def context_pack(nodes: DataFrame, entries: DataFrame, edges: DataFrame, *, k: int = 5, depth: int = 1, max_chars: int = 1200) -> DataFrame:
    """(node, id, depth, score, text): the k entries of each node (see relevance) and what lies within ``depth`` relations of them either way, texts cut (MEM-13).

    The score is that of the entry for the node, -1 if its type is not allowed.
    """
    top = stored(relevance(nodes, entries, k=k).select("node", "id"))
    known = entries.select(F.col("id").alias("dst"))
    between = edges.select("src", "dst").join(known, "dst", "left_semi")
    steps = between.select("src", "dst").union(between.select("dst", "src")).distinct()
    seen = top.withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(steps, front["id"] == steps["src"]).select("node", F.col("dst").alias("id")).distinct()
        front = found.join(seen, ["node", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    seen = stored(seen)
    low = lambda c: F.array_distinct(F.transform(F.array_compact(c), F.lower))
    n = nodes.select("node", "types", _tokens("text").alias("n_words"), low(F.col("tags")).alias("n_tags"))
    priority = F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_PRIORITIES.items() for x in p])[F.col("type")], F.lit(0))
    e = entries.join(seen.select("id").distinct(), "id", "left_semi").select("id", "type", priority.alias("p"), F.lower("module").alias("module"), _tokens("id", "type", "title", "text", "tags").alias("e_words"), low(F.col("tags")).alias("e_tags"), F.substring("text", 1, max_chars).alias("text"))
    met = seen.join(n, "node").join(e, "id")
    in_module = F.coalesce((F.col("module") != "") & F.array_contains("n_tags", F.col("module")), F.lit(False)).cast("int")
    shared = F.coalesce(F.size(F.array_intersect("n_words", "e_words")), F.lit(0)) + TAG_WEIGHT * F.coalesce(F.size(F.array_intersect("n_tags", "e_tags")), F.lit(0))
    allowed = F.coalesce((F.size("types") == 0) | F.array_contains("types", F.col("type")), F.col("types").isNull())
    return met.select("node", "id", "depth", F.when(allowed, F.col("p") + shared + MODULE_WEIGHT * in_module).otherwise(-1).alias("score"), "text")


def follow_up(entries: DataFrame, *, trouble: str = "trouble", episode: str = "episode") -> DataFrame:
    """(module, trouble_at, episode_at): modules whose newest trouble is later than their newest episode, or that have none (MEM-15)."""
    newest = lambda kind: F.max(F.when(F.col("type") == kind, F.col("created_at")))
    by = entries.groupBy("module").agg(newest(trouble).alias("trouble_at"), newest(episode).alias("episode_at"))
    return by.where("trouble_at IS NOT NULL AND (episode_at IS NULL OR trouble_at > episode_at)")


def write_back(results: DataFrame, *, allowed: tuple[str, ...] = (), halt_on: tuple[str, ...] = (), requires_review: bool = True) -> DataFrame:
    """results (type of the item, action of a control event, either may be null) with status, reason, requires_review and halted (MEM-16).

    An item is proposed unless its type is not allowed (no list: all are); a user's decision never is.
    """
    user, barred = F.col("type") == "user-decision", ~F.col("type").isin(*allowed) if allowed else F.lit(False)
    item = F.col("type").isNotNull()
    reason = F.when(user, "a user's decision is not recorded by an execution").when(barred, "type not allowed")
    return results.withColumns({
        "status": F.when(item, F.when(user | barred, "rejected").otherwise("proposed")), "reason": F.when(item, reason),
        "requires_review": F.when(item, F.lit(requires_review)), "halted": F.coalesce(F.col("action").isin(*halt_on), F.lit(False)) if halt_on else F.lit(False),
    })


def fingerprint(entries: DataFrame, columns: tuple[str, ...] = ("id", "type", "text", "created_at")) -> DataFrame:
    """(fingerprint): SHA-256 over the entries ordered by id (AGG-21). Each entry is hashed on its own, then ever larger blocks by the id's hash, so no row holds many of them."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    blocks = entries.select(F.sha2("id", 256).alias("block"), F.concat_ws(":", "id", row).alias("h"))
    for size in (9, 6, 3, 0):
        joined = F.array_join(F.array_sort(F.collect_list("h")), ",")
        blocks = blocks.withColumn("block", F.substring("block", 1, size)).groupBy("block").agg(F.sha2(joined, 256).alias("h")).withColumn("h", F.concat_ws(":", "block", "h"))
    return blocks.select(F.substring("h", 2, 64).alias("fingerprint"))


def overall_status(units: DataFrame, *, by: str = "workflow") -> DataFrame:
    """(workflow, status): completed if all units are, active if any is, else pending (AGG-19). A unit without status counts as neither."""
    status = F.coalesce("status", F.lit("unknown"))
    rolled = F.when(F.bool_and(status == "completed"), "completed").when(F.bool_or(status == "active"), "active").otherwise("pending")
    return units.groupBy(by).agg(rolled.alias("status"))


def harness_manifest(nodes: DataFrame) -> DataFrame:
    """(node, harness, on_fail, shared): nodes with a harness, on_fail ``block`` where unset, and how many nodes use the same one (AGG-20)."""
    own = nodes.where("harness IS NOT NULL").select("node", "harness", F.coalesce("on_fail", F.lit("block")).alias("on_fail"))
    return own.join(own.groupBy("harness").agg(F.count("*").alias("shared")), "harness").select("node", "harness", "on_fail", "shared")
