"""Grounding of utterances: intent, slots, target, required slots, command, turn record. One table-to-table job, no shuffle but the registry join.

An utterance row has session_id, turn_id, utterance, intent_id, and of its session run_ids (array) and last_referenced_entity; any of these may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

SPECS = "array<struct<slot_name:string,slot_type:string,required:boolean,fill_policy:string,default_value:string>>"
#: The slots that name an entity, first filled one wins.
ENTITY_SLOTS = ("ticket_ref", "run_ref", "workflow_ref", "gate_ref")
#: How the reference of such a slot begins.
KINDS = {"ticket_ref": "ticket", "run_ref": "run", "workflow_ref": "wf", "gate_ref": "gate"}


def registry(rows: DataFrame) -> DataFrame:
    """The intents, sorted: absent arrays are empty, required is false and fill_policy ``ask`` where unset, an empty default is none (SRC-8). Of rows that share an intent_id the least counts."""
    specs = F.transform(
        F.coalesce(F.col("slot_specs").cast(SPECS), F.array().cast(SPECS)),
        lambda s: F.struct(
            F.coalesce(s["slot_name"], F.lit("")).alias("slot_name"), F.coalesce(s["slot_type"], F.lit("")).alias("slot_type"), F.coalesce(s["required"], F.lit(False)).alias("required"),
            F.coalesce(s["fill_policy"], F.lit("ask")).alias("fill_policy"), F.nullif(s["default_value"], F.lit("")).alias("default_value"),
        ),
    )
    none = F.array().cast("array<string>")
    full = rows.withColumns({"slot_specs": specs} | {c: F.coalesce(F.col(c), none) for c in ("trigger_keywords", "example_utterances")})
    return once(full).orderBy("intent_id")


def once(intents: DataFrame) -> DataFrame:
    """One row for each intent_id, so that no utterance is multiplied by a registry that names an intent twice."""
    rank = F.row_number().over(Window.partitionBy("intent_id").orderBy(F.to_json(F.struct("slot_specs"))))
    return intents.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lookup(ids: DataFrame, intents: DataFrame) -> DataFrame:
    """Each intent_id of ids with its intent, nulls where there is none (FLT-3)."""
    return ids.join(intents, "intent_id", "left")


def trigger_keywords(ids: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent_id, trigger_keywords), an empty array for an unknown intent (FLT-5)."""
    return lookup(ids.select("intent_id"), intents).select("intent_id", F.coalesce("trigger_keywords", F.array().cast("array<string>")).alias("trigger_keywords"))


def cells(matrix: DataFrame, status: str = "filled") -> DataFrame:
    """Coverage cells of a status, ``*`` for all, by cell_id (FLT-4)."""
    return (matrix if status == "*" else matrix.where(F.col("status") == status)).orderBy("cell_id")


def with_intent(utterances: DataFrame, intents: DataFrame) -> DataFrame:
    """Utterances with ``norm``, their intent's slot_specs and ``known`` (JOIN-3). An unknown intent has no slots."""
    found = once(intents).select("intent_id", "slot_specs", F.lit(True).alias("known"))
    met = utterances.join(found, "intent_id", "left")
    return met.withColumns({"norm": fn.normalize(F.col("utterance")), "known": F.coalesce("known", F.lit(False)), "slot_specs": F.coalesce("slot_specs", F.array().cast(SPECS))})


def from_session(name: Column) -> Column:
    """What the session offers for a slot: its first run, or the entity last referred to (GRD-2)."""
    entity = F.when(name.isin("workflow_ref", "gate_ref", "ticket_ref"), F.col("last_referenced_entity"))
    return F.nullif(F.when(name == "run_ref", F.get("run_ids", F.lit(0))).otherwise(entity), F.lit(""))


def fill_slots(grounded: DataFrame) -> DataFrame:
    """Adds slots (array of struct(name, value), as declared) and missing (names of required slots that stay empty) (GRD-1).

    The value comes from the text, else from the session, else it is the default where the policy is ``default``.
    """
    found = grounded.withColumns({f"_{name}": fn.reference(F.col("norm"), kind) for name, kind in KINDS.items()} | {"_new_priority": fn.keyword_value(F.col("norm")), "_whole": F.nullif("norm", F.lit(""))})

    def value(s: Column) -> Column:
        name, kind = s["slot_name"], s["slot_type"]
        text = F.when(name == "new_priority", F.col("_new_priority")).when((kind == "free_text") & (name == "task_description"), F.col("_whole"))
        for slot in reversed(ENTITY_SLOTS):
            text = F.when((kind == "entity_ref") & (name == slot), F.col(f"_{slot}")).otherwise(text)
        return F.coalesce(text, from_session(name), F.when(s["fill_policy"] == "default", s["default_value"]))

    tried = F.transform("slot_specs", lambda s: F.struct(s["slot_name"].alias("name"), value(s).alias("value"), s["required"].alias("required")))
    out = found.withColumn("_tried", tried)
    slots = F.transform(F.filter("_tried", lambda t: t["value"].isNotNull()), lambda t: F.struct(t["name"], t["value"]))
    missing = F.transform(F.filter("_tried", lambda t: t["value"].isNull() & t["required"]), lambda t: t["name"])
    return out.withColumns({"slots": slots, "missing": missing}).drop("_tried", "_new_priority", "_whole", *[f"_{name}" for name in KINDS])


def _slot(name: Column) -> Column:
    return F.get(F.filter("slots", lambda x: x["name"] == name), F.lit(0))["value"]


def resolve_target(filled: DataFrame) -> DataFrame:
    """Adds target_id and target_concepts: the first entity slot filled, else any slot of an entity, else the session's entity (GRD-3)."""
    typed = F.filter("slots", lambda x: F.exists("slot_specs", lambda s: (s["slot_name"] == x["name"]) & (s["slot_type"] == "entity_ref")))
    ref = F.when(F.col("known"), F.coalesce(*[_slot(F.lit(n)) for n in ENTITY_SLOTS], F.get(typed, F.lit(0))["value"], F.col("last_referenced_entity")))
    return filled.withColumn("target_id", ref).withColumn("target_concepts", fn.concepts(F.col("target_id")))


def violations(filled: DataFrame) -> DataFrame:
    """Adds violations: a message for each required slot without a value (GRD-4)."""
    lacking = F.filter("slot_specs", lambda s: s["required"] & ~F.exists("slots", lambda x: x["name"] == s["slot_name"]))
    return filled.withColumn("violations", F.transform(lacking, lambda s: F.concat(F.col("intent_id"), F.lit(" requires slot '"), s["slot_name"], F.lit("'"))))


def ground(utterances: DataFrame, intents: DataFrame, *, tier: str = "registry") -> DataFrame:
    """Commands: utterances with target_id, target_concepts, slots (map), confidence, tier, reprompt_needed and reprompt_slots (GRD-5).

    Slots named in a violation's message are asked for again, too. An unknown intent gives an empty command of confidence 0. Of a slot declared twice the last value counts.
    """
    judged = violations(resolve_target(fill_slots(with_intent(utterances, intents))))
    named = F.flatten(F.transform("violations", lambda v: F.transform(F.filter("slot_specs", lambda s: F.contains(v, s["slot_name"])), lambda s: s["slot_name"])))
    again = F.array_distinct(F.concat("missing", named))
    last = F.filter("slots", lambda x, i: ~F.exists(F.slice("slots", i + 2, F.size("slots")), lambda y: y["name"] == x["name"]))
    return judged.select(
        *utterances.columns, "target_id", "target_concepts", F.map_from_entries(last).alias("slots"), F.when(F.col("known"), 1.0).otherwise(0.0).alias("confidence"),
        F.lit(tier).alias("tier"), (F.size("missing") + F.size("violations") > 0).alias("reprompt_needed"), again.alias("reprompt_slots"),
    )


def turn_records(commands: DataFrame) -> DataFrame:
    """The record of each command for the turn log (SNK-1). timestamp, duration_ms and prev_turn_id are taken from commands where they are there."""
    kinds = {"timestamp": "timestamp", "duration_ms": "int", "prev_turn_id": "string"}
    given = {c: F.col(c) if c in commands.columns else F.lit(None).cast(kind) for c, kind in kinds.items()}
    return commands.select(
        F.lit("turn").alias("type"), "turn_id", "session_id", F.coalesce(given["timestamp"], F.current_timestamp()).alias("timestamp"), "utterance", F.col("intent_id").alias("resolved_intent_id"),
        F.col("target_id").alias("resolved_target_entity_id"), F.col("target_concepts").alias("resolved_target_concepts"), F.to_json("slots").alias("slots_filled"),
        F.size("reprompt_slots").alias("reprompt_count"), (~F.col("reprompt_needed")).alias("success"), given["duration_ms"].alias("duration_ms"), given["prev_turn_id"].alias("prev_turn_id"),
    )


def append_turns(commands: DataFrame, path: str) -> None:
    """Appends the records to the turn log, a folder of JSON lines."""
    turn_records(commands).write.mode("append").option("ignoreNullFields", "false").json(path)
