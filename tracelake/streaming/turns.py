"""The turn flows as Structured Streaming; the batch query over the same rows is the result to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_funnel(turns: DataFrame, *, days: int = 7, slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """The funnel over a sliding window of days (STR-2). Turns later than the watermark are dropped."""
    t = turns.where("resolved_intent_id IS NOT NULL").withWatermark("timestamp", late)
    return t.groupBy(F.window("timestamp", f"{days} days", slide), F.col("resolved_intent_id").alias("intent_id")).agg(
        F.count("*").alias("total"), F.sum(F.col("success").cast("int")).alias("success_count"), F.avg("reprompt_count").alias("avg_reprompts")
    )


def previous_pairs(cur: DataFrame, prev: DataFrame, *, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Turns beside the one before, as both arrive (STR-3); pairs further apart than ``within`` are not met."""
    c = cur.select("prev_turn_id", F.col("timestamp").alias("ts"), F.col("resolved_intent_id").alias("to_intent")).withWatermark("ts", late)
    p = prev.select("turn_id", F.col("timestamp").alias("prev_ts"), F.col("resolved_intent_id").alias("from_intent")).withWatermark("prev_ts", late)
    return c.join(p, F.expr(f"prev_turn_id = turn_id AND ts >= prev_ts AND ts <= prev_ts + INTERVAL {within}"))


def once_by_id(entries: DataFrame, *, key: str = "id", time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    return entries.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tool_events(events: DataFrame, *, tools: tuple[str, ...] = ("Write", "Edit", "Bash", "Task")) -> DataFrame:
    """(id, day, tool, summary) of the audited tools (STR-1, FN-16); the id comes from the event's own time."""
    text = F.when(F.col("tool") == "Bash", F.substring("command", 1, 200)).otherwise(F.substring(F.coalesce("path", F.lit("")), 1, 80))
    stamp = F.date_format("timestamp", "yyyyMMddHHmmss")
    return events.where(F.col("tool").isin(*tools)).select(
        F.concat_ws("-", stamp, F.substring(F.sha1(F.concat_ws("|", "timestamp", "tool", text)), 1, 6)).alias("id"), F.to_date("timestamp").alias("day"), "tool", text.alias("summary")
    )
