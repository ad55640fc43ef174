"""Grounding of a stream of utterances with what their sessions have told so far (STR-2). ``sessions.with_session`` over the same rows is the result to match.

State of a session: the first run named, the entity last referred to, the last turn and its time, and the turns that wait for the watermark. A turn is grounded once the watermark has passed it,
in the order of timestamp and turn_id, whatever the order of arrival. A turn that arrives behind the watermark is late and dropped; so is a delivery repeated, which is late or
finds its turn waiting. An event-time timer wakes a session when its first waiting turn is due, and forgets it ``idle`` after its last one. State is as large as the turns within ``late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import grounding as G
from ..operators.sessions import ENTITY, RUN, targets_by_session

_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_STATE = "run string, entity string, turn string, at bigint, waiting string"


def session_stream(utterances: DataFrame, intents: DataFrame, *, late: str = "10 minutes", idle: timedelta = timedelta(hours=12)) -> DataFrame:
    """Utterances (session_id, turn_id, timestamp, utterance, intent_id and others) with run_ids, last_referenced_entity and prev_turn_id, each once."""
    rows = utterances.where("session_id IS NOT NULL AND turn_id IS NOT NULL AND timestamp IS NOT NULL").withWatermark("timestamp", late)
    kept = [c for c in rows.columns if c not in ("run_ids", "last_referenced_entity", "prev_turn_id")]
    schema = StructType([rows.schema[c] for c in kept])
    told = targets_by_session(rows.select(*kept), intents).select("session_id", "turn_id", "timestamp", F.unix_micros("timestamp").alias("at"), "said_run", "targets", F.to_json(F.struct(*kept), _STAMP).alias("row"))
    pause = idle // timedelta(microseconds=1)

    def turns(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, entity, turn, last, waiting = state.get if state.exists else (None, None, None, None, "{}")
        due, waits = state.getCurrentWatermarkMs(), json.loads(waiting)
        for p in parts:
            for r in p.itertuples(index=False):
                name = f"{r.at}/{r.turn_id}"
                if r.at // 1000 > due and name not in waits:
                    waits[name] = [int(r.at), r.turn_id, r.said_run, list(r.targets), r.row]
        out = []
        for name, (at, turn_id, said, targets, row) in sorted(waits.items(), key=lambda x: (x[1][0], x[1][1])):
            if at // 1000 > due:
                break
            del waits[name]
            if last is not None and at - last > pause:
                run = entity = turn = None
            out.append((row, run, entity, turn))
            target = targets[(run is not None) + 2 * (entity is not None)]
            entity = {RUN: run, ENTITY: entity, None: entity}.get(target, target)
            run, turn, last = run or said, turn_id, at
        wake = min((w[0] for w in waits.values()), default=(last or 0) + pause) // 1000
        if wake > due:
            state.update((run, entity, turn, last, json.dumps(waits)))
            state.setTimeoutTimestamp(wake)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["row", "run", "entity", "turn"], dtype=object)

    got = told.groupBy("session_id").applyInPandasWithState(turns, "row string, run string, entity string, turn string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    back = got.select(F.from_json("row", schema, _STAMP).alias("r"), "run", "entity", "turn")
    return back.select("r.*", F.array_compact(F.array("run")).alias("run_ids"), F.col("entity").alias("last_referenced_entity"), F.col("turn").alias("prev_turn_id"))


def command_stream(utterances: DataFrame, intents: DataFrame, *, late: str = "10 minutes", idle: timedelta = timedelta(hours=12)) -> DataFrame:
    """The commands of ``grounding.ground``, each with its session's state at that turn."""
    return G.ground(session_stream(utterances, intents, late=late, idle=idle), intents)


def turn_log(utterances: DataFrame, intents: DataFrame, path: str, checkpoint: str, *, late: str = "10 minutes", idle: timedelta = timedelta(hours=12), **trigger) -> StreamingQuery:
    """Starts appending turn records to a folder of JSON lines; with the same checkpoint it goes on where it was stopped."""
    records = G.turn_records(command_stream(utterances, intents, late=late, idle=idle))
    out = records.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(**trigger) if trigger else out).start()
