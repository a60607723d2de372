"""Keyed state over streams: runs that close themselves, tokens with a time to live.

State is a few numbers for a key, and what has come too early: chunks that wait for an earlier one, submissions that wait for
the watermark. Both are bounded by how far arrival may stray from order, not by how long a run or a token lives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import COUNTS, DELIVERED, ISSUED, REASONS, REVOKED, SUBMITTED, Limits, reason

TOTALED = ("attempted", "requests", "verified", "eligible", "seconds")
RUN_OUT = "run string, chunk long, total_attempted long, total_requests long, total_seconds double, idle long, state string, reason string"


def run_states(chunks: DataFrame, limits: Limits) -> DataFrame:
    """The rows of runs.run_states for a stream of chunks, numbered from 1 in each run, once each; a chunk that comes before one of
    lower number waits for it, and one that comes again is dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"next": 1, "idle": 0, "closed": None, "early": {}} | {f"total_{n}": 0 for n in TOTALED}
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["chunk"] >= held["next"]:
                    counts = {n: 0 if pd.isna(row[n]) else float(row[n]) if n == "seconds" else int(row[n]) for n in (*COUNTS, "seconds")}
                    held["early"].setdefault(str(int(row["chunk"])), counts | {"stop_requested": bool(row["stop_requested"]) if not pd.isna(row["stop_requested"]) else False})
        out = []
        while (chunk := held["early"].pop(str(held["next"]), None)) is not None:
            for n in TOTALED:
                held[f"total_{n}"] += chunk[n]
            held["idle"] = 0 if chunk["attempted"] > 0 else held["idle"] + 1
            was = held["closed"]
            if was is None:
                holds = reason(chunk | held, limits)
                held["closed"] = next((name for name, yes in zip(REASONS, holds, strict=True) if yes), None)
            stage = "IGNORED" if was else "STOPPED" if held["closed"] else "RUNNING"
            out.append((key[0], held["next"], held["total_attempted"], held["total_requests"], float(held["total_seconds"]), held["idle"], stage, held["closed"]))
            held["next"] += 1
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUN_OUT.split(", ")])

    keyed = chunks.where("run IS NOT NULL AND chunk IS NOT NULL").withColumn("run", F.col("run").cast("string"))
    return keyed.groupBy("run").applyInPandasWithState(step, RUN_OUT, "held string", "append", GroupStateTimeout.NoTimeout)


TOKEN_OUT = "token string, id long, at timestamp, outcome string"
#: Cells that tokens are dealt into by hash. A cell is what Spark keeps a state, a timer and a call for; a token's facts are its own.
CELLS = 1 << 13


def judged(held: dict, mark: int, ttl: int) -> Iterator[tuple[int, int, str]]:
    """(id, at, outcome) of a token's submissions that the watermark has reached, in order; they wait no longer then."""
    waiting, facts = sorted(held["waiting"]), held["facts"]
    due = sum(at // 1000 <= mark for at, _ in waiting)
    held["waiting"] = waiting[due:]
    for event in waiting[:due]:
        came = {kind: facts[kind] < event if kind in facts else False for kind in (ISSUED, DELIVERED, REVOKED)}
        if not came[ISSUED]:
            outcome = "INVALID"
        elif came[REVOKED]:
            outcome = "REVOKED"
        elif event[0] > facts[ISSUED][0] + ttl:
            outcome = "EXPIRED"
        elif not came[DELIVERED]:
            outcome = "NOT_DELIVERED"
        else:
            outcome = "DUPLICATE_IGNORED" if held["recorded"] else "RECORDED"
            held["recorded"] = True
        yield event[1], event[0], outcome


def token_outcomes(events: DataFrame, ttl_seconds: int, late: str, cells: int = CELLS) -> DataFrame:
    """The rows of runs.token_outcomes for a stream of events (token, id, at, kind), whatever order they come in.

    A submission is judged once the watermark has reached its time, so that all that came before it is known; a timer of event
    time wakes the tokens' cell then. Once its time to live is past and nothing waits, all that is kept is that it expired; events that
    come later than `late` after newer ones may be judged without what they bring. Tokens are dealt into cells by hash, for a call
    costs far more than a token; a checkpoint goes with its number of cells."""
    ttl = ttl_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens = json.loads(state.get[0]) if state.exists else {}
        for batch in batches:
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            for token, kind, at, i in zip(batch["token"].tolist(), batch["kind"].tolist(), micros.tolist(), batch["id"].tolist(), strict=True):
                held, event = tokens.setdefault(token, {"facts": {}, "waiting": [], "recorded": False}), [at, int(i)]
                if kind == SUBMITTED:
                    held["waiting"].append(event)
                elif kind in (ISSUED, DELIVERED, REVOKED):
                    held["facts"][kind] = min(event, held["facts"].get(kind, event))
        mark = state.getCurrentWatermarkMs()
        out = [(token, *row) for token, held in tokens.items() if held["waiting"] for row in judged(held, mark, ttl)]
        first = min((min(held["waiting"])[0] for held in tokens.values() if held["waiting"]), default=None)
        if first is not None:
            state.setTimeoutTimestamp(max(first // 1000 - 1, mark + 1))
        state.update((json.dumps(tokens),))
        shown = pd.DataFrame(out, columns=["token", "id", "at", "outcome"])
        yield shown.assign(at=pd.to_datetime(shown["at"].astype("int64"), unit="us"))

    keyed = events.where("token IS NOT NULL").withColumn("token", F.col("token").cast("string")).withWatermark("at", late)
    return keyed.withColumn("cell", F.pmod(F.xxhash64("token"), F.lit(cells))).groupBy("cell").applyInPandasWithState(step, TOKEN_OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def read_through(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, into a new folder of the shared place, and reads what it wrote."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
