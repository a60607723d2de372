"""Runs of work in chunks, and tokens that are used once: what running state decides, as batch operators.

The same decisions over streams are in streaming.state; tests hold the two equal for any order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_match

COUNTS = ("attempted", "requests", "blocked", "verified", "eligible")


@dataclass(frozen=True)
class Limits:
    """What ends a run; the shares are those of ST-02 and ST-03."""

    requests: int
    seconds: float
    candidates: int
    idle_chunks: int = 1
    cohort: int = 500
    least_verified: float = 0.23
    least_eligible: float = 0.204
    block_from: int = 25
    most_blocked: float = 0.40


#: Reasons in the order in which they are looked for, after a chunk; null while the run goes on.
REASONS = ("operator_stop_requested", "access_block_rate", "no_progress", "quality_degradation_pause", "request_cap_exhausted", "time_cap_exhausted", "candidate_limit_reached")


def reason(c: dict, limits: Limits):
    """The conditions of REASONS over a chunk and its run's totals, in order; works on Columns and on numbers alike."""
    blocked = (c["attempted"] >= limits.block_from) & (c["blocked"] >= limits.most_blocked * c["attempted"])
    whole = c["total_attempted"] >= limits.cohort
    poor = (c["total_verified"] < limits.least_verified * c["total_attempted"]) | (c["total_eligible"] < limits.least_eligible * c["total_attempted"])
    return (
        c["stop_requested"],
        blocked,
        c["idle"] >= limits.idle_chunks,
        whole & poor,
        c["total_requests"] >= limits.requests,
        c["total_seconds"] >= limits.seconds,
        c["total_attempted"] >= limits.candidates,
    )


def run_states(chunks: DataFrame, limits: Limits) -> DataFrame:
    """run, chunk, total_attempted, total_requests, total_seconds, idle, state, reason of each chunk (ST-02, ST-03, ST-19).

    chunks: run, chunk (its number), attempted, requests, blocked, verified, eligible, seconds, stop_requested; rows that repeat a
    chunk are one chunk, summed. Totals run on from chunk to chunk; idle counts the chunks in a row that attempted nothing. The
    first chunk for which a reason holds is STOPPED by it; those before are RUNNING, and later ones are IGNORED, with the run's
    reason. Null counts are 0; rows without a run or number are left out."""
    zero = lambda name: F.sum(F.coalesce(name, F.lit(0))).alias(name)
    whole = chunks.where("run IS NOT NULL AND chunk IS NOT NULL").groupBy("run", "chunk").agg(*(zero(n) for n in (*COUNTS, "seconds")), F.coalesce(F.max("stop_requested"), F.lit(False)).alias("stop_requested"))
    order = Window.partitionBy("run").orderBy("chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for name in ("attempted", "requests", "verified", "eligible", "seconds"):
        whole = whole.withColumn(f"total_{name}", F.sum(name).over(upto))
    number = F.row_number().over(order)
    busy = F.coalesce(F.max(F.when(F.col("attempted") > 0, F.col("_number"))).over(upto), F.lit(0))
    counted = whole.withColumn("_number", number).withColumn("idle", F.col("_number") - busy)
    conditions = reason({n: F.col(n) for n in counted.columns}, limits)
    judged = counted.withColumn("_reason", first_match(list(zip(conditions, REASONS, strict=True)), F.lit(None).cast("string")))
    end = F.min(F.when(F.col("_reason").isNotNull(), F.struct("chunk", "_reason"))).over(Window.partitionBy("run"))
    closed = judged.withColumn("_end", end)
    state = first_match([(F.col("_end").isNull() | (F.col("chunk") < F.col("_end.chunk")), "RUNNING"), (F.col("chunk") == F.col("_end.chunk"), "STOPPED")], "IGNORED")
    return closed.select("run", "chunk", "total_attempted", "total_requests", "total_seconds", "idle", state.alias("state"), F.when(state != "RUNNING", F.col("_end._reason")).alias("reason"))


#: Kinds of a token's events; others say nothing.
ISSUED, DELIVERED, REVOKED, SUBMITTED = "ISSUED", "DELIVERED", "REVOKED", "SUBMITTED"


def submission_outcome(issued: Column, delivered: Column, revoked: Column, expired: Column) -> Column:
    return first_match([(~issued, "INVALID"), (revoked, "REVOKED"), (expired, "EXPIRED"), (~delivered, "NOT_DELIVERED")], "RECORDED")


def token_outcomes(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """token, id, at, outcome of each submission (ST-13, ST-22). events: token, id, at, kind.

    A token is good from its first issue for ttl_seconds, unless revoked; a submission needs a delivery before it. The first good
    one is RECORDED, later good ones are DUPLICATE_IGNORED; others are INVALID, REVOKED, EXPIRED or NOT_DELIVERED, by what
    came before them in the order of time, then id. A token's facts are one aggregation each, so a token may have any share of all
    events. Events without a token are left out."""
    when = F.struct("at", "id")
    first = lambda kind, name: F.min(F.when(F.col("kind") == kind, when)).alias(name)
    known = events.where("token IS NOT NULL").groupBy("token").agg(first(ISSUED, "issued"), first(DELIVERED, "delivered"), first(REVOKED, "revoked"))
    asked = events.where((F.col("kind") == SUBMITTED) & F.col("token").isNotNull()).select("token", "id", "at").join(known, "token")
    before = lambda name: F.coalesce(F.col(name) < when, F.lit(False))
    expired = F.coalesce(F.col("at") > F.col("issued.at") + F.make_dt_interval(secs=F.lit(ttl_seconds)), F.lit(False))
    judged = asked.select("token", "id", "at", submission_outcome(before("issued"), before("delivered"), before("revoked"), expired).alias("outcome"))
    recorded = judged.where("outcome = 'RECORDED'").groupBy("token").agg(F.min(when).alias("recorded"))
    later = F.when((F.col("outcome") == "RECORDED") & (when > F.col("recorded")), "DUPLICATE_IGNORED").otherwise(F.col("outcome"))
    return judged.join(recorded, "token", "left").select("token", "id", "at", later.alias("outcome"))
