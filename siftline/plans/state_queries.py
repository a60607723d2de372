"""Queries over running state: runs that close, tokens that are used once; as batch operators and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from ..sources.scratch import shared_folder
from ..streaming import state
from .catalog import Tables, query

LIMITS = runs.Limits(requests=1500, seconds=90.0, candidates=700, cohort=100, least_verified=0.3, least_eligible=0.5, most_blocked=0.42)


@query(
    "ST-02, ST-03, ST-19",
    """WITH w AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations),
       c AS (SELECT conv_id AS run, turn AS chunk, sum(CASE WHEN length(text) < 80 THEN 0 ELSE len(w) END)::BIGINT AS attempted, sum(length(text))::BIGINT AS requests, sum(len(list_filter(w, lambda x: length(x) <= 2)))::BIGINT AS blocked,
                    sum(len(list_filter(w, lambda x: length(x) >= 5)))::BIGINT AS verified, sum(len(list_filter(w, lambda x: length(x) >= 3)))::BIGINT AS eligible, sum(length(text) / 16.0)::DOUBLE AS seconds, bool_or(text LIKE '%?%') AS stop
             FROM w GROUP BY conv_id, turn),
       t AS (SELECT *, sum(attempted) OVER o AS ta, sum(requests) OVER o AS tr, sum(verified) OVER o AS tv, sum(eligible) OVER o AS te, sum(seconds) OVER o AS ts, row_number() OVER o AS n FROM c WINDOW o AS (PARTITION BY run ORDER BY chunk)),
       i AS (SELECT *, n - coalesce(max(CASE WHEN attempted > 0 THEN n END) OVER (PARTITION BY run ORDER BY chunk), 0) AS idle FROM t),
       r AS (SELECT *, CASE WHEN stop THEN 'operator_stop_requested' WHEN attempted >= 25 AND blocked >= 0.42 * attempted THEN 'access_block_rate' WHEN idle >= 1 THEN 'no_progress'
                    WHEN ta >= 100 AND (tv < 0.3 * ta OR te < 0.5 * ta) THEN 'quality_degradation_pause' WHEN tr >= 1500 THEN 'request_cap_exhausted' WHEN ts >= 90 THEN 'time_cap_exhausted' WHEN ta >= 700 THEN 'candidate_limit_reached' END AS reason FROM i),
       e AS (SELECT run, min(chunk) AS last, arg_min(reason, chunk) AS why FROM r WHERE reason IS NOT NULL GROUP BY run)
       SELECT run, chunk, ta::BIGINT AS total_attempted, tr::BIGINT AS total_requests, ts AS total_seconds, idle, CASE WHEN last IS NULL OR chunk < last THEN 'RUNNING' WHEN chunk = last THEN 'STOPPED' ELSE 'IGNORED' END AS state,
              CASE WHEN chunk >= last THEN why END AS reason FROM r LEFT JOIN e USING (run)""",
)
def run_states(t: Tables) -> DataFrame:
    """Conversations as runs, turns as chunks of work: words are attempted, short ones blocked, long ones verified; short turns attempt nothing."""
    words, size = F.split("text", " "), F.length("text")
    count = lambda holds: F.size(F.filter(words, holds)).cast("long")
    chunks = t.conversations.select(
        F.col("conv_id").alias("run"), F.col("turn").alias("chunk"), F.when(size < 80, 0).otherwise(F.size(words)).cast("long").alias("attempted"), size.cast("long").alias("requests"), count(lambda w: F.length(w) <= 2).alias("blocked"),
        count(lambda w: F.length(w) >= 5).alias("verified"), count(lambda w: F.length(w) >= 3).alias("eligible"), (size / 16.0).alias("seconds"), F.contains("text", F.lit("?")).alias("stop_requested"),
    )
    return runs.run_states(chunks, LIMITS)


TOKENS_SQL = """WITH e AS (SELECT user_id || '-' || (day(ts) // 5) AS token, event_id AS id, ts AS tm, event_type AS kind FROM events),
       f AS (SELECT token, min(CASE WHEN kind = 'signup' THEN (tm, id) END) AS issued, min(CASE WHEN kind = 'purchase' THEN (tm, id) END) AS delivered, min(CASE WHEN kind = 'error' THEN (tm, id) END) AS revoked,
                    min(CASE WHEN kind = 'signup' THEN tm END) AS since FROM e GROUP BY token),
       j AS (SELECT e.token, id, tm, CASE WHEN issued IS NULL OR issued > (tm, id) THEN 'INVALID' WHEN revoked < (tm, id) THEN 'REVOKED' WHEN tm > since + INTERVAL 2 DAY THEN 'EXPIRED'
                    WHEN delivered IS NULL OR delivered > (tm, id) THEN 'NOT_DELIVERED' ELSE 'RECORDED' END AS o FROM e JOIN f USING (token) WHERE kind IN ('click', 'view')),
       k AS (SELECT *, row_number() OVER (PARTITION BY token, o ORDER BY tm, id) AS n FROM j)
       SELECT token, id, CASE WHEN o = 'RECORDED' AND n > 1 THEN 'DUPLICATE_IGNORED' ELSE o END AS outcome FROM k"""


def token_events(events: DataFrame) -> DataFrame:
    """A user's events of five days as a token's: signups issue it, purchases deliver, errors revoke, clicks and views submit."""
    kinds = {"signup": runs.ISSUED, "purchase": runs.DELIVERED, "error": runs.REVOKED, "click": runs.SUBMITTED, "view": runs.SUBMITTED}
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("event_type"))
    token = F.concat_ws("-", "user_id", F.expr("day(ts) div 5"))
    return events.select(token.alias("token"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))


@query("ST-13, ST-20, ST-22", TOKENS_SQL)
def token_outcomes(t: Tables) -> DataFrame:
    return runs.token_outcomes(token_events(t.events), 2 * 86_400).select("token", "id", "outcome")


@query("ST-13, ST-20, ST-22", TOKENS_SQL)
def token_stream(t: Tables) -> DataFrame:
    """The same by keyed state and timers, over a stream of the table as it stands, all of it at once: nothing comes late then."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")  # as a pattern, for the table may be one file
    outcomes = state.token_outcomes(token_events(stream), 2 * 86_400, "0 seconds")
    return state.read_through(outcomes, f"{shared_folder(t.spark)}/siftline-tokens-{uuid.uuid4().hex}").select("token", "id", "outcome")
