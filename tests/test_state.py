"""Running state: streams equal the batch operators, whatever order rows arrive in; batch operators equal plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.operators import runs
from siftline.streaming import state

CHUNKS = "run string, chunk long, attempted long, requests long, blocked long, verified long, eligible long, seconds double, stop_requested boolean"
LIMITS = runs.Limits(requests=25, seconds=60.0, candidates=120, idle_chunks=2, cohort=30)


def random_chunks(rng, n=25):
    rows = []
    for r in range(n):
        for c in range(1, rng.randrange(2, 12)):
            attempted = rng.choice([0, 5, 10, 25, 40])
            rows.append((f"r{r}", c, attempted, rng.choice([None, 1, 5, 9]), rng.randrange(attempted + 1) // rng.choice([1, 4]), rng.randrange(attempted + 1), attempted, rng.choice([None, 1.5, 20.0]), rng.random() < 0.03))
    return rows


def plain_runs(rows):
    out = []
    for r in sorted({x[0] for x in rows}):
        total, idle, closed = [0] * 5, 0, None
        for _, c, att, req, blo, ver, eli, sec, stop in sorted(x for x in rows if x[0] == r):
            total = [a + (b or 0) for a, b in zip(total, (att, req, ver, eli, sec))]
            idle = 0 if att else idle + 1
            was = closed
            if closed is None:
                checks = [stop, att >= 25 and blo >= 0.4 * att, idle >= 2, total[0] >= 30 and (total[2] < 0.23 * total[0] or total[3] < 0.204 * total[0]), total[1] >= LIMITS.requests, total[4] >= LIMITS.seconds, total[0] >= LIMITS.candidates]
                closed = next((n for n, h in zip(runs.REASONS, checks) if h), None)
            out.append((r, c, total[0], total[1], float(total[4]), idle, "IGNORED" if was else "STOPPED" if closed else "RUNNING", closed))
    return sorted(map(str, out))


def arrive(spark, tmp_path, rows, schema, rng, files=6):
    """The rows in files, in any order; a stream that reads one file at a time."""
    rows = rows[:]
    rng.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_runs_match_a_plain_loop_and_cover_all_reasons(spark):
    rows = random_chunks(random.Random(1), 200)
    got = runs.run_states(spark.createDataFrame(rows, CHUNKS), LIMITS)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_runs(rows)
    assert {r.reason for r in got.collect()} == {None, *runs.REASONS}
    assert runs.run_states(spark.createDataFrame([], CHUNKS), LIMITS).count() == 0
    odd = [(None, 1, 1, 1, 0, 1, 1, 1.0, False), ("a", None, 1, 1, 0, 1, 1, 1.0, False), ("a", 1, 2, 30, 0, 2, 2, 1.0, None), ("a", 1, 3, 30, 0, 3, 3, 1.0, False)]
    assert [tuple(r) for r in runs.run_states(spark.createDataFrame(odd, CHUNKS), LIMITS).collect()] == [("a", 1, 5, 60, 2.0, 0, "STOPPED", "request_cap_exhausted")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_runs_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_chunks(rng)
    stream = arrive(spark, tmp_path, rows + rng.sample(rows, 10), CHUNKS, rng)  # some come twice
    got = state.read_through(state.run_states(stream, LIMITS), f"file://{tmp_path}/out").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_runs(rows)


EVENTS = "token string, id long, at timestamp, kind string"
START = datetime(2024, 1, 1)


def random_events(rng, n=400):
    kinds = [runs.ISSUED, runs.DELIVERED, runs.SUBMITTED, runs.SUBMITTED, runs.SUBMITTED, "OTHER"]
    rows = [(rng.choice([*"abcdefghijklmnop", None]), i, START + timedelta(minutes=rng.randrange(600)), rng.choice(kinds) if rng.random() > 0.03 else runs.REVOKED) for i in range(n)]
    return rows


def plain_tokens(rows, ttl):
    out = []
    for t in sorted({r[0] for r in rows if r[0]}):
        issued = delivered = revoked = None
        recorded = False
        for _, i, at, kind in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1])):
            if kind == runs.ISSUED:
                issued = issued or at
            elif kind == runs.DELIVERED:
                delivered = True
            elif kind == runs.REVOKED:
                revoked = True
            elif kind == runs.SUBMITTED:
                bad = "INVALID" if not issued else "REVOKED" if revoked else "EXPIRED" if at > issued + timedelta(seconds=ttl) else None if delivered else "NOT_DELIVERED"
                out.append((t, i, bad or ("DUPLICATE_IGNORED" if recorded else "RECORDED")))
                recorded = recorded or not bad
    return sorted(out)


def test_tokens_match_a_plain_loop(spark):
    rows = random_events(random.Random(5), 1500)
    got = runs.token_outcomes(spark.createDataFrame(rows, EVENTS), 7200).collect()
    assert sorted((r.token, r.id, r.outcome) for r in got) == plain_tokens(rows, 7200)
    assert {r.outcome for r in got} == {"INVALID", "REVOKED", "EXPIRED", "NOT_DELIVERED", "DUPLICATE_IGNORED", "RECORDED"}
    assert runs.token_outcomes(spark.createDataFrame([], EVENTS), 7200).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_stream_of_tokens_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_events(rng)
    last = [(None, -1, START + timedelta(days=30), "OTHER")]  # time goes on
    stream = arrive(spark, tmp_path, rows, EVENTS, rng)
    spark.createDataFrame(last, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = state.read_through(state.token_outcomes(stream.withColumn("token", F.coalesce("token", F.lit("none"))), 7200, "1 day"), f"file://{tmp_path}/out").collect()
    assert sorted((r.token, r.id, r.outcome) for r in got if r.token != "none") == plain_tokens(rows, 7200)


def test_tokens_share_cells_and_keep_their_own_facts(spark, tmp_path):
    """Hundreds of tokens in three cells, each called for all of its tokens at once: the rows are those of each token alone."""
    rng = random.Random(8)
    rows = [(f"{token}-{i % 7}" if token else None, n, *rest) for i, (token, n, *rest) in enumerate(random_events(rng))]
    stream = arrive(spark, tmp_path, rows, EVENTS, rng)
    spark.createDataFrame([(None, -1, START + timedelta(days=30), "OTHER")], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = state.read_through(state.token_outcomes(stream.withColumn("token", F.coalesce("token", F.lit("none"))), 7200, "1 day", cells=3), f"file://{tmp_path}/out").collect()
    assert sorted((r.token, r.id, r.outcome) for r in got if r.token != "none") == plain_tokens(rows, 7200)
