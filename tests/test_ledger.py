"""Ledger folds against hand-made cases and against plain Python folds of random logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import ledger
from tallyspan.sources import schemas

T0 = datetime(2025, 1, 10, 12)
H = timedelta(hours=1)
BRACKET = ["region", "queue", "tier", "division"]
SIGHTING = "entity_id string, task_id long, path string, logged_at timestamp, seq long, region string, queue string, tier string, division string, patch string"


def record(spark, *rows):
    """(entity, history, detail task, status, detail time) as records."""
    full = []
    for entity, history, task, status, when in rows:
        entries = [(t, f"/p/{t}", at, "14.1") for t, at in history]
        full.append((entity, "na1", "R", "GOLD", "I", entries, entries[-1][2] if entries else None, task, status, None, when, None))
    return spark.createDataFrame(full, schemas.RECORDS)


def test_upsert_appends_histories_and_takes_the_last_bracket(spark):
    one = [("p1", 1, "/a", T0, 1, "na1", "R", "GOLD", "I", "14.1")]
    two = [("p1", 2, "/b", T0 + H, 2, "na1", "R", "PLATINUM", "II", "14.2"), ("p2", 2, "/b", T0 + H, 3, "na1", "R", "IRON", "IV", "14.2")]
    first = ledger.upsert_records(spark.createDataFrame(one, SIGHTING))
    both = {r.entity_id: r for r in ledger.upsert_records(spark.createDataFrame(two, SIGHTING), first).collect()}
    p1 = both["p1"]
    assert [(h.task_id, h.path, h.patch) for h in p1.history] == [(1, "/a", "14.1"), (2, "/b", "14.2")]
    assert (p1.tier, p1.division, p1.detail_status, p1.latest_logged_at) == ("PLATINUM", "II", "pending", T0 + H)
    assert len(both["p2"].history) == 1


def test_upsert_in_parts_equals_upsert_at_once(spark):
    random.seed(3)
    rows = [(f"p{random.randrange(9)}", n, f"/{n}", T0 + H * n, n, "na1", "R", random.choice("AB"), "I", "1") for n in range(60)]
    frame = spark.createDataFrame(rows, SIGHTING)
    whole = ledger.upsert_records(frame).select("entity_id", *BRACKET, "history", "latest_logged_at")
    parts = ledger.upsert_records(frame.where("seq >= 30"), ledger.upsert_records(frame.where("seq < 30")))
    assert sorted(whole.collect()) == sorted(parts.select(*whole.columns).collect())


def test_detail_status_mirrors_transitions_and_claims(spark):
    events = spark.createDataFrame(
        [(7, 1, "p1", T0, 1, "in_progress", None, None, "14.2"), (7, 1, "p1", T0 + H, 2, "success", "/m", None, "14.2"), (8, 1, "p2", T0, 3, "in_progress", "/x", None, "14.2")], schemas.TASK_EVENTS
    )
    claims = spark.createDataFrame([("p1", T0 + 2 * H, 9, "in_progress")], "entity_id string, ts timestamp, seq long, status string")
    records = record(spark, ("p1", [(1, T0)], None, "pending", None), ("p2", [(1, T0)], None, "pending", None), ("p3", [(1, T0)], None, "pending", None))
    got = {r.entity_id: r for r in ledger.mirror_detail_status(records, events, claims).collect()}
    assert (got["p1"].detail_status, got["p1"].detail_path, got["p1"].detail_patch, got["p1"].detail_task_id) == ("in_progress", "/m", "14.2", 7)
    assert (got["p2"].detail_status, got["p2"].detail_path) == ("in_progress", None)
    assert (got["p3"].detail_status, got["p3"].detail_task_id) == ("pending", None)


def test_task_state_counts_starts(spark):
    events = [(1, 5, None, T0 + H * n, n, s, "/f" if s == "success" else None, "e" if s == "failed" else None, None) for n, s in enumerate(["pending", "in_progress", "failed", "in_progress", "success"])]
    r = ledger.task_state(spark.createDataFrame(events, schemas.TASK_EVENTS)).first()
    assert (r.status, r.attempts, r.started_at, r.finished_at, r.file_path, r.error_message) == ("success", 2, T0 + 3 * H, T0 + 4 * H, "/f", None)


def test_run_state(spark):
    events = [(1, T0, 0, "start", None, None), (1, T0 + H, 1, "heartbeat", None, None), (1, T0 + 2 * H, 2, "finish", "failed", "why"), (2, T0, 3, "start", None, None)]
    tasks = [(1, 2, None, T0 + 5 * H, 9, "pending", None, None, None)]
    got = {r.run_id: r for r in ledger.run_state(spark.createDataFrame(events, schemas.RUN_EVENTS), spark.createDataFrame(tasks, schemas.TASK_EVENTS)).collect()}
    assert (got[1].status, got[1].error_message, got[1].finished_at, got[1].last_heartbeat) == ("failed", "why", T0 + 2 * H, T0 + H)
    assert (got[2].status, got[2].last_heartbeat, got[2].finished_at) == ("running", T0 + 5 * H, None)


@pytest.mark.parametrize(("stale", "limit", "want"), [(False, None, {"a", "b"}), (True, None, {"a", "b", "c"}), (False, 1, {"a"}), (True, 0, set())])
def test_claims(spark, stale, limit, want):
    seen, old = [(1, T0 - 2 * H)], T0 - timedelta(days=10)
    records = record(spark, ("a", seen, None, "pending", None), ("b", seen, 1, "failed", old), ("c", seen, 2, "success", old), ("d", seen, 3, "in_progress", old), ("e", [], None, "success", None))
    claimed, after = ledger.claim(records, F.lit(T0), stale=stale, limit=limit)
    assert {r.entity_id for r in claimed.collect()} == want
    state = {r.entity_id: r.detail_status for r in after.collect()}
    assert {k for k, v in state.items() if v == "in_progress"} == want | {"d"}
    again, _ = ledger.claim(after, F.lit(T0), stale=stale)
    assert not {r.entity_id for r in again.collect()} & want


def test_stale_claims_leave_out_recent_failures(spark):
    records = record(spark, ("a", [(1, T0 - 2 * H)], 1, "failed", T0 - timedelta(days=2)), ("b", [(1, T0 - 30 * H)], 1, "failed", None))
    assert ledger.claim(records, F.lit(T0), stale=True)[0].count() == 0
    assert ledger.claim(records, F.lit(T0))[0].count() == 2


def test_sweep(spark):
    rows = [(1, T0 - timedelta(days=2), "running"), (2, T0, "running"), (3, None, "running"), (4, T0 - timedelta(days=2), "success")]
    runs = spark.createDataFrame([(i, None, None, t, None, s, None) for i, t, s in rows], schemas.RUNS)
    swept, after = ledger.sweep_stale_runs(runs, F.lit(T0), F.expr("INTERVAL 1 HOUR"))
    assert [r.run_id for r in swept.collect()] == [1]
    got = {r.run_id: (r.status, r.error_message, r.finished_at) for r in after.collect()}
    assert got == {1: ("failed", ledger.STALLED, T0), 2: ("running", None, None), 3: ("running", None, None), 4: ("success", None, None)}


def test_cleanup_matrix(spark):
    """Four snapshot task states, histories of one to three, four detail task states, in a failing and another run."""
    tasks = [(n, 1 + n // 4, None, s, 1, None, None, "old") for n, s in enumerate(["pending", "in_progress", "success", "failed"] * 2)]
    details = [(100 + i, r, e, f, s, a, b, c, m) for (i, r, f, s, a, b, c, m) in tasks for e in [None]]
    rows, want = [], {}
    for task in range(8):
        for length in (1, 2, 3):
            for detail in (None, *range(100, 108)):
                name = f"e{task}-{length}-{detail}"
                rows.append((name, [(-k, T0) for k in range(1, length)] + [(task, T0 + H)], detail, "success", None))
                lost = length == 1 and task in (0, 1, 3)
                if not lost:
                    want[name] = "failed" if detail in (100, 101, 103) else "success"
    runs = spark.createDataFrame([(1,)], "run_id long")
    records, snapshots, ends = ledger.cleanup_runs(runs, record(spark, *rows), spark.createDataFrame(tasks, schemas.SNAPSHOT_TASKS), spark.createDataFrame(details, schemas.DETAIL_TASKS), F.lit(T0))
    assert {r.entity_id: r.detail_status for r in records.collect()} == want
    for frame, first in ((snapshots, 0), (ends, 100)):
        got = {r.task_id - first: (r.status, r.error_message, r.finished_at) for r in frame.collect()}
        assert all(got[n] == ("failed", ledger.CANCELLED, T0) for n in (0, 1, 3))
        assert got[2] == ("success", "old", None)
        assert all(got[n] == (tasks[n][3], "old", None) for n in range(4, 8))


def plain_fold(counts, page=1, loop=0, last=0):
    for c in counts:
        page, loop = (1, loop + 1) if c < last else (page + 1, loop)
        last = c
    return page, loop, last


def test_cursor_fold_equals_a_loop(spark):
    random.seed(8)
    logs = {k: [random.randrange(5) for _ in range(random.randint(1, 30))] for k in range(60)}
    rows = [(k, n, c) for k, log in logs.items() for n, c in enumerate(log)]
    random.shuffle(rows)
    seen = spark.createDataFrame(rows, "k long, seq long, player_count long")
    got = {r.k: (r.page, r.loop_count, r.last_count) for r in ledger.cursor_fold(seen, ["k"]).collect()}
    assert got == {k: plain_fold(log) for k, log in logs.items()}
    half = ledger.cursor_fold(seen.where("seq < 7"), ["k"])
    rest = {r.k: (r.page, r.loop_count, r.last_count) for r in ledger.cursor_fold(seen.where("seq >= 7"), ["k"], half).collect()}
    assert rest == {k: plain_fold(log) for k, log in logs.items() if len(log) > 7}


def test_cursor_cases(spark):
    state = spark.createDataFrame([("a", 3, 2, 10)], "k string, page long, loop_count long, last_count long")
    see = lambda *counts, k="a": spark.createDataFrame([(k, n, c) for n, c in enumerate(counts)], "k string, seq long, player_count long")
    assert ledger.cursor_fold(see(12), ["k"], state).first()[1:] == (4, 2, 12)
    assert ledger.cursor_fold(see(12, 5), ["k"], state).first()[1:] == (1, 3, 5)
    assert ledger.cursor_fold(see(0, 2), ["k"]).first()[1:] == (3, 0, 2)
    assert ledger.cursor_update(state, see(1, k="zz"), ["k"]).collect() == [("zz", 0)]
    wanted = spark.createDataFrame([("a",), ("new",)], "k string")
    assert sorted(ledger.cursor_get_or_create(state, wanted, ["k"]).collect()) == [("a", 3, 2), ("new", 1, 0)]


def test_novelty(spark):
    seen = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (2, "a", "x")], "batch_id long, entity_id string, patch string")
    records = spark.createDataFrame([("a", "x"), ("b", "old")], "entity_id string, patch string")
    assert sorted(ledger.novelty_counts(seen, records, ["patch"]).collect()) == [(1, 1, 2), (2, 0, 1)]
    accepted, gone, sightings = ledger.record_snapshot_batch(seen, records, ["patch"])
    assert (accepted.count(), [r.batch_id for r in gone.collect()]) == (3, [2])
    assert sorted((r.batch_id, r.entity_id) for r in sightings.collect()) == [(1, "a"), (1, "b")]


def test_detail_batch(spark):
    details = spark.createDataFrame([("ok", 1, []), ("bad", 1, ["x"]), ("bad", 2, []), ("nowhere", 1, [])], "entity_id string, points long, errors array<string>")
    claims = spark.createDataFrame([("ok",), ("bad",), ("none",), ("nowhere",)], "entity_id string")
    records = record(spark, *((e, [(1, T0)], None, "in_progress", None) for e in ("ok", "bad", "none", "nowhere"))).withColumn("tier", F.when(F.col("entity_id") != "nowhere", F.col("tier")))
    good, ends = ledger.record_detail_batch(details, claims, records, BRACKET)
    assert [r.entity_id for r in good.collect()] == ["ok"]
    got = {r.entity_id: (r.status, r.error) for r in ends.collect()}
    assert got["ok"] == ("success", None)
    assert got["nowhere"] == ("failed", "Failed to save mastery data.")
    assert got["bad"][0] == got["none"][0] == "failed"
