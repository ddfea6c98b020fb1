"""What is kept step by step: folds over ranges, claims, bucketed records, chunked histories, sweeps, audits, streams."""

import os
import random
import shutil
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import audit, features, histories, integrity, ledger, recording
from tallyspan.sources import documents, schemas, sinks
from tallyspan.sources.versions import Versions
from tallyspan.streaming import incremental
from tests.test_ledger import BRACKET, SIGHTING, T0, H, record

OBSERVED = "k string, seq long, player_count long"


def loop_fold(counts, page=1, loops=0, last=0):
    for c in counts:
        page, loops = (1, loops + 1) if c < last else (page + 1, loops)
        last = c
    return page, loops, last


def files_below(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


# page cursors


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_cursor_summaries_join_in_any_grouping(spark, monkeypatch, bits):
    """Ranges of 2, 8 and 4096 rows give what a loop gives, from the start and from a state; seq has gaps and lies below zero."""
    monkeypatch.setattr(ledger, "FOLD_BITS", bits)
    random.seed(bits)
    logs = {k: [random.choice([0, 1, 2, 3, 3, 4]) for _ in range(n)] for k, n in (("a", 300), ("b", 41), ("c", 1), ("d", 64))}
    rows = [(k, s, c) for k, log in logs.items() for s, c in zip(sorted(random.sample(range(-500, 5000), len(log))), log)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, OBSERVED).repartition(3)
    assert {r.k: tuple(r)[1:] for r in ledger.cursor_fold(frame, ["k"]).collect()} == {k: loop_fold(v) for k, v in logs.items()}
    state = spark.createDataFrame([("a", 7, 2, 3), ("zz", 1, 1, 1)], "k string, page long, loop_count long, last_count long")
    got = {r.k: tuple(r)[1:] for r in ledger.cursor_fold(frame, ["k"], state).collect()}
    assert got == {k: loop_fold(v, *((7, 2, 3) if k == "a" else ())) for k, v in logs.items()}


def test_one_key_with_all_rows_is_folded_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ledger, "FOLD_BITS", 4)
    frame = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("seq"), (F.col("id") * 7919 % 11).alias("player_count"))
    plan = ledger.cursor_summaries(frame, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and plan.count("- Aggregate [") == 3  # groups of 16, then of 16 groups, then the key
    assert tuple(ledger.cursor_fold(frame, ["k"]).first())[1:] == loop_fold([n * 7919 % 11 for n in range(2000)])


def test_cursor_edge_cases(spark):
    assert ledger.cursor_fold(spark.createDataFrame([], OBSERVED), ["k"]).collect() == []
    odd = spark.createDataFrame([("a", None, 3), ("a", 5, None), ("a", 5, 2), (None, 1, 1)], OBSERVED)
    assert {r.k: tuple(r)[1:] for r in ledger.cursor_fold(odd, ["k"]).collect()} == {"a": loop_fold([3, 0, 2]), None: (2, 0, 1)}


# claims


def test_smallest_takes_as_many_as_a_sort_would(spark, monkeypatch):
    monkeypatch.setattr(ledger, "CLAIM_RANGE", 50)
    ids = [f"p{n:04d}" for n in range(400)]
    random.Random(1).shuffle(ids)
    frame = spark.createDataFrame([(i,) for i in ids], "entity_id string").repartition(5)
    for n in (0, 1, 49, 50, 51, 200, 399, 400, 1000):
        assert sorted(r[0] for r in ledger.smallest(frame, "entity_id", n).collect()) == sorted(ids)[:n]
    plan = ledger.smallest(frame, "entity_id", 200)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan and "TakeOrdered" not in plan


def test_claim_steps_are_disjoint_and_can_be_replayed(spark, tmp_path):
    records = record(spark, *((f"p{n:02d}", [(1, T0)], None, "pending", None) for n in range(12)))
    log, as_of = Versions(spark, str(tmp_path / "log")), F.lit(T0 + H)
    step = lambda n, **how: sorted(r.entity_id for r in ledger.claim_step(log, n, records, as_of, limit=5, **how).collect())
    first, second = step(0), step(1)
    assert (first, second) == ([f"p{n:02d}" for n in range(5)], [f"p{n:02d}" for n in range(5, 10)])
    assert step(0) == first and step(1) == second
    assert step(2) == ["p10", "p11"] and step(3) == []
    ends = spark.createDataFrame([("p03", T0 + 2 * H), ("p04", T0 - H)], "entity_id string, ts timestamp")
    assert step(4, ends=ends) == ["p03"]  # the other's work ended before it was claimed


def test_a_step_that_failed_before_its_commit_is_made_anew(spark, tmp_path):
    log = Versions(spark, str(tmp_path / "log"))
    records = record(spark, ("a", [(1, T0)], None, "pending", None), ("b", [(1, T0)], None, "pending", None))
    ledger.claim_step(log, 0, records, F.lit(T0), limit=2)
    shutil.rmtree(tmp_path / "log" / "commits" / "version=0")  # written, not committed
    assert not log.has(0) and log.read() is None
    assert [r.entity_id for r in ledger.claim_step(log, 0, records, F.lit(T0), limit=1).collect()] == ["a"]
    assert log.read().count() == 1


# records in buckets


def sightings(spark, *rows):
    return spark.createDataFrame([(e, n, f"/{n}", T0 + H * n, n, "na1", "R", t, "I", "1") for e, n, t in rows], SIGHTING)


def test_a_batch_reads_and_writes_the_buckets_it_touches(spark, tmp_path):
    store = recording.RecordStore(spark, str(tmp_path / "records"), 16)
    everyone = [(f"p{n}", n, "A") for n in range(200)]
    assert len(store.upsert(sightings(spark, *everyone), 0)) == 16
    before = files_below(tmp_path)
    few = [("p3", 300, "B"), ("p4", 301, "B"), ("new", 302, "B"), ("p3", 303, "C")]
    touched = store.upsert(sightings(spark, *few), 1)
    assert 1 <= len(touched) <= 3
    after = files_below(tmp_path)
    assert {k: after[k] for k in before} == before
    new = {k for k in after if k not in before and "/data/" in k}
    assert {k.split("bucket=")[1].split("/")[0] for k in new} == {str(b) for b in touched} and all("version=1" in k for k in new)
    read = {f.split("/bucket=")[1].split("/")[0] for f in store.read(1, touched).inputFiles()}
    assert read == {str(b) for b in touched}
    want = ledger.upsert_records(sightings(spark, *everyone, *few))
    columns = ["entity_id", *BRACKET, "history", "latest_logged_at"]
    assert sorted(store.read().select(columns).collect()) == sorted(want.select(columns).collect())
    assert store.read(before=1).count() == 200 and store.read(before=0) is None


def test_a_version_that_is_repeated_replaces_itself(spark, tmp_path):
    store = recording.RecordStore(spark, str(tmp_path / "records"), 4)
    parts = [[("a", 1, "A"), ("b", 2, "A")], [("a", 3, "B")], [("c", 4, "A"), ("a", 5, "C")]]
    for n in (0, 1, 1, 2, 2):
        store.upsert(sightings(spark, *parts[n]), n)
    got = {r.entity_id: ([h.task_id for h in r.history], r.tier) for r in store.read().collect()}
    assert got == {"a": ([1, 3, 5], "C"), "b": ([2], "A"), "c": ([4], "A")}
    assert store.upsert(sightings(spark).limit(0), 3) == []


def test_replaced_versions_can_be_removed(spark, tmp_path):
    store = recording.RecordStore(spark, str(tmp_path / "records"), 4)
    for n in range(4):
        store.upsert(sightings(spark, ("a", n, "A"), (f"only{n}", 10 + n, "B")), n)
    states = [sorted(store.read(before=n).collect()) for n in (3, 4)]
    assert store.versions.trim(3) >= 2  # "a" was in versions 0 and 1
    assert [sorted(store.read(before=n).collect()) for n in (3, 4)] == states
    assert store.versions.trim(3) == 0
    store.upsert(sightings(spark, ("a", 3, "A"), ("only3", 13, "B")), 3)  # repeated
    assert sorted(store.read().collect()) == states[1]


def test_ends_of_details_reach_the_records_of_their_entities(spark, tmp_path):
    store = recording.RecordStore(spark, str(tmp_path / "records"), 4)
    store.upsert(sightings(spark, ("a", 1, "A"), ("b", 2, "A"), ("c", 3, "")), 0)
    claims = spark.createDataFrame([("a", 7), ("c", 8), ("none", 9)], "entity_id string, task_id long")
    details = spark.createDataFrame([("a", 5, []), ("a", 6, []), ("c", 1, [])], "entity_id string, points long, errors array<string>")
    for _ in range(2):
        ends = recording.record_details(details, claims, store, str(tmp_path / "details"), 1, F.lit(T0 + 9 * H), F.lit("15.10"), BRACKET)
    assert {r.entity_id: (r.status, r.error) for r in ends.collect()} == {"a": ("success", None), "c": ("failed", "Failed to save mastery data."), "none": ("failed", "Failed to fetch detail data.")}
    got = {r.entity_id: (r.detail_status, r.detail_task_id, r.detail_patch, r.detail_path is None) for r in store.read().collect()}
    assert got == {"a": ("success", 7, "15.10", False), "b": ("pending", None, None, True), "c": ("failed", 8, "15.10", True)}
    with documents.text_partitions(spark):
        assert sorted(r.points for r in spark.read.parquet(str(tmp_path / "details")).collect()) == [5, 6]


def test_snapshots_land_once_and_known_pages_do_not(spark, tmp_path):
    store, root = recording.RecordStore(spark, str(tmp_path / "records"), 4), str(tmp_path / "snapshots")
    first = sightings(spark, ("a", 1, "A"), ("b", 1, "A"), ("c", 2, "A")).withColumn("batch_id", F.col("task_id"))
    second = sightings(spark, ("a", 3, "A"), ("c", 3, "A"), ("a", 4, "B"), ("d", 5, "A")).withColumn("batch_id", F.col("task_id"))
    recording.record_snapshots(first, store, root, 0, ["tier"], F.col("logged_at"))
    for _ in range(2):
        ends = recording.record_snapshots(second, store, root, 1, ["tier"], F.col("logged_at"))
    assert {r.task_id: (r.status, r.file_path is None) for r in ends.collect()} == {3: ("success", True), 4: ("success", False), 5: ("success", False)}
    with documents.text_partitions(spark):
        assert sorted((r.entity_id, r.task_id) for r in spark.read.parquet(root).collect()) == [("a", 1), ("a", 4), ("b", 1), ("c", 2), ("d", 5)]
    assert {r.entity_id: [h.task_id for h in r.history] for r in store.read().collect()} == {"a": [1, 4], "b": [1], "c": [2], "d": [5]}


def test_a_batch_is_judged_once_and_its_days_are_no_folders(spark, tmp_path):
    """Reads of the input are counted: pages thrice, details twice, whatever is done with the ends; days share the files of their bracket."""
    reads = spark.sparkContext.accumulator(0)

    def counted(df):
        def go(batches):
            for batch in batches:
                reads.add(batch.num_rows)
                yield batch

        return df.coalesce(1).mapInArrow(go, df.schema)

    store = recording.RecordStore(spark, str(tmp_path / "records"), 4)
    days = [sightings(spark, (f"p{n}", n, "A")).withColumn("logged_at", F.lit(T0 + 24 * n * H)) for n in range(8)]
    pages = days[0]
    for day in days[1:]:
        pages = pages.union(day)
    recording.record_snapshots(counted(pages.withColumn("batch_id", F.col("task_id"))), store, str(tmp_path / "s"), 0, ["tier"], F.col("logged_at")).collect()
    assert reads.value == 3 * 8
    claims = spark.createDataFrame([(f"p{n}", n) for n in range(8)], "entity_id string, task_id long")
    details = spark.createDataFrame([(f"p{n}", n, []) for n in range(8)], "entity_id string, points long, errors array<string>")
    before = reads.value
    recording.record_details(counted(details), claims, store, str(tmp_path / "d"), 1, F.lit(T0 + 9 * H), F.lit("15.10"), BRACKET).collect()
    assert reads.value - before == 2 * 8
    with documents.text_partitions(spark):
        landed = spark.read.parquet(str(tmp_path / "d"))
        assert sorted(r.points for r in landed.collect()) == list(range(8)) and landed.select("date").distinct().count() == 8
    assert len(files_below(tmp_path / "d")) == 1


def test_a_batch_written_twice_leaves_the_same_rows(spark, tmp_path):
    rows = sightings(spark, *((f"p{n}", n, "AB"[n % 2]) for n in range(60)))
    for batch in (0, 1, 1, 0):
        sinks.write_snapshots(rows.where(F.col("seq") % 2 == batch), str(tmp_path / "x"), F.col("logged_at"), batch=batch)
    with documents.text_partitions(spark):
        assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "x")).collect()) == list(range(60))


# histories in chunks


def test_chunks_hold_the_histories_in_order(spark):
    random.seed(9)
    rows = [(f"p{random.randrange(5)}", n, random.choice("AB")) for n in range(300)]
    whole, span = ledger.upsert_records(sightings(spark, *rows)), 5 * 3600
    parts = [histories.history_chunks(sightings(spark, *rows[k::3]), span) for k in range(3)]
    chunks = histories.merge_chunks(histories.merge_chunks(parts[0], parts[1]), parts[2])
    got = defaultdict(list)
    for r in sorted(chunks.collect(), key=lambda r: (r.entity_id, r.chunk)):
        assert r.n == len(r.entries) <= 5 and (r.first, r.last) == (r.entries[0], r.entries[-1])
        got[r.entity_id] += [e.task_id for e in r.entries]
    assert got == {r.entity_id: [h.task_id for h in r.history] for r in whole.collect()}
    totals = {r.entity_id: (r.n_history, r.first_task_id, r.latest_task_id, r.latest_logged_at, r.tier) for r in histories.history_totals(chunks).collect()}
    assert totals == {r.entity_id: (len(r.history), r.history[0].task_id, r.history[-1].task_id, r.latest_logged_at, r.tier) for r in whole.collect()}


def test_a_batch_of_sightings_rewrites_its_spans_only(spark, tmp_path):
    store = recording.HistoryStore(spark, str(tmp_path / "h"), 10 * 3600)
    rows = [("hot" if n % 3 else f"p{n}", n, "A") for n in range(100)]
    assert len(store.upsert(sightings(spark, *rows), 0)) == 11
    before = files_below(tmp_path)
    late = [("hot", 41, "B"), ("new", 42, "B")]
    for _ in range(2):
        touched = store.upsert(sightings(spark, *late), 1)
    assert len(touched) == 1
    after = files_below(tmp_path)
    assert {k: after[k] for k in before} == before
    assert {k.split("bucket=")[1].split("/")[0] for k in after if k not in before and "/data/" in k} == {str(touched[0])}
    want = histories.history_totals(histories.history_chunks(sightings(spark, *rows, *late), 10 * 3600))
    assert sorted(histories.history_totals(store.read()).collect()) == sorted(want.collect())


def test_lengths_are_read_without_the_entries(spark, tmp_path):
    histories.history_chunks(sightings(spark, ("a", 1, "A"), ("a", 2, "B"), ("b", 3, "A"))).write.parquet(str(tmp_path / "chunks"))
    totals = histories.history_totals(spark.read.parquet(str(tmp_path / "chunks")))
    assert "entries" not in totals._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert histories.history_length_stats(totals).collect() == integrity.history_length_stats(ledger.upsert_records(sightings(spark, ("a", 1, "A"), ("a", 2, "B"), ("b", 3, "A")))).collect()


def test_issues_by_chunk_are_those_of_the_whole_history(spark):
    rows = [(f"p{n % 4}", n, "A" if n % 7 else "") for n in range(40)]
    tasks = spark.createDataFrame([(n, "success" if n % 3 else "failed") for n in range(60)], "task_id long, status string")
    base = ledger.upsert_records(sightings(spark, *rows))
    records = base.withColumns({"detail_task_id": F.when(F.col("entity_id") != "p1", F.lit(42).cast("long")), "detail_status": F.when(F.col("entity_id") == "p2", "success").otherwise("failed")})
    want = {(r.entity_id, i) for r in integrity.ledger_issues(records, tasks, tasks).collect() for i in r.issues}
    got = histories.ledger_issues(records, histories.history_chunks(sightings(spark, *rows), 3 * 3600), tasks, tasks)
    assert {(r.entity_id, i) for r in got.collect() for i in r.issues} == want
    assert got.where("chunk is not null").count() > 4


# sweeps


def test_sweep_cascades_and_changes_nothing_the_second_time(spark):
    runs = spark.createDataFrame([(1, "running", T0 - 3 * H), (2, "running", T0), (3, "success", T0 - 9 * H)], "run_id long, status string, last_heartbeat timestamp")
    runs = runs.withColumns({"error_message": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    tasks = "task_id long, run_id long, status string, error_message string, finished_at timestamp"
    snaps = spark.createDataFrame([(1, 1, "in_progress", None, None), (2, 1, "success", None, T0), (3, 2, "pending", None, None), (4, 3, "failed", "x", T0)], tasks)
    details = spark.createDataFrame([(7, 1, "in_progress", None, None), (8, 2, "in_progress", None, None)], tasks)
    records = record(spark, ("gone", [(1, T0)], None, "pending", None), ("two", [(2, T0), (1, T0)], 7, "in_progress", T0), ("other", [(3, T0)], 8, "in_progress", T0), ("kept", [(2, T0)], None, "pending", None))
    state = (runs, records, snaps, details)
    for _ in range(2):
        state = ledger.sweep(*state, F.lit(T0), F.expr("INTERVAL 1 HOUR"))
        got = [{r[0]: r for r in df.collect()} for df in state]
        assert {k: (r.status, r.error_message) for k, r in got[0].items()} == {1: ("failed", ledger.STALLED), 2: ("running", None), 3: ("success", None)}
        assert {k: r.detail_status for k, r in got[1].items()} == {"two": "failed", "other": "in_progress", "kept": "pending"}
        assert {k: (r.status, r.error_message) for k, r in got[2].items()} == {1: ("failed", ledger.CANCELLED), 2: ("success", None), 3: ("pending", None), 4: ("failed", "x")}
        assert {k: r.status for k, r in got[3].items()} == {7: "failed", 8: "in_progress"}


# audits


def test_an_audit_reads_new_and_changed_files_only(spark, tmp_path):
    roots = [tmp_path / "s", tmp_path / "d"]
    for r in roots:
        r.mkdir()
    put = lambda path, text, age: (path.write_text(text), os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age)))
    page = lambda *ids: '{"players": [%s]}' % ", ".join('{"puuid": "%s"}' % i for i in ids)
    detail = lambda i: '{"masteries": [{"puuid": "%s"}]}' % i
    put(roots[0] / "1.json", page("p1", "p2"), 100)
    put(roots[0] / "2.json", page(), 90)
    put(roots[1] / "a.json", detail("p1"), 100)
    log = Versions(spark, str(tmp_path / "log"))
    run = lambda step: audit.audit(spark, log, step, *map(str, roots))
    summary = lambda rows: audit.report(rows)["summary"].first().asDict()
    full = lambda: integrity.file_integrity(*(documents.scan_documents(spark, str(r)) for r in roots))["summary"].first().asDict()
    assert summary(run(0)) == full()
    put(roots[0] / "3.json", page("p1", "p3"), 50)
    put(roots[0] / "2.json", page("p4"), 40)  # mended
    put(roots[1] / "b.json", "{no json", 30)
    put(roots[1] / "c.json", detail("p9"), 20)
    assert summary(run(1)) == full()
    assert sorted(r.path.rsplit("/", 1)[1] for r in log.read_version(1).select("path").distinct().collect()) == ["2.json", "3.json", "b.json", "c.json"]
    assert summary(run(1)) == full() and summary(run(2)) == full()  # repeated; nothing new
    seen = log.read().where("kind = 'snapshot'")
    listed = documents.scan_documents(spark, str(roots[0]), "2023-11-14T22:12:00").inputFiles()
    assert sorted(f.rsplit("/", 1)[1] for f in listed) == ["2.json", "3.json"] and audit.new_documents(spark, str(roots[0]), seen).count() == 0


def test_packed_files_are_audited_like_files_of_their_own(spark, tmp_path):
    """Forty documents lie in a few files; a path that comes again counts as it is now, and each is parsed in one pass."""
    page = lambda *ids: '{"players": [%s]}' % ", ".join('{"puuid": "%s"}' % i for i in ids)
    pages = [(f"/s/{n}", page(f"p{n}", f"p{n % 7}") if n % 5 else ['{"players": []}', '{"players": 1}', "[1]", "{no"][n // 5 % 4]) for n in range(40)]
    details = [(f"/d/{n}", '{"masteries": [{"puuid": "%s"}, {"puuid": "other"}]}' % ("" if n % 9 == 0 else f"p{n}")) for n in range(45)]
    later = [("/s/0", page("p4")), ("/s/41", page("p41", "p3"))]
    roots, log = [str(tmp_path / "s"), str(tmp_path / "d")], Versions(spark, str(tmp_path / "log"))
    frame = lambda rows: spark.createDataFrame(rows, documents.PACKED)
    docs = lambda rows: frame(rows).select("path", F.try_parse_json("value").alias("doc"))
    state = {**dict(pages), **dict(later)}
    for step, (s, d, seen) in enumerate(((pages, details, pages), (later, [], list(state.items())))):
        documents.pack_documents(frame(s), f"{roots[0]}/landing={step}")
        documents.pack_documents(frame(d), f"{roots[1]}/landing={step}")
        for n, root in enumerate(roots):
            for f in Path(root, f"landing={step}").glob("*.parquet"):
                os.utime(f, (1_700_000_000 + 60 * step, 1_700_000_000 + 60 * step))
        rows = audit.audit(spark, log, step, *roots, packed=True)
        assert audit.report(rows)["summary"].first() == integrity.file_integrity(docs(seen), docs(details))["summary"].first()
    assert len(files_below(roots[0])) <= 8 and log.read_version(1).select("path").distinct().count() == 2
    plan = audit.file_rows(documents.scan_packed(spark, roots[0]), "snapshot", "players", "puuid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


# features


def test_rejects_are_counted_with_the_write(spark, tmp_path):
    details = spark.createDataFrame([("a", 1, 5, T0), ("a", 9, 7, T0), ("b", 9, 1, T0), ("b", None, 2, T0)], "entity_id string, item_id long, points long, last_played timestamp")
    items = spark.createDataFrame([("1", "One")], "item_id string, item_name string")
    entities = spark.createDataFrame([("a", "x")], "entity_id string, tier string")
    assert sorted(map(tuple, features.unmapped_items(details, items).collect()), key=str) == [("9", 2, 2, 8), (None, 1, 1, 2)]
    assert features.write_features(entities, details, items, ["One"], str(tmp_path / "f")) == {"details": 4, "unmapped": 3, "unmapped_points": 10}
    assert {(r.entity_id, r.One, r.total_points) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("a", 5, 12), ("b", None, 3)}


@pytest.mark.parametrize("how", ["none", "latest", "error"])
def test_many_items_give_the_same_pivot(spark, monkeypatch, how):
    random.seed(6)
    items = ["One", "Two", "a b", "x.y"]
    rows = [(f"p{random.randrange(30)}", random.choice([*items, "Other", None]), random.randrange(9), T0 + H * n) for n in range(300)]
    frame = spark.createDataFrame(rows, "entity_id string, item_name string, points long, last_played timestamp")
    if how == "error":
        frame = frame.groupBy("entity_id", "item_name").agg(F.max("points").alias("points"), F.max("last_played").alias("last_played"))
    measures, sums = {"": "points", "_lastPlayed": "last_played"}, {"total": "points"}
    one = [features.pivot_details(frame, items, measures, how).collect(), features._wide(frame, items, measures, totals=sums).collect()]
    monkeypatch.setattr(features, "MANY_ITEMS", 1)
    many = features.pivot_details(frame, items, measures, how)
    assert many.columns == ["entity_id", *items, *(f"{i}_lastPlayed" for i in items)]
    assert sorted(many.collect()) == sorted(one[0])
    assert sorted(features._wide(frame, items, measures, totals=sums).collect()) == sorted(one[1])
    if how == "error":
        with pytest.raises(Exception, match="more than once"):
            features.pivot_details(frame.union(frame), items, measures).collect()


def test_a_wide_row_is_made_where_its_entity_is(spark, monkeypatch):
    """No wide groups are begun before the rows of an entity are together: in a task they would be as many as its cells."""
    monkeypatch.setattr(features, "MANY_ITEMS", 1)
    frame = spark.range(90).selectExpr("id % 9 as entity_id", "concat('i', id % 10) as item_name", "id as points")
    plan = features._wide(frame, [f"i{n}" for n in range(8)], {"": "points"}, totals={"total": "points"})._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan.lower()
    assert plan.index("collect_list") < plan.index("Exchange hashpartitioning(entity_id") and "collect_list" not in plan[plan.index("Exchange hashpartitioning(entity_id") :]


# streams


def test_packed_documents_are_judged_each_on_its_own(spark, tmp_path):
    entry = lambda n: '{"k": %s}' % ('"x"' if n == 13 else n)
    docs = [(f"/p/{p}", '{"list": [%s]}' % ", ".join(entry(n) for n in range(5 * p, 5 * p + 5))) for p in range(9)] + [("/p/none", "{no")]
    documents.pack_documents(spark.createDataFrame(docs, documents.PACKED).coalesce(1), str(tmp_path / "in"))
    assert len(files_below(tmp_path / "in")) == 1
    incremental.stream_documents(spark, str(tmp_path / "in"), "list", {"k": ("long", 0, True)}, str(tmp_path / "out"), str(tmp_path / "cp"), packed=True).awaitTermination()
    got = {v: sorted((r.path, 13 if r.k is None else r.k) for r in spark.read.parquet(str(tmp_path / "out" / v)).collect()) for v in ("accepted", "quarantine")}
    assert got["accepted"] == sorted((f"/p/{n // 5}", n) for n in range(45) if n // 5 != 2)
    assert got["quarantine"] == [("/p/2", n) for n in range(10, 15)]


def test_a_cursor_goes_on_from_its_checkpoint(spark, tmp_path):
    random.seed(4)
    rows = [(random.choice("ab"), n, random.randrange(5)) for n in range(90)]
    seen = {}
    for start in (0, 30, 60):  # a query of its own for each part: the state comes from the checkpoint
        spark.createDataFrame(rows[start : start + 30], OBSERVED).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.stream_cursor(spark.readStream.schema(OBSERVED).parquet(str(tmp_path / "in")), ["k"])
        keep = lambda df, n: seen.update({r.k: tuple(r)[1:] for r in df.collect()})
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {k: loop_fold([c for x, _, c in rows if x == k]) for k in "ab"}
    assert list((tmp_path / "cp" / "state").rglob("*.zip")) or list((tmp_path / "cp" / "state").rglob("*.changelog"))  # RocksDB's files


def test_records_of_a_replayed_micro_batch_are_recorded_once(spark, tmp_path):
    pages = sightings(spark, *((f"p{n % 7}", n, "AB"[n % 2]) for n in range(60))).withColumn("batch_id", F.expr("seq div 3"))
    store, checkpoint = recording.RecordStore(spark, str(tmp_path / "records"), 4), tmp_path / "cp"

    def go():
        incremental.stream_records(spark, str(tmp_path / "in"), pages.schema, store, ["tier"], str(checkpoint), 1000).awaitTermination()

    for low in (0, 30):
        pages.where((F.col("seq") >= low) & (F.col("seq") < low + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        go()
    first = sorted(store.read().collect())
    for commit in (checkpoint / "commits").glob("*1*"):
        commit.unlink()  # the sink had done its work, the checkpoint had not heard of it
    go()
    assert sorted(store.read().collect()) == first
    state, pages_of = {}, defaultdict(list)
    for n in range(60):
        pages_of[n // 3].append((f"p{n % 7}", "AB"[n % 2], n))
    want = defaultdict(list)
    for group in (range(10), range(10, 20)):
        known = dict(state)
        for p in group:
            if any(known.get(e) != t for e, t, _ in pages_of[p]):
                for e, t, n in pages_of[p]:
                    want[e].append(n)
                    state[e] = t
    assert {r.entity_id: [h.task_id for h in r.history] for r in first} == want


def test_silent_runs_are_swept_in_the_stream(spark, tmp_path):
    start = datetime(2025, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    runs, snaps, details = (Versions(spark, str(tmp_path / n), 4) for n in ("runs", "snaps", "details"))
    store = recording.RecordStore(spark, str(tmp_path / "records"), 4)
    none = {"error_message": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")}
    recording.replace_buckets(runs, spark.createDataFrame([(n, "running") for n in (1, 2, 3)], "run_id long, status string").withColumns(none), "run_id", 0, list(range(4)))
    tasks = spark.createDataFrame([(10 * n + k, n, "success" if k else "in_progress") for n in (1, 2, 3) for k in (0, 1)], "task_id long, run_id long, status string").withColumns(none)
    for table in (snaps, details):
        recording.replace_buckets(table, tasks, "run_id", 0, list(range(4)))
    rows = [(f"p{n}", [(10 * n, T0)], 10 * n, "in_progress", T0) for n in (1, 2, 3)] + [("q1", [(11, T0), (10, T0)], 10, "in_progress", T0), ("q2", [(21, T0)], 21, "success", T0)]
    store.replace(record(spark, *rows), 0, list(range(4)))
    events = [[(1, at(0), "heartbeat"), (2, at(0), "heartbeat"), (3, at(0), "heartbeat")], [(2, at(1), "heartbeat"), (3, at(1), "finish")], [(9, at(3), "heartbeat")], [(9, at(3.01), "heartbeat")]]
    for arrival in events:
        spark.createDataFrame(arrival, "run_id long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run_id long, ts timestamp, kind string").parquet(str(tmp_path / "in"))
        incremental.stream_sweep(stream, int(2.5 * 3600), runs, store, snaps, details, F.lit(T0), str(tmp_path / "cp"), 1).awaitTermination()
    assert {r.run_id: r.status for r in runs.read().collect()} == {1: "failed", 2: "running", 3: "running"}
    assert {r.task_id: r.status for r in snaps.read().collect()} == {10: "failed", 11: "success", 20: "in_progress", 21: "success", 30: "in_progress", 31: "success"}
    assert {r.entity_id: r.detail_status for r in store.read().collect()} == {"p2": "in_progress", "p3": "in_progress", "q1": "failed", "q2": "success"}


def test_schemas_hold_what_the_store_writes():
    assert set(recording.RECORD) == set(schemas.RECORDS.names)
