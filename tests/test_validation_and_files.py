"""Validation, nested documents, file and ledger reports, features, layout."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspan.functions import expressions as X
from tallyspan.operators import features, integrity, lookups, usage, validation
from tallyspan.plans import queries
from tallyspan.plans.roles import Roles
from tallyspan.sources import documents, schemas, sinks

ENTRY = {"tier": "GOLD", "rank": "III", "queueType": "QUEUE_A", "puuid": "someone", "wins": 31, "losses": 28, "leaguePoints": 74, "hotStreak": False, "freshBlood": True, "inactive": False, "veteran": False}
DETAIL = {"puuid": "someone", "championId": 412, "championPoints": 88_321, "championLevel": 9, "championPointsUntilNextLevel": 1_679, "championPointsSinceLastLevel": -45, "lastPlayTime": 1_700_000_000_123}


def rows(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "j string").select(F.try_parse_json("j").alias("value"))


def docs(spark, *texts):
    return spark.createDataFrame([(f"/{n}", t if isinstance(t, str) else json.dumps(t)) for n, t in enumerate(texts)], "path string, j string").select("path", F.try_parse_json("j").alias("doc"))


@pytest.mark.parametrize(
    ("field", "value", "ok"),
    [("wins", "5", True), ("wins", 5.0, True), ("wins", True, True), ("wins", 5.5, False), ("wins", "5.5", False), ("wins", None, False), ("wins", -1, False), ("wins", 2**63, False), ("wins", "x", False), ("wins", [1], False),
     ("tier", 3, False), ("tier", None, False), ("veteran", "yes", True), ("veteran", "t", True), ("veteran", 1, True), ("veteran", 2, False), ("veteran", None, False), ("extra", {"a": 1}, True)],
)
def test_coercion(spark, field, value, ok):
    r = validation.validate(rows(spark, ENTRY | {field: value}), schemas.SNAPSHOT_FIELDS).first()
    assert (not r.errors) == ok, r.errors
    assert ok or r.errors[0].startswith(f"{field}: ")


def test_validated_values(spark):
    r = validation.validate(rows(spark, ENTRY | {"wins": "7", "veteran": "yes"}), schemas.SNAPSHOT_FIELDS).first()
    assert (r.wins, r.veteran, r.freshBlood, r.tier) == (7, True, True, "GOLD")
    got = validation.validate(rows(spark, DETAIL, DETAIL | {"milestoneGrades": ["A", 1]}, DETAIL | {"milestoneGrades": None}, DETAIL | {"championLevel": 0}, {}), schemas.DETAIL_FIELDS).collect()
    assert [len(r.errors) for r in got] == [0, 0, 1, 1, 7]
    assert [len(r.milestoneGrades or []) for r in got[:2]] == [0, 2]


def test_batch_gate(spark):
    frame = spark.createDataFrame([(1, []), (1, ["bad"]), (2, []), (3, [])], "b long, errors array<string>")
    good, bad = validation.batch_gate(frame, ["b"])
    assert sorted(r.b for r in good.collect()) == [2, 3]
    assert [r.b for r in bad.collect()] == [1, 1]


def test_objects_of_lists(spark):
    frame = docs(spark, {"players": [{"puuid": "a"}, 5, None, {"puuid": "b"}]}, {"players": []}, {"players": 3}, "no json", {}, [1])
    got = validation.explode_objects(frame, "players").select("path", F.try_variant_get("value", "$.puuid", "string").alias("p")).collect()
    assert sorted((r.path, r.p) for r in got) == [("/0", "a"), ("/0", "b")]


def test_keys_domains_filters(spark):
    frame = spark.createDataFrame([("GOLD", "I"), ("", "I"), (None, "I"), ("WOOD", "V")], "tier string, division string")
    assert validation.require_keys(frame, ["tier", "division"]).count() == 2
    assert [r.in_domain for r in validation.domain_check(frame, "tier", schemas.TIERS).collect()] == [True, False, False, False]
    assert validation.optional_filters(frame, tier="GOLD", division=None).count() == 1
    assert validation.optional_filters(frame, tier="", division=None).count() == 4


def test_expressions(spark):
    r = spark.range(1).select(
        X.latest_of(F.array(F.lit(1), F.lit(2))).alias("a"), X.latest_of(F.array().cast("array<int>")).alias("b"), X.parse_limits(F.lit("20:1, 100:120,x:y,12345678901:1")).alias("c"), X.is_blank(F.lit(" ")).alias("d"),
        X.is_blank(F.lit(None).cast("string")).alias("e"), X.ratio(F.lit(1), F.lit(0), 1.0).alias("f"), X.percent(F.lit(0.5)).alias("g"), X.as_flag(F.lit(" TRUE")).alias("h"), X.whole_seconds(F.lit("2025-01-01T00:00:01.9Z")).alias("i"),
    ).first()
    assert (r.a, r.b, [tuple(x) for x in r.c], r.d, r.e, r.f, r.g, r.h) == (2, None, [(20, 1), (100, 120), (None, None), (12345678901, 1)], True, True, 1.0, "50.00%", True)
    assert r.i == datetime(2025, 1, 1, 0, 0, 1)


def test_file_report(spark):
    person = lambda p: {"puuid": p}
    snapshots = docs(spark, {"players": [person("p1"), person("p2")]}, {"players": [person("p1")]}, {"players": []}, "broken", [1])
    details = docs(spark, {"masteries": [person("p1")]}, {"masteries": [person("p3"), person("p9")]})
    got = integrity.file_integrity(snapshots, details)
    s = got["summary"].first()
    assert (s.total_evaluated, s.entities, s.detail_entities, s.missing_details, s.missing_entities, s.broken, s.total_errors) == (4, 2, 2, 1, 1, 1, 3)
    assert (s.error_rate, s.mean_appearances, s.duplicate_rate, s.duplicate_detail_rate) == (0.75, 1.5, 0.5, 0.0)
    assert [(r.entity_id, r.n) for r in got["duplicated"].collect()] == [("p1", 2)]
    assert [(r.entity_id, r.path) for r in got["missing_details"].collect()] == [("p2", "/0")]
    assert [r.entity_id for r in got["missing_entities"].collect()] == ["p3"]
    none = integrity.file_integrity(snapshots.where("false"), details.where("false"))["summary"].first()
    assert (none.error_rate, none.duplicate_rate, none.mean_appearances) == (1.0, 0.0, 0.0)


def test_entries_end_at_the_first_non_object(spark):
    frame = docs(spark, {"players": [{"puuid": "a"}, {"puuid": ""}, {"puuid": "a"}, 5, {"puuid": "b"}]})
    assert [r.entity_id for r in integrity.snapshot_entries(frame, "players", "puuid").collect()] == ["a", "a"]


def test_ledger_report(spark):
    tasks = spark.createDataFrame([(1, 1, "/a", "success", 1, None, None, None), (2, 1, " ", "failed", 1, None, None, None)], schemas.SNAPSHOT_TASKS)
    ends = spark.createDataFrame([(11, 1, "p", "/a", "success", 1, None, None, None), (12, 1, "q", "/b", "failed", 1, None, None, "e")], schemas.DETAIL_TASKS)
    entry = lambda *ids: [(i, f"/{i}", None, None) for i in ids]
    base = ("na1", "R", "GOLD", "I")
    records = [
        ("fine", *base, entry(1), None, 11, "success", "/m", None, None), ("old", *base, entry(2, 1, 2, 99), None, 11, "success", "/m", None, None), ("none", None, "R", "", "I", None, None, None, "pending", None, None, None),
        ("empty", *base, [], None, 12, "failed", None, None, None), ("zero", *base, entry(1), None, 0, "success", None, None, None),
    ]
    frame = spark.createDataFrame(records, schemas.RECORDS)
    got = {r.entity_id: r.issues for r in integrity.ledger_issues(frame, tasks, ends).collect()}
    assert got == {
        "old": ["player_task_2_not_success", "player_task_2_not_success"],
        "none": ["mastery_status: pending", "no_paths", "no_player_task_ids", "no_mastery_task_id", "missing_rank_info"],
        "empty": ["mastery_status: failed", "empty_paths", "empty_player_task_ids", "mastery_task_12_not_success"],
        "zero": ["no_mastery_task_id"],
    }
    found = integrity.integrity_check(frame, tasks, ends)
    assert sorted(found) == ["ledger_errors", "ledger_issues", "ledger_summary"]
    summary = {r.kind: r for r in found["ledger_summary"].collect()}
    assert [(summary[k].total, summary[k].failed, summary[k].discarded, summary[k].error_rate) for k in ("snapshot", "detail")] == [(2, 1, 1, 0.5), (2, 1, 0, 0.5)]
    assert (summary["detail"].records, summary["detail"].faulty_records, summary["detail"].growth_percent, summary["detail"].repeated) == (5, 4, 100.0, 1)
    assert integrity.history_length_stats(frame.where("false")).first().growth_percent == -100
    assert integrity.task_error_rate(tasks.where("false"), "x").first().error_rate == 0
    assert sorted((r.kind, r.error_message, r.n) for r in found["ledger_errors"].collect()) == [("detail", "e", 1), ("snapshot", None, 1)]


def test_lookups(spark):
    stats = spark.createDataFrame([("GOLD", "I", 2, 5), ("GOLD", "II", 1, 100), ("IRON", "II", 1, 3), ("IRON", "I", 0, 999)], "tier string, division string, loop_count long, entity_count long")
    assert lookups.next_bracket(stats).first()[:2] == ("IRON", "I")
    assert lookups.next_bracket(stats, tier="GOLD").first()[:2] == ("GOLD", "II")
    assert sorted(r[:2] for r in lookups.next_bracket(stats, by=["tier"]).collect()) == [("GOLD", "II"), ("IRON", "I")]
    tie = stats.withColumns({"loop_count": F.lit(1), "entity_count": F.lit(1)})
    assert lookups.next_bracket(tie).first()[:2] == ("IRON", "I")
    tasks = spark.createDataFrame([(5, "p1"), (3, "p1"), (4, "p2")], "task_id long, entity_id string")
    got = lookups.task_for_entity(tasks, tasks.where("task_id != 3"), spark.createDataFrame([("p1",), ("p9",)], "entity_id string"))
    assert sorted(got.collect()) == [("p1", 5), ("p9", -1)]
    assert lookups.bracket_grid(spark, [], ["I"]).count() == 0


def test_features(spark):
    at = datetime(2025, 1, 1)
    details = spark.createDataFrame([("p1", 1, 10, at), ("p1", 2, 20, at), ("p2", 9, 5, at), ("p3", 1, 1, at)], "entity_id string, item_id long, points long, last_played timestamp")
    items = spark.createDataFrame([("1", "Ann"), ("2", "Bo")], "item_id string, item_name string")
    entities = spark.createDataFrame([("p1", "x"), ("p1", "y"), ("p2", "z"), ("p4", "w")], "entity_id string, name string")
    got = features.feature_matrix(entities, details, items, ["Ann", "Bo"])
    assert got.columns == ["entity_id", "name", "Ann", "Bo", "Ann_lastPlayed", "Bo_lastPlayed", "total_points"]
    assert sorted((r.entity_id, r.name, r.Ann, r.Bo, r.total_points) for r in got.collect() if r.name) == [("p1", "x", 10, 20, 30), ("p1", "y", 10, 20, 30), ("p2", "z", None, None, 5)]
    assert [(r.name, r.Ann) for r in got.collect() if r.entity_id == "p3"] == [(None, 1)]
    twice = features.item_lookup(details.union(details.where("points = 10").withColumn("points", F.lit(99).cast("long"))), items).where("item_name is not null")
    assert features.pivot_key_guard(twice).count() == 1
    with pytest.raises(Exception, match="more than once"):
        features.pivot_points(twice, ["Ann"]).collect()
    later = twice.withColumn("last_played", F.when(F.col("points") == 99, F.lit(datetime(2025, 2, 1))).otherwise(F.col("last_played")))
    assert {r.Ann for r in features.pivot_details(later, ["Ann"], {"": "points"}, "latest").collect()} == {99, 1}


def test_usage(spark):
    seen = spark.createDataFrame([("a", datetime(2025, 1, 1, 0, 0, s)) for s in range(11)] + [("b", datetime(2025, 1, 1))], "k string, ts timestamp_ntz")
    limits = spark.createDataFrame([(20, 10), (0, 5)], "limit long, period long")
    got = {r.k: r.efficiency for r in usage.throughput_efficiency(seen, limits, ["k"]).collect()}
    assert got == {"a": pytest.approx(55.0), "b": 0.0}
    assert sum(r.n for r in usage.bucket_usage(seen, limits).collect()) == 24


def test_layout_and_scans(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    frame = spark.createDataFrame([("p1", "na1", "R", "GOLD", "15.1", "I"), ("p2", "na1", "R", "GOLD", "15.10", "I")], "entity_id string, region string, queue string, tier string, patch string, division string")
    sinks.write_snapshots(frame, root, F.lit(datetime(2025, 1, 1, 9, 8, 7)), "json")
    parts = sorted(str(p.relative_to(root)) for p in (tmp_path / "snapshots").glob("*/*/*/*/*"))
    assert parts == ["region=na1/queue=R/tier=GOLD/patch=15.1/date=250101", "region=na1/queue=R/tier=GOLD/patch=15.10/date=250101"]
    got = documents.scan_bracket(spark, root, patch="15.10", tier=None)
    assert [(r.patch, r.date) for r in got.collect()] == [("15.10", "250101")]
    assert "PartitionFilters: [isnotnull(patch" in got._jdf.queryExecution().toString()
    r = got.select(F.try_variant_get("doc", "$.time", "string").alias("t"), F.try_variant_get("doc", "$.loose_date", "string").alias("d")).first()
    assert (r.t, r.d) == ("090807", "250101")

    info = spark.createDataFrame([("p1", "na1", "R", "GOLD", "I", datetime(2024, 12, 31, 1, 2, 3))], "entity_id string, region string, queue string, tier string, division string, latest_logged_at timestamp")
    details = spark.createDataFrame([("p1", 5, "15.1"), ("px", 6, "15.1")], "entity_id string, points long, patch string")
    sinks.write_details(details, info, str(tmp_path / "details"))
    assert [p.name for p in (tmp_path / "details").glob("*/*/*/*/date=*")] == ["date=241231"]


def test_items_bundles_reports_ledger(spark, tmp_path):
    item = docs(spark, {"data": {"Ann": {"id": "Ann", "key": "1"}, "Bo": {"id": "Bo", "key": "22"}}})
    items = documents.item_dimension(item)
    assert sorted(items.collect()) == [("1", "Ann"), ("22", "Bo")]
    sinks.write_bundle({"items": items}, str(tmp_path), "api", F.lit("now"))
    assert sorted(spark.read.parquet(f"{tmp_path}/items").columns) == ["fetched_at", "item_id", "item_name", "source"]
    sinks.write_report(items, {"more": items}, str(tmp_path / "report"))
    assert spark.read.json(f"{tmp_path}/report/summary").count() == 2
    spark.createDataFrame([], schemas.RUNS).write.parquet(f"{tmp_path}/ledger/runs")
    assert documents.read_ledger(spark, f"{tmp_path}/ledger", "runs").columns == schemas.RUNS.names
    (tmp_path / "docs").mkdir()
    with pytest.raises(Exception, match="no document|PATH"):
        documents.scan_latest(spark, f"{tmp_path}/docs")


def test_referential_audit(spark):
    child = spark.createDataFrame([(1, "/a"), (2, "/a"), (None, None), (None, None)], "run_id long, path string")
    parent = spark.createDataFrame([(1,)], "run_id long")
    got = integrity.referential_audit([("fk", child, "run_id", parent, "run_id")], [("unique", child, "path")]).collect()
    assert sorted(tuple(r) for r in got) == [("fk", "2", 1), ("unique", "/a", 2)]


def test_no_landed_document_holds_a_share_of_the_table(spark):
    class Many:
        def conversation_docs(self):
            return spark.range(4000).select(F.concat(F.lit("/c/"), "id").alias("path"), F.try_parse_json(F.to_json(F.struct(F.col("id").alias("conv_id")))).alias("doc"))

    many = Many()
    many.spark = spark
    docs = documents.scan_bracket(spark, queries.landed_documents(many), shard="3")
    found = validation.explode_objects(docs.select("path", "doc"), "turns").groupBy("path").agg(F.collect_list(F.try_variant_get("value", "$.conv_id", "long")).alias("ids")).collect()
    assert sorted(i for r in found for i in r.ids) == list(range(3, 4000, 10))
    assert max(len(r.ids) for r in found) <= 100


def test_entries_in_one_file_are_dealt_and_their_fields_read_once(spark):
    """A small file is one split, however many rows it has; a field is taken out of its variant once."""
    rows = Roles(spark, "/root/testdata/sf0.001").entry_rows()
    assert rows.rdd.getNumPartitions() == 4
    plan = validation.validate(rows.withColumn("value", F.try_parse_json("entry")), schemas.SNAPSHOT_FIELDS)._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"$.{name}") <= 2 for name in schemas.SNAPSHOT_FIELDS)
