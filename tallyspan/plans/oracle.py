"""DuckDB SQL with the rows of plans/queries.py."""

from __future__ import annotations

from tallyspan.plans.roles import ROLES, SEGMENTS, TASKS_AS_OF, TYPES

AS_OF = f"TIMESTAMP '{TASKS_AS_OF}'"
NAMES = [t for t in TYPES if t != "LARGE"]


def wide(names: list[str], value: str, suffix: str = "") -> str:
    return ", ".join(f"max({value}) FILTER (WHERE item_name = '{n}') AS \"{n}{suffix}\"" for n in names)


IDS = "array_to_string(h, ',')"
CLEAN = f"""
, lost AS (SELECT task_id FROM snapshot_tasks WHERE run_id < 10 AND status <> 'success')
, broken AS (SELECT task_id FROM detail_tasks WHERE run_id < 10 AND status <> 'success')
, both_tasks AS (SELECT 'snapshot' AS kind, * FROM snapshot_tasks UNION ALL SELECT 'detail', * FROM detail_tasks)
"""
FILES = """
, entries AS (SELECT strftime(ts, '%Y%m%d') AS path, CAST(entity_id AS VARCHAR) AS entity_id FROM tasks WHERE status = 'failed')
, detail_files AS (SELECT CAST(entity_id AS VARCHAR) AS entity_id, max('y' || year(ts)) AS path, count(DISTINCT year(ts)) AS files FROM snapshot_tasks WHERE status = 'success' GROUP BY 1)
, seen AS (SELECT entity_id, count(*) AS n, array_to_string(list(path ORDER BY path), ',') AS paths, min(path) AS first_path FROM entries GROUP BY 1)
"""
FOLD = """
, marked AS (SELECT *, CASE WHEN player_count < coalesce(lag(player_count) OVER (PARTITION BY tier ORDER BY seq), 0) THEN 1 ELSE 0 END AS turn FROM pages_seen {where})
, turned AS (SELECT *, sum(turn) OVER (PARTITION BY tier ORDER BY seq) AS turns FROM marked)
, runs_of AS (SELECT tier, turns, count(*) AS n, arg_max(player_count, seq) AS last_count FROM turned GROUP BY 1, 2)
, folded AS (SELECT tier, CAST(n + CASE WHEN turns = 0 THEN 1 ELSE 0 END AS BIGINT) AS page, CAST(turns AS BIGINT) AS loop_count, last_count FROM runs_of QUALIFY row_number() OVER (PARTITION BY tier ORDER BY turns DESC) = 1)
"""
STATS = f"""
, loops AS (SELECT tier, division, count(*) % 7 AS loop_count FROM tasks t JOIN brackets b ON t.entity_id = b.entity_id WHERE priority = '3-MEDIUM' AND region = 'EUROPE' AND tier <> 'BUILDING' GROUP BY 1, 2)
, counts AS (SELECT tier, division, count(*) AS entity_count FROM records WHERE region = 'EUROPE' AND detail_patch = 'p2000' GROUP BY 1, 2)
, grid AS (SELECT * FROM (SELECT unnest({SEGMENTS}) AS tier) CROSS JOIN (SELECT unnest(['I', 'II', 'III', 'IV']) AS division))
, stats AS (SELECT g.tier, g.division, coalesce(loop_count, 0) AS loop_count, coalesce(entity_count, 0) AS entity_count FROM grid g LEFT JOIN loops l ON g.tier = l.tier AND g.division = l.division LEFT JOIN counts c ON g.tier = c.tier AND g.division = c.division)
"""
NOVELTY = """
, batches AS (SELECT *, day(logged_at) AS batch_id FROM sightings)
, recorded AS (SELECT DISTINCT entity_id, tier FROM batches WHERE batch_id <= 3)
, snapshot AS (SELECT * FROM batches WHERE batch_id > 3)
, novel AS (SELECT DISTINCT batch_id, entity_id, tier FROM snapshot s WHERE NOT EXISTS (SELECT 1 FROM recorded r WHERE r.entity_id = s.entity_id AND r.tier = s.tier))
"""
VALID = """
, checked AS (SELECT event_id, user_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k: missing' WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 10 THEN 'k: invalid' ELSE '' END AS errors, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
"""
ISSUES = """
, places AS (SELECT entity_id, unnest(h) AS task_id, unnest(range(len(h))) AS pos FROM records)
, bad_history AS (SELECT p.entity_id, array_to_string(list('player_task_' || p.task_id || '_not_success' ORDER BY pos), '; ') AS text FROM places p JOIN snapshot_tasks t ON p.task_id = t.task_id WHERE t.status <> 'success' GROUP BY 1)
, issues AS (
  SELECT r.entity_id, concat_ws('; ', CASE WHEN detail_status <> 'success' THEN 'mastery_status: ' || detail_status END, b.text,
    CASE WHEN detail_task_id IS NULL OR detail_task_id = 0 THEN 'no_mastery_task_id' WHEN detail_status <> 'success' THEN 'mastery_task_' || detail_task_id || '_not_success' END,
    CASE WHEN region IS NULL THEN 'missing_rank_info' END) AS issues
  FROM records r LEFT JOIN bad_history b ON r.entity_id = b.entity_id)
"""
ENTRIES = """
, keyed AS (SELECT *, c_custkey AS k, c_custkey // 25 AS page, (c_custkey // 25) % 3 = 0 AS odd FROM customer)
, typed AS (
  SELECT k AS entity_id, page, CASE WHEN odd AND k % 11 = 3 THEN NULL ELSE 'RANKED' END AS "queueType", CASE WHEN odd AND k % 13 = 5 THEN NULL ELSE c_mktsegment END AS tier, CASE WHEN odd AND k % 17 = 2 THEN NULL ELSE 'I' END AS rank,
    c_name AS puuid, CASE WHEN odd AND c_acctbal < 0 THEN NULL ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS "leaguePoints",
    CASE WHEN k % 6 IN (0, 1) THEN 12 WHEN k % 6 = 2 THEN 1 WHEN odd AND k % 6 IN (3, 4) THEN NULL ELSE k END AS wins, CAST(c_nationkey AS BIGINT) AS losses,
    CASE WHEN odd AND k % 5 = 3 THEN NULL ELSE k % 5 IN (0, 1, 3) END AS veteran, false AS inactive, true AS "freshBlood", CASE WHEN odd AND k % 19 = 0 THEN NULL ELSE false END AS "hotStreak"
  FROM keyed)
, entries_checked AS (
  SELECT *, concat_ws('; ', CASE WHEN "queueType" IS NULL THEN 'queueType: invalid' END, CASE WHEN tier IS NULL THEN 'tier: null' END, CASE WHEN rank IS NULL THEN 'rank: missing' END, CASE WHEN "leaguePoints" IS NULL THEN 'leaguePoints: invalid' END,
    CASE WHEN wins IS NULL THEN 'wins: invalid' END, CASE WHEN veteran IS NULL THEN 'veteran: invalid' END, CASE WHEN "hotStreak" IS NULL THEN 'hotStreak: null' END) AS errors
  FROM typed)
"""
PAGES = """
, pages AS (SELECT task_id // 64 AS page, coalesce(list(entity_id ORDER BY task_id) FILTER (WHERE status = 'failed'), []) AS seen FROM tasks GROUP BY 1)
, page_entries AS (SELECT '/s/' || page AS path, CAST(unnest(CASE WHEN page % 10 = 3 THEN seen[1:2] ELSE seen END) AS VARCHAR) AS entity_id FROM pages WHERE page % 10 < 5)
, files AS (SELECT DISTINCT entity_id, year(ts) AS year, '/d/' || entity_id || '/' || year(ts) AS path FROM snapshot_tasks WHERE status = 'success')
, file_entities AS (SELECT CAST(entity_id AS VARCHAR) AS entity_id, max(path) AS path, count(*) AS files FROM files WHERE entity_id % 9 <> 0 GROUP BY 1)
, faulty AS (
  SELECT '/s/' || page AS path, 'snapshot' AS kind FROM pages WHERE page % 10 IN (5, 6, 7) OR (page % 10 IN (0, 1, 2, 4) AND len(seen) = 0)
  UNION ALL SELECT path, 'detail' FROM files WHERE entity_id % 9 = 0)
, page_seen AS (SELECT entity_id, count(*) AS n FROM page_entries GROUP BY 1)
, page_both AS (SELECT s.n, d.files FROM page_seen s FULL JOIN file_entities d ON s.entity_id = d.entity_id)
, page_totals AS (SELECT count(n) AS entities, count(files) AS detail_entities, count(*) FILTER (WHERE files IS NULL) AS missing_details, count(*) FILTER (WHERE n IS NULL) AS missing_entities,
  count(*) FILTER (WHERE n > 1) AS duplicated, count(*) FILTER (WHERE files > 1) AS duplicated_details, avg(n) AS mean_n, (SELECT count(*) FROM faulty) AS broken FROM page_both)
"""
HISTORY = "SELECT avg(len(h)) * 100 - 100 AS growth_percent, count(*) FILTER (WHERE len(h) > 1) AS repeated FROM records"


def rate(kind: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, count(*) AS total, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE file_path IS NULL) AS discarded, count(*) FILTER (WHERE status = 'failed') / count(*) AS error_rate FROM {source}"


ONE_KEY = ", one_key AS (SELECT 'all' AS tier, event_id AS seq, user_id AS player_count FROM events)" + FOLD.format(where="").replace("pages_seen", "one_key") + "SELECT * FROM folded"


def swept(where: str = "true") -> str:
    """Silent runs and what cleaning up after them leaves of records and tasks."""
    return f"""
, swept AS (SELECT run_id FROM runs WHERE last_heartbeat < {AS_OF} - INTERVAL 10 DAY AND {where})
, lost AS (SELECT task_id FROM snapshot_tasks WHERE run_id IN (SELECT run_id FROM swept) AND status <> 'success')
, broken AS (SELECT task_id FROM detail_tasks WHERE run_id IN (SELECT run_id FROM swept) AND status <> 'success')
, both_tasks AS (SELECT 'snapshot' AS part, * FROM snapshot_tasks UNION ALL SELECT 'detail', * FROM detail_tasks)
, hit AS (SELECT *, run_id IN (SELECT run_id FROM swept) AND status <> 'success' AS bad FROM both_tasks)
, judged AS (SELECT run_id, run_id IN (SELECT run_id FROM swept) AS bad FROM runs)
SELECT 'run' AS part, run_id AS id, CASE WHEN bad THEN 'failed' ELSE 'running' END AS status, CASE WHEN bad THEN 'Run stalled or silent cancelled' END AS error_message, CASE WHEN bad THEN {AS_OF} END AS finished_at FROM judged
UNION ALL SELECT part, task_id, CASE WHEN bad THEN 'failed' ELSE status END, CASE WHEN bad THEN 'Run failed or cancelled' ELSE error_message END, CASE WHEN bad THEN {AS_OF} ELSE ts END FROM hit
UNION ALL SELECT 'record', entity_id, CASE WHEN detail_task_id IN (SELECT task_id FROM broken) THEN 'failed' ELSE detail_status END, NULL, NULL
FROM records WHERE NOT (len(h) = 1 AND h[1] IN (SELECT task_id FROM lost))"""


#: Pages of two events in three groups; those of a later group without a new (entity, tier) are dropped.
RECORDED = """
, cuts AS (SELECT max(event_id) // 2 // 3 AS c1, max(event_id) // 2 * 2 // 3 AS c2 FROM events)
, paged AS (SELECT s.*, seq // 2 AS page, CASE WHEN seq // 2 < c1 THEN 0 WHEN seq // 2 < {second} THEN 1 ELSE 2 END AS g FROM sightings s, cuts)
, one AS (SELECT * FROM paged QUALIFY row_number() OVER (PARTITION BY page, entity_id ORDER BY seq DESC) = 1)
, state0 AS (SELECT entity_id, tier FROM one WHERE g = 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY logged_at DESC, seq DESC) = 1)
, new1 AS (SELECT DISTINCT page FROM paged p WHERE g = 1 AND NOT EXISTS (SELECT 1 FROM state0 s WHERE s.entity_id = p.entity_id AND s.tier = p.tier))
, first_two AS (SELECT * FROM one WHERE g = 0 OR (g = 1 AND page IN (SELECT page FROM new1)))
, state1 AS (SELECT entity_id, tier FROM first_two QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY g DESC, logged_at DESC, seq DESC) = 1)
, new2 AS (SELECT DISTINCT page FROM paged p WHERE g = 2 AND NOT EXISTS (SELECT 1 FROM state1 s WHERE s.entity_id = p.entity_id AND s.tier = p.tier))
, recorded AS (SELECT * FROM first_two UNION ALL SELECT * FROM one WHERE g = 2 AND page IN (SELECT page FROM new2))
"""
HISTORIES = """
SELECT entity_id, arg_max(region, place) AS region, arg_max(queue, place) AS queue, arg_max(tier, place) AS tier, arg_max(division, place) AS division, count(*) AS n_history,
  array_to_string(list(task_id ORDER BY place), ',') AS task_ids, arg_max(logged_at, place) AS latest_logged_at, 'pending' AS detail_status
FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM {source}) GROUP BY entity_id"""

CHUNKS = """
, placed AS (SELECT *, row_number() OVER (ORDER BY logged_at, seq) AS place FROM sightings)
SELECT entity_id, count(*) AS n_history, arg_min(task_id, place) AS first_task_id, arg_max(task_id, place) AS latest_task_id, arg_max(patch, place) AS latest_patch, max(logged_at) AS latest_logged_at,
  arg_max(region, place) AS region, arg_max(queue, place) AS queue, arg_max(tier, place) AS tier, arg_max(division, place) AS division FROM placed GROUP BY entity_id"""

CURSORS = FOLD.format(where="WHERE seq <= 15")

SQL = {
    "feature_matrix": f"""
, wide AS (SELECT entity_id, {wide(NAMES, "points")}, {wide(NAMES, "last_played", "_lastPlayed")} FROM numbered_named GROUP BY 1)
, totals AS (SELECT entity_id, CAST(sum(points) AS BIGINT) AS total_points FROM details GROUP BY 1)
SELECT coalesce(w.entity_id, t.entity_id) AS entity_id, e.name, e.tier, w.* EXCLUDE (entity_id), t.total_points
FROM wide w FULL JOIN totals t ON w.entity_id = t.entity_id LEFT JOIN entities e ON e.entity_id = coalesce(w.entity_id, t.entity_id)""".replace("numbered_named", "details"),
    "pivot_points": f"SELECT entity_id, {wide(TYPES, 'points')} FROM details GROUP BY 1",
    "pivot_last_played": f"SELECT entity_id, {wide(TYPES, 'last_played', '_lastPlayed')} FROM details GROUP BY 1",
    "total_points": "SELECT entity_id, CAST(sum(points) AS BIGINT) AS total_points FROM details GROUP BY 1",
    "pivot_key_guard": "SELECT entity_id, item_name, count(*) AS n FROM raw_details GROUP BY 1, 2 HAVING count(*) > 1",
    "item_lookup": "SELECT entity_id, CAST(item_id AS VARCHAR) AS item_id, CASE WHEN true_name <> 'LARGE' THEN true_name END AS item_name, points FROM numbered",
    "outer_merge": f"""
, a AS (SELECT entity_id, {wide(TYPES[:3], "points")} FROM details WHERE points >= 100 GROUP BY 1)
, b AS (SELECT entity_id, {wide(TYPES[:3], "points", "_small")} FROM details WHERE points < 100 GROUP BY 1)
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.* EXCLUDE (entity_id), b.* EXCLUDE (entity_id) FROM a FULL JOIN b ON a.entity_id = b.entity_id""",
    "attach_entities_right": "SELECT t.entity_id, name, tier, total_points FROM entities e RIGHT JOIN (SELECT entity_id, CAST(sum(points) AS BIGINT) AS total_points FROM details GROUP BY 1) t ON e.entity_id = t.entity_id",
    "upsert_records": """
SELECT entity_id, arg_max(region, logged_at) AS region, arg_max(queue, logged_at) AS queue, arg_max(tier, logged_at) AS tier, arg_max(division, logged_at) AS division, count(*) AS n_history,
  array_to_string(list(task_id ORDER BY logged_at, seq), ',') AS task_ids, array_to_string(list(patch ORDER BY logged_at, seq), ',') AS patches, max(logged_at) AS latest_logged_at, 'pending' AS detail_status
FROM sightings GROUP BY entity_id""",
    "latest_state": "SELECT entity_id, task_id, status FROM steps QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, task_id DESC, seq DESC) = 1",
    "mirror_detail_status": """
, ordered AS (SELECT *, task_id * 10 + seq AS place FROM steps)
, last_step AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, place DESC) = 1)
, claimed AS (SELECT entity_id, max(ts) AS ts FROM steps WHERE status = 'failed' GROUP BY 1)
SELECT r.entity_id, l.task_id AS detail_task_id, CASE WHEN c.ts >= l.ts THEN 'in_progress' ELSE l.status END AS detail_status, CASE WHEN l.status <> 'in_progress' THEN l.file_path END AS detail_path,
  l.ts AS detail_logged_at, 'p' || year(l.ts) AS detail_patch
FROM records r LEFT JOIN last_step l ON r.entity_id = l.entity_id LEFT JOIN claimed c ON r.entity_id = c.entity_id""",
    "run_state": """
, beats AS (SELECT run_id, ts FROM tasks UNION ALL SELECT run_id, ts FROM steps WHERE status = 'pending')
, own AS (SELECT run_id, min(ts) AS started_at, max(ts) AS last FROM tasks GROUP BY 1)
SELECT b.run_id, any_value(o.started_at) AS started_at, max(b.ts) AS last_heartbeat, CASE WHEN b.run_id % 5 = 0 THEN any_value(o.last) + INTERVAL 1 DAY END AS finished_at,
  CASE WHEN b.run_id % 5 <> 0 THEN 'running' WHEN b.run_id % 2 = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN b.run_id % 5 = 0 AND b.run_id % 2 = 1 THEN 'stopped' END AS error_message
FROM beats b JOIN own o ON b.run_id = o.run_id GROUP BY b.run_id""",
    "task_state": """
SELECT task_id, run_id, entity_id, arg_max(status, seq) AS status, count(*) FILTER (WHERE status = 'in_progress') AS attempts, max(ts) FILTER (WHERE status = 'in_progress') AS started_at,
  max(ts) FILTER (WHERE status IN ('success', 'failed')) AS finished_at, max(file_path) AS file_path, max(error) AS error_message
FROM steps GROUP BY 1, 2, 3""",
    "claim_pending": """
, claimed AS (SELECT entity_id FROM records WHERE detail_status IN ('pending', 'failed') ORDER BY entity_id LIMIT 400)
SELECT r.entity_id, CASE WHEN c.entity_id IS NOT NULL THEN 'in_progress' ELSE detail_status END AS detail_status, c.entity_id IS NOT NULL AS claimed FROM records r LEFT JOIN claimed c ON r.entity_id = c.entity_id""",
    "claim_stale": f"""
, claimed AS (SELECT entity_id FROM records WHERE latest_logged_at > {AS_OF} - INTERVAL 180 DAY AND (detail_logged_at IS NULL OR detail_logged_at < {AS_OF} - INTERVAL 365 DAY) AND detail_status <> 'in_progress')
SELECT r.entity_id, CASE WHEN c.entity_id IS NOT NULL THEN 'in_progress' ELSE detail_status END AS detail_status, c.entity_id IS NOT NULL AS claimed FROM records r LEFT JOIN claimed c ON r.entity_id = c.entity_id""",
    "sweep_stale_runs": f"""
, judged AS (SELECT *, last_heartbeat < {AS_OF} - INTERVAL 10 DAY AS stale FROM runs)
SELECT run_id, CASE WHEN stale THEN 'failed' ELSE 'running' END AS status, CASE WHEN stale THEN 'Run stalled or silent cancelled' END AS error_message, CASE WHEN stale THEN {AS_OF} END AS finished_at, last_heartbeat FROM judged""",
    "cleanup_run_tasks": CLEAN + f"""
, hit AS (SELECT *, run_id < 10 AND status <> 'success' AS bad FROM both_tasks)
SELECT kind, task_id, run_id, CASE WHEN bad THEN 'failed' ELSE status END AS status, CASE WHEN bad THEN {AS_OF} ELSE ts END AS finished_at, CASE WHEN bad THEN 'Run failed or cancelled' ELSE error_message END AS error_message FROM hit""",
    "cleanup_run_records": CLEAN + """
SELECT entity_id, len(h) AS n_history, detail_task_id, CASE WHEN detail_task_id IN (SELECT task_id FROM broken) THEN 'failed' ELSE detail_status END AS detail_status
FROM records WHERE NOT (len(h) = 1 AND h[1] IN (SELECT task_id FROM lost))""",
    "failed_task_records": CLEAN + "SELECT entity_id, detail_task_id FROM records WHERE detail_task_id IN (SELECT task_id FROM broken)",
    "cursor_fold": FOLD.format(where="") + "SELECT * FROM folded",
    "cursor_fold_one_key": ONE_KEY,
    "cursor_fold_in_steps": ONE_KEY,
    "claim_by_text_times": f"""
SELECT entity_id, tier, epoch_ms(latest_logged_at) + 500 AS seen_ms FROM records
WHERE latest_logged_at > {AS_OF} - INTERVAL 180 DAY AND (detail_logged_at IS NULL OR detail_logged_at < {AS_OF} - INTERVAL 365 DAY) AND detail_status <> 'in_progress'""",
    "claim_steps": f"""
, eligible AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS place FROM records
  WHERE latest_logged_at > {AS_OF} - INTERVAL 2000 DAY AND (detail_logged_at IS NULL OR detail_logged_at < {AS_OF} - INTERVAL 365 DAY) AND detail_status <> 'in_progress')
SELECT entity_id, CAST(place // 150 AS INTEGER) AS step, CASE WHEN place // 150 = 1 THEN 2 ELSE 1 END AS given FROM eligible WHERE place < 450""",
    "claim_large": """
, claimed AS (SELECT entity_id FROM records WHERE detail_status IN ('pending', 'failed') ORDER BY entity_id LIMIT (SELECT count(*) // 4 FROM customer))
SELECT r.entity_id, CASE WHEN c.entity_id IS NOT NULL THEN 'in_progress' ELSE detail_status END AS detail_status, c.entity_id IS NOT NULL AS claimed FROM records r LEFT JOIN claimed c ON r.entity_id = c.entity_id""",
    "sweep_cascade": swept(),
    "stream_sweep": swept("run_id % 5 <> 0"),
    "stream_records": RECORDED.format(second="c2") + HISTORIES.format(order="g, logged_at, seq", source="recorded"),
    "record_store": HISTORIES.format(order="logged_at, seq", source="sightings"),
    "upsert_chunks": CHUNKS,
    "history_store": CHUNKS,
    "feature_matrix_many_items": """
, cells AS (
  SELECT o_custkey AS entity_id, p_brand || ' ' || p_type AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS points, max(l_shipdate) AS last_played
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT c.entity_id, any_value(e.tier) AS tier, CAST(sum(points) AS BIGINT) AS total_points, count(*) FILTER (WHERE item NOT LIKE '%SMALL' AND regexp_matches(item, '^Brand#([1-9]|1[0-9]|2[0-5]) ')) AS filled,
  max(points) FILTER (WHERE item = 'Brand#1 PROMO') AS c0, max(points) FILTER (WHERE item = 'Brand#13 LARGE') AS c1, max(last_played) FILTER (WHERE item = 'Brand#25 STANDARD') AS c2
FROM cells c LEFT JOIN entities e ON c.entity_id = e.entity_id GROUP BY 1""",
    "history_stats_chunked": HISTORY,
    "ledger_issues_chunked": """
, places AS (SELECT entity_id, unnest(h) AS task_id FROM records)
SELECT entity_id, 'mastery_status: ' || detail_status AS issue FROM records WHERE detail_status <> 'success'
UNION ALL SELECT p.entity_id, 'player_task_' || p.task_id || '_not_success' FROM places p JOIN snapshot_tasks t ON p.task_id = t.task_id WHERE t.status <> 'success'
UNION ALL SELECT entity_id, 'no_mastery_task_id' FROM records WHERE detail_task_id IS NULL
UNION ALL SELECT entity_id, 'mastery_task_' || detail_task_id || '_not_success' FROM records WHERE detail_task_id IS NOT NULL AND detail_status <> 'success'
UNION ALL SELECT entity_id, 'missing_rank_info' FROM records WHERE region IS NULL""",
    "unmapped_items": "SELECT CAST(item_id AS VARCHAR) AS item_id, count(*) AS n, count(DISTINCT entity_id) AS entities, CAST(sum(points) AS BIGINT) AS points FROM numbered WHERE true_name = 'LARGE' GROUP BY 1",
    "feature_rejects": """
SELECT count(DISTINCT entity_id) AS rows, CAST(sum(points) AS BIGINT) AS total_points, count(*) FILTER (WHERE true_name = 'LARGE') AS rejected, CAST(sum(points) FILTER (WHERE true_name = 'LARGE') AS BIGINT) AS rejected_points,
  count(*) AS details, count(*) FILTER (WHERE true_name = 'LARGE') AS unmapped, CAST(sum(points) FILTER (WHERE true_name = 'LARGE') AS BIGINT) AS unmapped_points FROM numbered""",
    "write_twice": "SELECT tier, patch, CAST(seq % 2 AS INTEGER) AS batch, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM sightings GROUP BY 1, 2, 3",
    "record_snapshots": RECORDED.format(second="1000000000000") + """
, pages_in AS (SELECT DISTINCT page, g = 0 OR page IN (SELECT page FROM new1) AS taken FROM paged)
SELECT CASE WHEN taken THEN 'recorded' ELSE 'dropped' END AS part, count(*) AS n, CAST(sum(page) AS BIGINT) AS ids FROM pages_in GROUP BY 1
UNION ALL SELECT 'landed', count(*), CAST(sum(seq) AS BIGINT) FROM paged JOIN pages_in USING (page) WHERE taken
UNION ALL SELECT 'sighted', count(*), CAST(sum(page) AS BIGINT) FROM recorded""",
    "record_details": """
, claims AS (SELECT r.entity_id, max(t.task_id) AS task_id FROM records r JOIN tasks t ON r.entity_id = t.entity_id WHERE detail_status IN ('pending', 'failed') GROUP BY 1)
, rows_of AS (SELECT entity_id, points, points > 49 AND c_acctbal < 0 AS bad FROM raw_details JOIN customer ON entity_id = c_custkey)
, sums AS (SELECT entity_id, bool_or(bad) AS bad, CAST(sum(points) AS BIGINT) AS points FROM rows_of GROUP BY 1)
, done AS (SELECT c.entity_id, c.task_id, coalesce(NOT s.bad, false) AS good, s.points FROM claims c LEFT JOIN sums s ON c.entity_id = s.entity_id)
SELECT r.entity_id, coalesce(d.task_id, r.detail_task_id) AS detail_task_id, CASE WHEN d.task_id IS NULL THEN detail_status WHEN good THEN 'success' ELSE 'failed' END AS detail_status,
  CASE WHEN d.task_id IS NULL THEN detail_patch ELSE '15.10' END AS detail_patch, CASE WHEN d.task_id IS NULL THEN detail_path IS NOT NULL ELSE good END AS landed, CASE WHEN good THEN d.points END AS points
FROM records r LEFT JOIN done d ON r.entity_id = d.entity_id""",
    "incremental_audit": PAGES + """
SELECT entities + detail_entities AS total_evaluated, entities, detail_entities, missing_details, missing_entities, broken, missing_details + missing_entities + broken AS total_errors,
  (missing_details + missing_entities + broken) / (entities + detail_entities) AS error_rate, round(mean_n, 3) AS mean_appearances, duplicated / entities AS duplicate_rate, duplicated_details / detail_entities AS duplicate_detail_rate
FROM page_totals""",
    "ledger_tables": """
SELECT r.run_id, 'main' AS pipeline_name, 'running' AS status, t.tasks, t.paths
FROM runs r LEFT JOIN (SELECT run_id, count(*) AS tasks, nullif(count(DISTINCT file_path), 0) AS paths FROM snapshot_tasks GROUP BY 1) t ON r.run_id = t.run_id""",
    "cursor_get_or_create": CURSORS + """
SELECT w.tier, coalesce(page, 1) AS page, coalesce(loop_count, 0) AS loop_count
FROM (SELECT DISTINCT event_type AS tier FROM events UNION ALL SELECT 'unknown') w LEFT JOIN (SELECT * FROM folded WHERE tier <> 'click') f ON w.tier = f.tier""",
    "cursor_update": FOLD.format(where="") + "SELECT tier, CASE WHEN tier = 'click' THEN 0 ELSE page END AS page FROM folded",
    "bracket_stats": STATS + "SELECT * FROM stats",
    "next_bracket": STATS + "SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY tier ORDER BY loop_count, entity_count, list_position(['I', 'II', 'III', 'IV'], division)) = 1",
    "entities_in_timespan": f"SELECT entity_id FROM records WHERE tier = 'BUILDING' AND latest_logged_at > {AS_OF} - INTERVAL 500 DAY",
    "entities_in_period": "SELECT entity_id FROM records WHERE region = 'ASIA' AND detail_patch = 'p2000'",
    "entity_info": "SELECT c_custkey AS entity_id, region, queue, tier, division, latest_logged_at FROM customer LEFT JOIN records ON c_custkey = entity_id",
    "detail_status": "SELECT c_custkey AS entity_id, coalesce(detail_status, 'None') AS status FROM customer LEFT JOIN records ON c_custkey = entity_id",
    "task_for_entity": "SELECT c_custkey AS entity_id, coalesce(min(task_id), -1) AS task_id FROM customer LEFT JOIN detail_tasks ON c_custkey = entity_id AND run_id < 25 GROUP BY 1",
    "novel_entities": NOVELTY + "SELECT * FROM novel",
    "entities_without_details": FILES + "SELECT entity_id, first_path AS path FROM seen WHERE entity_id NOT IN (SELECT entity_id FROM detail_files)",
    "details_without_entities": FILES + "SELECT entity_id, path FROM detail_files WHERE entity_id NOT IN (SELECT entity_id FROM seen)",
    "referential_audit": """
SELECT 'tasks.run_id' AS "constraint", CAST(run_id AS VARCHAR) AS key, count(*) AS n FROM tasks WHERE run_id >= 45 GROUP BY 2
UNION ALL SELECT 'records.detail_task_id', CAST(detail_task_id AS VARCHAR), count(*) FROM records WHERE detail_task_id % 50 >= 45 GROUP BY 2
UNION ALL SELECT 'tasks.day', strftime(ts, '%Y%m%d'), count(*) FROM tasks GROUP BY 2 HAVING count(*) > 1""",
    "file_integrity_summary": FILES + """
, merged AS (SELECT s.n, d.files FROM seen s FULL JOIN detail_files d ON s.entity_id = d.entity_id)
, t AS (SELECT count(n) AS entities, count(files) AS detail_entities, count(*) FILTER (WHERE files IS NULL) AS missing_details, count(*) FILTER (WHERE n IS NULL) AS missing_entities,
  count(*) FILTER (WHERE n > 1) AS duplicated, count(*) FILTER (WHERE files > 1) AS duplicated_details, avg(n) AS mean_n FROM merged)
, b AS (SELECT count(*) FILTER (WHERE file_path IS NULL AND task_id % 10 = 0) AS broken FROM tasks)
SELECT entities + detail_entities AS total_evaluated, entities, detail_entities, missing_details, missing_entities, broken, missing_details + missing_entities + broken AS total_errors,
  (missing_details + missing_entities + broken) / (entities + detail_entities) AS error_rate, round(mean_n, 3) AS mean_appearances, duplicated / entities AS duplicate_rate, duplicated_details / detail_entities AS duplicate_detail_rate
FROM t, b""",
    "appearances": FILES + "SELECT entity_id, n, paths FROM seen",
    "duplicate_entities": FILES + "SELECT entity_id, n, paths FROM seen WHERE n > 1",
    "ledger_integrity_issues": ISSUES + "SELECT * FROM issues WHERE issues <> ''",
    "ledger_integrity_summary": ISSUES + f"""
SELECT r.*, (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM issues WHERE issues <> '') AS faulty_records, s.*
FROM ({rate("snapshot", "snapshot_tasks")} UNION ALL {rate("detail", "detail_tasks")}) r, ({HISTORY}) s""",
    "task_error_rate": rate("all", "tasks"),
    "history_length_stats": HISTORY,
    "errors_by_message": "SELECT CASE WHEN run_id % 3 <> 0 THEN error_message END AS error_message, count(*) AS n FROM tasks WHERE status = 'failed' GROUP BY 1",
    "explode_objects": "SELECT '/c/' || conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, length(text) AS n_chars FROM conversations",
    "validate_rows": VALID + "SELECT event_id, CASE WHEN errors = '' THEN k END AS k, errors FROM checked",
    "batch_gate": VALID + "SELECT event_id, event_id // 4 AS batch_id, CASE WHEN bool_and(errors = '') OVER (PARTITION BY event_id // 4) THEN 'accepted' ELSE 'quarantine' END AS verdict FROM checked",
    "parse_limits": 'SELECT c_custkey, 0 AS pos, CAST(c_nationkey AS BIGINT) AS "limit", 1 AS period FROM customer UNION ALL SELECT c_custkey, 1, c_custkey % 100, c_custkey % 60 + 1 FROM customer',
    "epoch_ms_to_ts": "SELECT event_id, 1704067200000 + event_id * 86399 AS ms, ((1704067200000 + event_id * 86399) // 1000) % 86400 AS second_of_day FROM events",
    "partition_keys": "SELECT event_id, strftime(ts, '%y%m%d') AS date, strftime(ts, '%H%M%S') AS time FROM events",
    "domain_check": f"SELECT c_custkey, c_mktsegment, c_mktsegment IN ({', '.join(repr(s) for s in SEGMENTS[:3])}) AS in_domain FROM customer",
    "throughput_efficiency": """
, spans AS (SELECT event_type, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1)
SELECT event_type, round(max(n * 1000000 / us / (l.a / l.b) * 100), 6) AS efficiency FROM spans, (VALUES (20, 3600), (500, 86400)) l(a, b) GROUP BY 1""",
    "record_snapshot_batch": NOVELTY + """
, counted AS (SELECT batch_id, count(DISTINCT entity_id) AS total FROM snapshot GROUP BY 1)
, fresh AS (SELECT batch_id, count(DISTINCT entity_id) AS unique_new FROM novel GROUP BY 1)
SELECT c.batch_id, coalesce(unique_new, 0) AS unique_new, total, CASE WHEN unique_new > 0 THEN total ELSE 0 END AS sightings, coalesce(unique_new, 0) = 0 AS discarded FROM counted c LEFT JOIN fresh f ON c.batch_id = f.batch_id""",
    "record_detail_batch": """
, claimed AS (SELECT entity_id FROM records WHERE detail_status IN ('pending', 'failed'))
, rows_of AS (SELECT o_custkey AS entity_id, CAST(l_quantity AS BIGINT) AS points, l_quantity > 49 AND o_custkey % 2 = 0 AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11')
, judged AS (SELECT entity_id, bool_or(bad) AS bad, CAST(sum(points) AS BIGINT) AS points FROM rows_of GROUP BY 1)
, ends AS (SELECT c.entity_id, CASE WHEN j.bad IS NULL THEN 'Failed to fetch detail data.' WHEN j.bad THEN 'Invalid detail data.' WHEN c.entity_id % 11 = 0 THEN 'Failed to save mastery data.' END AS error, j.points FROM claimed c LEFT JOIN judged j ON c.entity_id = j.entity_id)
SELECT entity_id, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN points END AS points FROM ends""",
    "partition_roundtrip": "SELECT tier, patch || '0' AS patch, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM sightings GROUP BY 1, 2",
    "scan_bracket": "SELECT '3' AS shard, conv_id, count(*) AS turns FROM conversations WHERE conv_id % 10 = 3 GROUP BY conv_id",
    "scan_latest": "SELECT count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM conversations",
    "clean_bundle": f"""
SELECT role AS name, count(*) AS n, 'entities' AS part FROM conversations GROUP BY 1 UNION ALL SELECT role, count(*), 'details' FROM conversations GROUP BY 1
UNION ALL SELECT unnest({NAMES}), 1, 'items'""",
    "stream_ingest": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE value >= 5 AND event_type IN ('click', 'view') GROUP BY 1",
    "stream_cursor": FOLD.format(where="") + "SELECT * FROM folded",
    "stream_stale_runs": f"SELECT run_id, strftime(last_heartbeat, '%Y-%m-%d') AS last_heartbeat FROM runs WHERE run_id % 5 <> 0 AND last_heartbeat < {AS_OF} - INTERVAL 10 DAY",
    "stale_run_count": f"SELECT count(*) AS n FROM runs WHERE last_heartbeat < {AS_OF} - INTERVAL 10 DAY",
    "next_bracket_overall": STATS + f"SELECT * FROM stats ORDER BY loop_count, entity_count, list_position({SEGMENTS}, tier), list_position(['I', 'II', 'III', 'IV'], division) LIMIT 1",
    "bucket_usage": 'SELECT l.a AS "limit", l.b AS period, epoch_us(ts) // 1000000 // l.b AS bucket, count(*) AS n, round(count(*) / l.a, 6) AS used FROM events, (VALUES (20, 3600), (500, 86400)) l(a, b) GROUP BY 1, 2, 3',
    "item_dimension": "SELECT entity_id, CAST(item_id AS VARCHAR) AS item_id, CASE WHEN true_name <> 'LARGE' THEN true_name END AS item_name, points FROM numbered",
    "require_keys": ENTRIES + "SELECT entity_id, tier FROM entries_checked WHERE tier IS NOT NULL AND rank IS NOT NULL",
    "validate_snapshot_rows": ENTRIES + "SELECT * EXCLUDE (page) FROM entries_checked",
    "validate_detail_rows": """
SELECT entity_id, item_id, CAST(entity_id AS VARCHAR) AS puuid, item_id AS "championId", CASE WHEN points % 4 > 0 THEN points % 4 END AS "championLevel", points AS "championPoints", item_id * 1000 AS "lastPlayTime",
  -5 AS "championPointsSinceLastLevel", CASE WHEN entity_id % 7 <> 0 THEN 10 END AS "championPointsUntilNextLevel", CASE item_id WHEN 1 THEN 'A,S-' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS grades,
  concat_ws('; ', CASE WHEN points % 4 = 0 THEN 'championLevel: invalid' END, CASE WHEN entity_id % 7 = 0 THEN 'championPointsUntilNextLevel: missing' END, CASE item_id WHEN 2 THEN 'milestoneGrades: null' WHEN 3 THEN 'milestoneGrades: invalid' END) AS error_text
FROM numbered""",
    "file_integrity": PAGES + """
SELECT entities + detail_entities AS total_evaluated, entities, detail_entities, missing_details, missing_entities, broken, missing_details + missing_entities + broken AS total_errors,
  (missing_details + missing_entities + broken) / (entities + detail_entities) AS error_rate, round(mean_n, 3) AS mean_appearances, duplicated / entities AS duplicate_rate, duplicated_details / detail_entities AS duplicate_detail_rate
FROM page_totals""",
    "faulty_files": PAGES + "SELECT path, kind FROM faulty",
    "first_detail_entity": PAGES + "SELECT entity_id, path, files FROM file_entities",
    "integrity_check": ISSUES + PAGES + """
SELECT 'ledger_summary' AS part, 2 AS n UNION ALL SELECT 'ledger_issues', count(*) FROM issues WHERE issues <> ''
UNION ALL SELECT 'ledger_errors', count(DISTINCT (priority, error_message)) FROM tasks WHERE status = 'failed' AND priority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'files_summary', 1 UNION ALL SELECT 'files_duplicated', duplicated FROM page_totals UNION ALL SELECT 'files_duplicated_paths', CAST(coalesce(sum(n), 0) AS BIGINT) FROM page_seen WHERE n > 1 UNION ALL SELECT 'files_missing_details', missing_details FROM page_totals
UNION ALL SELECT 'files_missing_entities', missing_entities FROM page_totals UNION ALL SELECT 'files_faulty', broken FROM page_totals""",
    "write_snapshots": """
SELECT region, queue, tier, patch || '0' AS patch, strftime(logged_at, '%y%m%d') AS date, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, min(strftime(logged_at, '%H%M%S')) AS first_time,
  strftime(max(logged_at), '%y%m%d') AS loose_date, max(logged_at) AS fetched_at FROM sightings GROUP BY 1, 2, 3, 4, 5""",
    "write_details": """
SELECT region, queue, tier, '15.10' AS patch, strftime(latest_logged_at, '%y') || '0701' AS date, '090807' AS time, count(*) AS n, CAST(sum(points) AS BIGINT) AS points
FROM details d JOIN records r ON d.entity_id = r.entity_id GROUP BY 1, 2, 3, 5""",
    "write_bundle": f"""
SELECT 'api' AS source, {AS_OF} AS fetched_at, part, n FROM (
  SELECT 'entities' AS part, count(*) AS n FROM entities UNION ALL SELECT 'details', count(*) FROM details UNION ALL SELECT 'items', {len(NAMES)})""",
    "write_report": f"""
SELECT r.kind, total, failed, printf('%.2f%%', error_rate * 100) AS error_rate, m.messages
FROM ({rate("snapshot", "snapshot_tasks")} UNION ALL {rate("detail", "detail_tasks")}) r
LEFT JOIN (SELECT CASE priority WHEN '1-URGENT' THEN 'snapshot' ELSE 'detail' END AS kind, count(DISTINCT error_message) AS messages FROM tasks WHERE status = 'failed' AND priority IN ('1-URGENT', '2-HIGH') GROUP BY 1) m ON r.kind = m.kind""",
    "stream_documents": ENTRIES + """
, judged AS (SELECT *, bool_and(errors = '') OVER (PARTITION BY page) AS whole FROM entries_checked)
SELECT CASE WHEN whole THEN 'accepted' ELSE 'quarantine' END AS verdict, tier, count(*) AS n, CAST(sum("leaguePoints") AS BIGINT) AS points FROM judged GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    """Each with the role views in front."""
    return {name: ROLES + text for name, text in SQL.items()}
