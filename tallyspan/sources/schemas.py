"""Schemas of the ledger tables, of its event logs and of the nested documents, and the ordered domains."""

from __future__ import annotations

from pyspark.sql import types as T

#: The ranks and divisions of the data's domain, best last and best first.
TIERS = ["IRON", "BRONZE", "SILVER", "GOLD", "PLATINUM", "EMERALD", "DIAMOND"]
DIVISIONS = ["I", "II", "III", "IV"]
STATUSES = ["pending", "in_progress", "success", "failed"]
BRACKET = ["region", "queue", "tier", "division"]

_TYPES = {"long": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    """From "name type, ..." (parsing DDL would need a running session)."""
    pairs = (c.split() for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RUNS = _schema("run_id long, pipeline_name string, started_at timestamp, last_heartbeat timestamp, finished_at timestamp, status string, error_message string")
SNAPSHOT_TASKS = _schema("task_id long, run_id long, file_path string, status string, attempts long, started_at timestamp, finished_at timestamp, error_message string")
DETAIL_TASKS = _schema("task_id long, run_id long, entity_id string, file_path string, status string, attempts long, started_at timestamp, finished_at timestamp, error_message string")
HISTORY = T.ArrayType(_schema("task_id long, path string, logged_at timestamp, patch string"))
RECORDS = T.StructType(
    [
        *_schema("entity_id string, region string, queue string, tier string, division string"),
        T.StructField("history", HISTORY),
        *_schema("latest_logged_at timestamp, detail_task_id long, detail_status string, detail_path string, detail_logged_at timestamp, detail_patch string"),
    ]
)
CURSORS = _schema("region string, queue string, tier string, division string, patch string, page long, loop_count long, last_count long")
LEDGER = {"runs": RUNS, "snapshot_tasks": SNAPSHOT_TASKS, "detail_tasks": DETAIL_TASKS, "records": RECORDS, "cursors": CURSORS}
RUN_EVENTS = _schema("run_id long, ts timestamp, seq long, kind string, status string, error string")
TASK_EVENTS = _schema("task_id long, run_id long, entity_id string, ts timestamp, seq long, status string, file_path string, error string, patch string")

#: Field: (kind, least value or None, required). Names are those of the documents.
SNAPSHOT_FIELDS = {
    "queueType": ("string", None, True), "tier": ("string", None, True), "rank": ("string", None, True), "puuid": ("string", None, True),
    "leaguePoints": ("long", 0, True), "wins": ("long", 0, True), "losses": ("long", 0, True),
    "veteran": ("boolean", None, True), "inactive": ("boolean", None, True), "freshBlood": ("boolean", None, True), "hotStreak": ("boolean", None, True),
}
DETAIL_FIELDS = {
    "puuid": ("string", None, True), "championId": ("long", None, True), "championLevel": ("long", 1, True), "championPoints": ("long", 0, True), "lastPlayTime": ("long", None, True),
    "championPointsSinceLastLevel": ("long", None, True), "championPointsUntilNextLevel": ("long", None, True), "milestoneGrades": ("array", None, False),
}
