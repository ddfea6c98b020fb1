"""Questions to the ledger: status and place of entities, brackets and their load, the next bracket to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.functions.expressions import iso_to_ts, whole_seconds
from tallyspan.operators.validation import optional_filters, ordinal
from tallyspan.sources.schemas import DIVISIONS, TIERS


def detail_status(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, status) of each asked entity; the text "None" for an unknown one."""
    return ids.select("entity_id").join(records.select("entity_id", "detail_status"), "entity_id", "left").select("entity_id", F.coalesce("detail_status", F.lit("None")).alias("status"))


def entity_info(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Bracket and latest sighting of each asked entity; nulls for an unknown one. A time kept as ISO text comes out as a time."""
    known = records.select("entity_id", "region", "queue", "tier", "division", "latest_logged_at")
    if known.schema["latest_logged_at"].dataType.typeName() == "string":
        known = known.withColumn("latest_logged_at", iso_to_ts(F.col("latest_logged_at")))
    return ids.select("entity_id").join(known, "entity_id", "left")


def entities_in_timespan(records: DataFrame, as_of: Column, days: int, **equals: str | None) -> DataFrame:
    """Entities last seen strictly later than so many days before as_of."""
    return optional_filters(records, **equals).where(whole_seconds(F.col("latest_logged_at")) > whole_seconds(as_of - F.make_dt_interval(F.lit(days)))).select("entity_id")


def entities_in_period(records: DataFrame, period: str, **equals: str | None) -> DataFrame:
    """Entities whose details were last tried in a period."""
    return optional_filters(records, **equals).where(F.col("detail_patch") == period).select("entity_id")


def task_for_entity(tasks: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, task_id): of the candidate tasks, the smallest of each asked entity; -1 if there is none."""
    own = tasks.join(candidates.select("task_id"), "task_id", "left_semi").groupBy("entity_id").agg(F.min("task_id").alias("task_id"))
    return entities.select("entity_id").join(own, "entity_id", "left").select("entity_id", F.coalesce("task_id", F.lit(-1).cast("long")).alias("task_id"))


def bracket_grid(spark, tiers: list[str], divisions: list[str]) -> DataFrame:
    """All pairs of the two short lists."""
    rows = [(t, d) for t in tiers for d in divisions]
    return spark.createDataFrame(rows, "tier string, division string")


def bracket_stats(records: DataFrame, cursors: DataFrame, region: str, queue: str, period: str, tiers: list[str], divisions: list[str]) -> DataFrame:
    """(tier, division, loop_count, entity_count) of every asked bracket, 0 where nothing is known."""
    here = lambda df: df.where((F.col("region") == region) & (F.col("queue") == queue))
    loops = here(cursors).where(F.col("patch") == period).select("tier", "division", "loop_count")
    counts = here(records).where(F.col("detail_patch") == period).groupBy("tier", "division").agg(F.count("*").alias("entity_count"))
    grid = bracket_grid(records.sparkSession, tiers, divisions)
    zero = F.lit(0).cast("long")
    return grid.join(loops, ["tier", "division"], "left").join(counts, ["tier", "division"], "left").select("tier", "division", F.coalesce("loop_count", zero).alias("loop_count"), F.coalesce("entity_count", zero).alias("entity_count"))


def next_bracket(stats: DataFrame, tier: str | None = None, division: str | None = None, by: list[str] | None = None, tiers: list[str] = TIERS, divisions: list[str] = DIVISIONS) -> DataFrame:
    """The bracket with the fewest loops, then the fewest entities, then first in the order of tier and division.

    With by, the first of each group.
    """
    rows = optional_filters(stats, tier=tier, division=division)
    order = [F.col("loop_count"), F.col("entity_count"), ordinal("tier", tiers), ordinal("division", divisions)]
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
