"""Histories in chunks: what an entity was sighted in one span of time is one row, so no row holds a whole history.

A chunk has its length and its first and last entry beside the entries, so that lengths, first and latest sightings are
read without them. Chunks of the same entity and span are merged; others are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.expressions import is_blank, not_null

#: Seconds of a chunk. An entity is sighted by its page's fetches, so a day holds few of its sightings.
SPAN = 86_400
ENTRY = ["logged_at", "seq", "task_id", "path", "patch"]
BRACKET = ["region", "queue", "tier", "division"]


def chunk_of(ts: Column, span: int = SPAN) -> Column:
    """The number of the span that holds a time; a null time is in span 0."""
    return F.coalesce(F.floor(F.unix_seconds(ts.cast("timestamp")) / span), F.lit(0).cast("long"))


def _closed(rows: DataFrame) -> DataFrame:
    """Adds n, first and last to chunks with their entries in order."""
    return rows.withColumns({"n": F.size("entries").cast("long"), "first": F.get("entries", F.lit(0)), "last": F.element_at("entries", -1)})


def history_chunks(sightings: DataFrame, span: int = SPAN) -> DataFrame:
    """(entity_id, chunk, entries, bracket, n, first, last) of sightings; entries in the order of logged_at and seq.

    bracket is that of the chunk's last entry. Equal sightings count as often as they come.
    """
    rows = sightings.select("entity_id", chunk_of(F.col("logged_at"), span).alias("chunk"), F.struct(*ENTRY).alias("entry"), F.struct(*BRACKET).alias("bracket"))
    order = F.struct("entry.logged_at", "entry.seq")
    return _closed(rows.groupBy("entity_id", "chunk").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.max_by("bracket", order).alias("bracket")))


def merge_chunks(prior: DataFrame, new: DataFrame) -> DataFrame:
    """prior with the entries of new in their places; chunks that only one of the two has pass through."""
    fresh = new.select("entity_id", "chunk", *(F.col(c).alias(f"_{c}") for c in ("entries", "bracket", "last")))
    both = prior.select("entity_id", "chunk", "entries", "bracket", "last").join(fresh, ["entity_id", "chunk"], "full_outer")
    none = F.array().cast(prior.schema["entries"].dataType)
    order = lambda c: F.struct(f"{c}.logged_at", f"{c}.seq")
    newer = F.col("last").isNull() | (F.col("_last").isNotNull() & (order("_last") >= order("last")))
    entries = F.array_sort(F.concat(F.coalesce("entries", none), F.coalesce("_entries", none)))
    return _closed(both.select("entity_id", "chunk", entries.alias("entries"), F.when(newer, F.col("_bracket")).otherwise(F.col("bracket")).alias("bracket")))


def history_totals(chunks: DataFrame) -> DataFrame:
    """Per entity: n_history, first_task_id, latest_task_id, latest_path, latest_patch, latest_logged_at and its last bracket, from the chunks' summaries alone."""
    last = F.max_by(F.struct("last", "bracket"), F.struct("last.logged_at", "last.seq")).alias("l")
    first = F.min_by("first.task_id", F.struct("first.logged_at", "first.seq")).alias("first_task_id")
    rows = chunks.groupBy("entity_id").agg(F.sum("n").alias("n_history"), first, last)
    latest = [F.col(f"l.last.{c}").alias(f"latest_{c}") for c in ("task_id", "path", "patch", "logged_at")]
    return rows.select("entity_id", "n_history", "first_task_id", *latest, *(F.col(f"l.bracket.{c}").alias(c) for c in BRACKET))


def history_length_stats(totals: DataFrame) -> DataFrame:
    """(growth_percent, repeated) as of the integrity report, from history_totals."""
    sizes = totals.where("n_history > 0").agg(F.avg("n_history").alias("mean"), F.count_if(F.col("n_history") > 1).alias("repeated"))
    return sizes.select((F.coalesce("mean", F.lit(0.0)) * 100 - 100).alias("growth_percent"), "repeated")


def history_task_issues(chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(entity_id, chunk, history_issues): per chunk, in order, an issue per task that is known and unsuccessful."""
    places = chunks.select("entity_id", "chunk", F.posexplode(F.transform("entries", lambda e: e["task_id"])).alias("pos", "task_id"))
    bad = places.join(tasks.where("status != 'success'").select("task_id"), "task_id")
    issue = F.struct("pos", F.format_string("player_task_%d_not_success", "task_id").alias("text"))
    return bad.groupBy("entity_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(issue)), lambda x: x["text"]).alias("history_issues"))


def ledger_issues(records: DataFrame, chunks: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame) -> DataFrame:
    """(entity_id, chunk, issues) of records (entity_id, bracket, detail_task_id, detail_status) and their chunked histories.

    What concerns the record is in its row without a chunk, what concerns its history in a row per chunk; the texts are
    those of the integrity report. A record without any chunk has neither paths nor tasks.
    """
    lengths = chunks.groupBy("entity_id").agg(F.sum("n").alias("_n"))
    state = detail_tasks.select(F.col("task_id").alias("detail_task_id"), F.col("status").alias("_task"))
    own = records.join(lengths, "entity_id", "left").join(state, "detail_task_id", "left")
    when = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    status = F.coalesce("detail_status", F.lit("None"))
    blank = F.greatest(*(is_blank(F.col(c)) for c in BRACKET))
    detail = when(F.coalesce("detail_task_id", F.lit(0)) == 0, "no_mastery_task_id").when(F.col("_task") != "success", F.format_string("mastery_task_%d_not_success", "detail_task_id"))
    found = F.array(
        when(status != "success", F.concat(F.lit("mastery_status: "), status)), when(F.col("_n").isNull(), "no_paths"), when(F.col("_n") == 0, "empty_paths"),
        when(F.col("_n").isNull(), "no_player_task_ids"), when(F.col("_n") == 0, "empty_player_task_ids"), detail, when(blank, "missing_rank_info"),
    )
    heads = own.select("entity_id", F.lit(None).cast("long").alias("chunk"), not_null(found).alias("issues")).where("size(issues) > 0")
    known = chunks.join(records.select("entity_id"), "entity_id", "left_semi")
    return heads.unionByName(history_task_issues(known, snapshot_tasks).withColumnRenamed("history_issues", "issues"))
