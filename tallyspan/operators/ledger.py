"""Ledger state folded from append-only logs: runs, tasks, records with histories, claims, sweeps, page cursors.

Each operator is DataFrame in, DataFrame out. Ties in time are broken by seq, so results don't depend on row order;
folds are aggregations with partial steps on the mappers; the page cursor joins summaries of ranges, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.expressions import latest_of, whole_seconds
from tallyspan.sources.versions import Versions

#: The messages of swept and cleaned-up work.
STALLED = "Run stalled or silent cancelled"
CANCELLED = "Run failed or cancelled"
#: A group of the cursor fold takes so many observations, or ranges of them, as a power of two.
FOLD_BITS = 12
#: Rows of a range in which the last claimed id is looked for.
CLAIM_RANGE = 1_000_000


def _last(value: Column, when: Column | None = None) -> Column:
    """value of the last event, of those where when holds."""
    at = F.struct("ts", "seq")
    return F.max_by(value, at if when is None else F.when(when, at))


def run_state(run_events: DataFrame, task_events: DataFrame | None = None) -> DataFrame:
    """runs from events (run_id, ts, seq, kind: start, heartbeat or finish, status, error); adding a task is a heartbeat too."""
    beats = run_events.select("run_id", "ts", "seq", "kind", "status", "error")
    if task_events is not None:
        added = task_events.where("status = 'pending'").select("run_id", "ts", "seq", F.lit("heartbeat").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"))
        beats = beats.unionByName(added)
    finish = F.col("kind") == "finish"
    return beats.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"), F.max(F.when(~finish, F.col("ts"))).alias("last_heartbeat"), F.max(F.when(finish, F.col("ts"))).alias("finished_at"),
        F.coalesce(_last(F.col("status"), finish), F.lit("running")).alias("status"), _last(F.col("error"), finish).alias("error_message"),
    )


def task_state(task_events: DataFrame, *keep: str) -> DataFrame:
    """tasks from their transitions: attempts counts starts; path, error and finish are those of the last end, if no start came after it."""
    working, ended = F.col("status") == "in_progress", F.col("status").isin("success", "failed")
    return task_events.groupBy("task_id", "run_id", *keep).agg(
        _last(F.col("status")).alias("status"), F.count_if(working).alias("attempts"), F.max(F.when(working, F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"), _last(F.col("file_path"), ended).alias("file_path"), _last(F.col("error"), ended).alias("error_message"),
    )


def mirror_detail_status(records: DataFrame, task_events: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """records with the detail_* columns of their entity's last transition (a start clears the path).

    claims (entity_id, ts, seq, status) touch the status alone.
    """
    group = F.struct(F.when(F.col("status") != "in_progress", F.col("file_path")).alias("path"), "task_id", "ts", "patch")
    steps = task_events.select("entity_id", "ts", "seq", "status", group.alias("group"))
    steps = steps if claims is None else steps.unionByName(claims.select("entity_id", "ts", "seq", "status"), allowMissingColumns=True)
    last = steps.groupBy("entity_id").agg(_last(F.col("group"), F.col("group").isNotNull()).alias("last"), _last(F.col("status")).alias("_status"))
    names = ["detail_task_id", "detail_status", "detail_path", "detail_logged_at", "detail_patch"]
    base = records.drop(*names)
    return (
        base.join(last, "entity_id", "left")
        .select(*base.columns, F.col("last.task_id").alias(names[0]), F.coalesce("_status", F.lit("pending")).alias(names[1]), F.col("last.path").alias(names[2]), F.col("last.ts").alias(names[3]), F.col("last.patch").alias(names[4]))
    )


def upsert_records(sightings: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One record per entity: its history in time order (after the prior one), its last bracket; details untouched.

    sightings: entity_id, task_id, path, logged_at, seq, region, queue, tier, division, patch. Equal sightings count
    as often as they come.
    """
    entry = F.struct("logged_at", "seq", "task_id", "path", "patch")
    bracket = ["region", "queue", "tier", "division"]
    new = sightings.groupBy("entity_id").agg(F.array_sort(F.collect_list(entry)).alias("_new"), F.max_by(F.struct(*bracket), F.struct("logged_at", "seq")).alias("_bracket"))
    tidy = F.transform("_new", lambda e: F.struct(e["task_id"].alias("task_id"), e["path"].alias("path"), e["logged_at"].alias("logged_at"), e["patch"].alias("patch")))
    new = new.select("entity_id", tidy.alias("_new"), "_bracket")
    if prior is None:
        history = F.col("_new")
        rows = new.select("entity_id", *(F.col(f"_bracket.{c}").alias(c) for c in bracket), history.alias("history"))
        return rows.withColumns({"latest_logged_at": latest_of(F.col("history"))["logged_at"], "detail_status": F.lit("pending")})
    rows = prior.join(new, "entity_id", "full_outer")
    changed = {c: F.when(F.col("_bracket").isNotNull(), F.col(f"_bracket.{c}")).otherwise(F.col(c)) for c in bracket}
    none = F.array().cast(prior.schema["history"].dataType)
    changed["history"] = F.concat(F.coalesce("history", none), F.coalesce("_new", none))
    changed["detail_status"] = F.coalesce("detail_status", F.lit("pending"))
    rows = rows.withColumns(changed).drop("_new", "_bracket")
    return rows.withColumn("latest_logged_at", latest_of(F.col("history"))["logged_at"])


def claimable(as_of: Column, stale: bool, sighting_within: Column, detail_older_than: Column) -> Column:
    """The predicate of a claim on records; null where a needed time is unknown. Times, or their ISO texts, count by whole seconds."""
    if not stale:
        return F.col("detail_status").isin("failed", "pending")
    seen = whole_seconds(F.col("latest_logged_at")) > whole_seconds(as_of - sighting_within)
    old = F.col("detail_logged_at").isNull() | (whole_seconds(F.col("detail_logged_at")) < whole_seconds(as_of - detail_older_than))
    return seen & (F.size("history") > 0) & old & (F.col("detail_status") != "in_progress")


def smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys (unique, not null), whatever n: no sort of all of them in one task.

    Rows are counted by ranges of the key; the ranges below the one with the n-th key are taken whole, and only in that
    one, of some CLAIM_RANGE rows, keys are sorted to find the last.
    """
    total = rows.count()
    if n >= total:
        return rows
    if n <= 0:
        return rows.limit(0)
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CLAIM_RANGE))
    dealt = rows.select(key).repartitionByRange(ranges, key).groupBy(F.spark_partition_id().alias("range"))
    counted = dealt.agg(F.count("*").alias("n"), F.max(key).alias("top")).orderBy("range").collect()  # a row per range
    before, below = 0, None
    for r in counted:
        if before + r.n >= n:
            break
        before, below = before + r.n, r.top
    rest = rows.select(key) if below is None else rows.select(key).where(F.col(key) > F.lit(below))
    last = rest.where(F.col(key) <= F.lit(r.top)).orderBy(key).limit(n - before).agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= F.lit(last))


def claim(records: DataFrame, as_of: Column, stale: bool = False, limit: int | None = None, sighting_within: Column | None = None, detail_older_than: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(claimed entity_id, records with those in progress): the first limit eligible entities in id order."""
    day = F.expr("INTERVAL 1 DAY")
    eligible = records.where(claimable(as_of, stale, day if sighting_within is None else sighting_within, 7 * day if detail_older_than is None else detail_older_than)).select("entity_id")
    claimed = eligible if limit is None else smallest(eligible, "entity_id", limit)
    marked = records.join(claimed.withColumn("_claimed", F.lit(True)), "entity_id", "left")
    state = F.when(F.col("_claimed"), F.lit("in_progress")).otherwise(F.col("detail_status"))
    return claimed, marked.withColumn("detail_status", state).drop("_claimed")


def open_claims(log: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Distinct entity_id of claims (entity_id, claimed_at) after which their entity's work has not ended (entity_id, ts)."""
    last = log.groupBy("entity_id").agg(F.max("claimed_at").alias("claimed_at"))
    if ends is None:
        return last.select("entity_id")
    done = ends.groupBy("entity_id").agg(F.max("ts").alias("ts"))
    return last.join(done, "entity_id", "left").where(F.col("ts").isNull() | (F.col("ts") < F.col("claimed_at"))).select("entity_id")


def claim_step(log: Versions, step: int, records: DataFrame, as_of: Column, limit: int | None = None, ends: DataFrame | None = None, **how) -> DataFrame:
    """The entities (entity_id, claimed_at) that a numbered step claims, written to the append-only log before they are given out.

    A step that is in the log already gives the same entities again and claims nothing: it can be replayed. Entities
    of an earlier step are in progress until their work ends, so steps one after the other are disjoint. how: as in
    claim. One writer makes the steps.
    """
    if not log.has(step):
        earlier = log.read(before=step)
        if earlier is not None:
            taken = open_claims(earlier, ends).withColumn("_taken", F.lit(True))
            state = F.when(F.col("_taken"), F.lit("in_progress")).otherwise(F.col("detail_status"))
            records = records.join(taken, "entity_id", "left").withColumn("detail_status", state).drop("_taken")
        claimed, _ = claim(records, as_of, limit=limit, **how)
        log.write(claimed.withColumn("claimed_at", as_of), step)
    return log.read_version(step)


def sweep_stale_runs(runs: DataFrame, as_of: Column, horizon: Column) -> tuple[DataFrame, DataFrame]:
    """(swept run_id, runs with those failed): running, with a heartbeat before as_of - horizon; a null heartbeat is never swept."""
    stale = F.coalesce((F.col("status") == "running") & (whole_seconds(F.col("last_heartbeat")) < whole_seconds(as_of - horizon)), F.lit(False))
    changed = {"status": F.when(stale, "failed").otherwise(F.col("status")), "error_message": F.when(stale, STALLED).otherwise(F.col("error_message")), "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at"))}
    return runs.where(stale).select("run_id"), runs.withColumn("_stale", stale).withColumns({k: v for k, v in changed.items()}).drop("_stale")


def cleanup_runs(run_ids: DataFrame, records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, snapshot_tasks, detail_tasks) after failing a set of runs.

    Records whose only sighting belongs to an unsuccessful task of these runs go; those whose detail task is such a
    one get detail_status failed; the tasks themselves become failed, whatever their message was.
    """
    open_tasks = lambda tasks: tasks.where("status != 'success'").join(run_ids.select("run_id"), "run_id", "left_semi").select("task_id").distinct()
    lost, broken = open_tasks(snapshot_tasks), open_tasks(detail_tasks)
    only = F.when(F.size("history") == 1, F.get("history", F.lit(0))["task_id"])
    left = records.withColumn("_only", only).join(lost.withColumnRenamed("task_id", "_only"), "_only", "left_anti").drop("_only")
    flags = broken.select(F.col("task_id").alias("detail_task_id"), F.lit(True).alias("_broken"))
    left = left.join(flags, "detail_task_id", "left").withColumn("detail_status", F.when(F.col("_broken"), F.lit("failed")).otherwise(F.col("detail_status"))).drop("_broken").select(*records.columns)

    def failed(tasks: DataFrame, ids: DataFrame) -> DataFrame:
        rows = tasks.join(ids.withColumn("_hit", F.lit(True)), "task_id", "left")
        hit = F.coalesce("_hit", F.lit(False))
        return rows.withColumns(
            {"status": F.when(hit, "failed").otherwise(F.col("status")), "finished_at": F.when(hit, as_of).otherwise(F.col("finished_at")), "error_message": F.when(hit, CANCELLED).otherwise(F.col("error_message"))}
        ).select(*tasks.columns)

    return left, failed(snapshot_tasks, lost), failed(detail_tasks, broken)


def sweep(runs: DataFrame, records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame, as_of: Column, horizon: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, records, snapshot_tasks, detail_tasks) after the silent runs are failed and their work is cleaned up.

    Sweeping what is swept changes nothing more: a failed run is not running.
    """
    swept, left = sweep_stale_runs(runs, as_of, horizon)
    return left, *cleanup_runs(swept, records, snapshot_tasks, detail_tasks, as_of)


def failed_task_records(records: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Records whose detail task is an unsuccessful task of the given runs."""
    ids = tasks.where("status != 'success'").join(runs.select("run_id"), "run_id", "left_semi").select(F.col("task_id").alias("detail_task_id"))
    return records.join(ids, "detail_task_id", "left_semi")


def _one_run(a: Column, b: Column) -> Column:
    """The summary of a stretch of observations from those of its two halves, in order.

    first and last are the outer counts, resets the turns back to page 1 inside, head and tail how many observations come
    before the first and from the last of them on (all of them where there is none).
    """
    turned = b["first"] < a["last"]
    head = F.when(a["resets"] > 0, a["head"]).when(turned, a["head"]).otherwise(a["head"] + b["head"])
    tail = F.when(b["resets"] > 0, b["tail"]).when(turned, b["tail"]).otherwise(a["tail"] + b["tail"])
    resets = a["resets"] + b["resets"] + turned.cast("long")
    return F.struct(a["first"].alias("first"), b["last"].alias("last"), resets.alias("resets"), head.alias("head"), tail.alias("tail"))


def cursor_summaries(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, resets, head, tail) of each key's observations (seq, player_count), in the order of seq.

    Joining summaries is associative, so ranges of 2 ** FOLD_BITS seq are summed up side by side, then as many ranges
    at a time, until one summary per key is left: a key that holds all rows is folded in many tasks, and no group has more
    than one range's rows. Rows of a key with the same seq are one range, in the order of their counts; a null count is
    0, a null seq comes first.
    """
    parts = ["first", "last", "resets", "head", "tail"]
    count, one, none = F.coalesce(F.col("player_count").cast("long"), F.lit(0).cast("long")), F.lit(1).cast("long"), F.lit(0).cast("long")
    lowest, highest = observations.agg(F.min("seq"), F.max("seq")).first()
    place = F.coalesce(F.col("seq").cast("long"), F.lit(lowest or 0).cast("long") - 1)
    rows = observations.select(*keys, place.alias("_at"), count.alias("first"), count.alias("last"), none.alias("resets"), one.alias("head"), one.alias("tail"))
    plain = F.transform("_all", lambda s: F.struct(*(s[p].alias(p) for p in parts)))
    folded = F.aggregate(F.slice("_plain", F.lit(2), F.size("_plain")), F.get("_plain", F.lit(0)), _one_run)
    shift, more = 0, True
    while more:
        more = highest is not None and (highest >> shift) - ((lowest - 1) >> shift) > 1 << FOLD_BITS
        shift += FOLD_BITS
        by = [F.shiftright("_at", FOLD_BITS).alias("_at")] if more else []
        rows = rows.groupBy(*keys, *by).agg(F.array_sort(F.collect_list(F.struct("_at", *parts))).alias("_all"))
        rows = rows.withColumn("_plain", plain).withColumn("_s", folded).select(*keys, *(["_at"] if more else []), "_s.*")
    return rows


def cursor_apply(summaries: DataFrame, keys: list[str], initial: DataFrame | None = None) -> DataFrame:
    """(keys, page, loop_count, last_count) after the summed up observations, from page 1, loop 0 or the initial state."""
    number = lambda c, otherwise: F.coalesce(F.col(c) if initial is not None else F.lit(None), F.lit(otherwise)).cast("long")
    if initial is not None:
        summaries = summaries.join(initial.select(*keys, F.col("page").alias("_page"), F.col("loop_count").alias("_loop"), F.col("last_count").alias("_last")), keys, "left")
    turned = F.col("first") < number("_last", 0)
    page = F.when((F.col("resets") == 0) & ~turned, number("_page", 1) + F.col("tail")).otherwise(F.col("tail"))
    return summaries.select(*keys, page.alias("page"), (number("_loop", 0) + F.col("resets") + turned.cast("long")).alias("loop_count"), F.col("last").alias("last_count"))


def cursor_fold(observations: DataFrame, keys: list[str], initial: DataFrame | None = None) -> DataFrame:
    """The page cursor of each key after its observations (seq, player_count), from page 1, loop 0 or the initial state.

    A count below the one before (0 at first) goes back to page 1 and adds a loop; another turns the page.
    """
    return cursor_apply(cursor_summaries(observations, keys), keys, initial)


def cursor_get_or_create(cursors: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, loop_count) of the wanted keys; those without a cursor begin at (1, 0)."""
    return wanted.join(cursors.select(*keys, "page", "loop_count"), keys, "left").withColumns({"page": F.coalesce("page", F.lit(1).cast("long")), "loop_count": F.coalesce("loop_count", F.lit(0).cast("long"))})


def cursor_update(cursors: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page) after the observations; 0 for keys without a cursor."""
    known = observations.join(cursors.select(*keys), keys, "left_semi")
    folded = cursor_fold(known, keys, cursors)
    return observations.select(*keys).distinct().join(folded.select(*keys, "page"), keys, "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))


def novel_entities(snapshots: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (batch_id, entity_id) of snapshot rows not yet recorded under the same keys (bracket and period)."""
    return snapshots.select("batch_id", "entity_id", *keys).distinct().join(records.select("entity_id", *keys), ["entity_id", *keys], "left_anti")


def novelty_counts(snapshots: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch: unique_new and total distinct entities; batches without a new one stay, with 0. The snapshots are read once."""
    known = records.select("entity_id", *keys).distinct().withColumn("_known", F.lit(True))
    seen = snapshots.select("batch_id", "entity_id", *keys).distinct().join(known, ["entity_id", *keys], "left")
    entities = seen.groupBy("batch_id", "entity_id").agg(F.bool_or(F.col("_known").isNull()).alias("_new"))
    named = F.col("entity_id").isNotNull()
    return entities.groupBy("batch_id").agg(F.count_if(named & F.col("_new")).alias("unique_new"), F.count_if(named).alias("total"))


def record_snapshot_batch(snapshots: DataFrame, records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, discarded batches, sightings): a batch without a new entity is dropped, else all its entities are sighted.

    An entity that a batch names twice is sighted once, with its row of the greatest seq where rows have one.
    """
    accepted, discarded = accept_batches(snapshots, novelty_counts(snapshots, records, keys))
    return accepted, discarded, one_sighting(accepted)


def accept_batches(snapshots: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the batches with a new entity, discarded batches) by the batches' novelty counts."""
    return snapshots.join(counts.where("unique_new > 0").select("batch_id"), "batch_id", "left_semi"), counts.where("unique_new = 0")


def one_sighting(rows: DataFrame) -> DataFrame:
    """A row of each batch and entity, that of the greatest seq where rows have one."""
    if "seq" not in rows.columns:
        return rows.dropDuplicates(["batch_id", "entity_id"])
    last = rows.groupBy("batch_id", "entity_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("batch_id", "entity_id"))), "seq").alias("_row"))
    return last.select("batch_id", "entity_id", "_row.*").select(*rows.columns)


def record_detail_batch(details: DataFrame, claims: DataFrame, records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(details to write, end of each claimed entity's task: entity_id, status, error).

    details: entity_id, errors and fields. An entity fails when any of its rows does, when it has none, or when its
    record lacks a bracket value.
    """
    ends = detail_ends(details, claims, records, keys)
    return ended_well(details, ends), ends


def ended_well(details: DataFrame, ends: DataFrame) -> DataFrame:
    """The details of the entities whose tasks succeeded."""
    return details.join(ends.where("status = 'success'").select("entity_id"), "entity_id", "left_semi").drop("errors")


def detail_ends(details: DataFrame, claims: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The ends of record_detail_batch alone."""
    judged = details.groupBy("entity_id").agg(F.bool_and(F.size("errors") == 0).alias("valid"))
    complete = records.select("entity_id", F.forall(F.array(*(F.coalesce(F.col(k), F.lit("")) != "" for k in keys)), lambda x: x).alias("complete"))
    ends = claims.join(judged, "entity_id", "left").join(complete, "entity_id", "left")
    # fixed values: the messages of failed detail tasks
    error = F.when(F.col("valid").isNull(), F.lit("Failed to fetch detail data.")).when(~F.col("valid"), F.lit("Invalid detail data.")).when(~F.coalesce("complete", F.lit(False)), F.lit("Failed to save mastery data."))
    return ends.select("entity_id", error.alias("error")).withColumn("status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failed")))
