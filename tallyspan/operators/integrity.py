"""Integrity reports over files and ledger: orphans, duplicates, faulty records, error rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.expressions import is_blank, not_null, ratio


def is_broken(list_field: str) -> Column:
    """Whether doc is an object whose list is missing, empty or no list; null or false for what is no object."""
    shape = F.schema_of_variant(F.try_variant_get("doc", f"$.{list_field}", "variant"))
    size = F.size(F.try_variant_get("doc", f"$.{list_field}", "array<variant>"))
    return F.schema_of_variant("doc").startswith("OBJECT") & (~F.coalesce(shape, F.lit("")).startswith("ARRAY") | (F.coalesce(size, F.lit(0)) == 0))


def broken_documents(docs: DataFrame, list_field: str) -> DataFrame:
    """Object documents whose list is missing, empty or no list; what is no object is passed over."""
    return docs.where(is_broken(list_field))


def leading_objects(list_field: str) -> Column:
    """The entries of doc's list up to the first that is no object, as variants; null where doc is no object."""
    entries = F.try_variant_get("doc", f"$.{list_field}", "array<variant>")
    shapes = F.transform(entries, lambda e: ~F.schema_of_variant(e).startswith("OBJECT"))
    first_bad = F.array_position(shapes, True)
    whole = F.when(first_bad > 0, F.slice(entries, F.lit(1), (first_bad - 1).cast("int"))).otherwise(entries)
    return F.when(F.schema_of_variant("doc").startswith("OBJECT"), whole)


def snapshot_entries(docs: DataFrame, list_field: str, id_field: str) -> DataFrame:
    """(path, entity_id) of list entries up to a document's first entry that is no object; entries without an id are left out."""
    rows = docs.select("path", F.explode(leading_objects(list_field)).alias("e"))
    return rows.select("path", F.try_variant_get("e", f"$.{id_field}", "string").alias("entity_id")).where(~is_blank(F.col("entity_id")))


def first_entity(list_field: str, id_field: str) -> Column:
    """The entity of a detail document: that of its first element."""
    first = F.try_element_at(F.try_variant_get("doc", f"$.{list_field}", "array<variant>"), F.lit(1))
    return F.try_variant_get(first, f"$.{id_field}", "string")


def first_entities(docs: DataFrame, list_field: str, id_field: str) -> DataFrame:
    """(path, entity_id): the entity of a detail document is that of its first element."""
    return docs.select("path", first_entity(list_field, id_field).alias("entity_id")).where(~is_blank(F.col("entity_id")))


def first_detail_entity(docs: DataFrame, list_field: str, id_field: str) -> DataFrame:
    """(entity_id, path, files) of the entities of detail documents; one path of each is kept."""
    return first_entities(docs, list_field, id_field).groupBy("entity_id").agg(F.max("path").alias("path"), F.count("*").alias("files"))


def appearances(entries: DataFrame) -> DataFrame:
    """(entity_id, n, paths): how often an entity occurs in the snapshots, the same file as often as it holds it."""
    return entries.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def distinct_paths(rows: DataFrame, *by: str) -> DataFrame:
    """The different file paths that rows name, of each group; rows without a path name none."""
    return rows.where(~is_blank(F.col("path"))).select(*by, "path").distinct()


def duplicate_entities(entries: DataFrame) -> DataFrame:
    return appearances(entries).where("n > 1")


def entities_without_details(entities: DataFrame, details: DataFrame) -> DataFrame:
    return entities.join(details.select("entity_id"), "entity_id", "left_anti")


def details_without_entities(details: DataFrame, entities: DataFrame) -> DataFrame:
    return details.join(entities.select("entity_id"), "entity_id", "left_anti")


def file_summary(entries: DataFrame, details: DataFrame, n_broken: DataFrame) -> DataFrame:
    """One row of rates from entries (entity_id, path), details (entity_id, path, files) and n_broken (broken).

    An error rate without anything evaluated is 1; the other rates are 0 without a base.
    """
    seen = entries.groupBy("entity_id").agg(F.count("*").alias("n"))
    both = seen.join(details.select("entity_id", "files"), "entity_id", "full_outer")
    totals = both.agg(
        F.count("n").alias("entities"), F.count("files").alias("detail_entities"), F.count_if(F.col("files").isNull()).alias("missing_details"), F.count_if(F.col("n").isNull()).alias("missing_entities"),
        F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("files") > 1).alias("duplicated_details"), F.avg("n").alias("mean_appearances"),
    )
    errors = F.col("missing_details") + F.col("missing_entities") + F.col("broken")
    evaluated = F.col("entities") + F.col("detail_entities")
    return totals.crossJoin(n_broken).select(  # two single rows
        evaluated.alias("total_evaluated"), "entities", "detail_entities", "missing_details", "missing_entities", "broken", errors.alias("total_errors"), ratio(errors, evaluated, 1.0).alias("error_rate"),
        F.coalesce(F.round("mean_appearances", 3), F.lit(0.0)).alias("mean_appearances"), ratio(F.col("duplicated"), F.col("entities")).alias("duplicate_rate"), ratio(F.col("duplicated_details"), F.col("detail_entities")).alias("duplicate_detail_rate"),
    )


def file_parts(entries: DataFrame, details: DataFrame, faulty: DataFrame) -> dict[str, DataFrame]:
    """summary, duplicated (entity_id, n) with a row per path in duplicated_paths, missing_details, missing_entities and faulty files.

    From entries (path, entity_id), details (entity_id, path, files) and faulty (path, kind). No row holds all paths of
    an entity.
    """
    seen = entries.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    more = seen.where("n > 1").select("entity_id", "n")
    return {
        "summary": file_summary(entries, details, faulty.agg(F.count("*").alias("broken"))),
        "duplicated": more,
        "duplicated_paths": entries.join(more.select("entity_id"), "entity_id", "left_semi").select("entity_id", "path"),
        "missing_details": entities_without_details(seen.select("entity_id", "path"), details),
        "missing_entities": details_without_entities(details.select("entity_id", "path"), seen),
        "faulty": faulty,
    }


def file_integrity(snapshot_docs: DataFrame, detail_docs: DataFrame, snapshot_list: str = "players", detail_list: str = "masteries", id_field: str = "puuid") -> dict[str, DataFrame]:
    """The parts of file_parts for two sets of documents (path, doc)."""
    broken = lambda docs, field, kind: broken_documents(docs, field).select("path", F.lit(kind).alias("kind"))
    faulty = broken(snapshot_docs, snapshot_list, "snapshot").unionByName(broken(detail_docs, detail_list, "detail"))
    return file_parts(snapshot_entries(snapshot_docs, snapshot_list, id_field), first_detail_entity(detail_docs, detail_list, id_field), faulty)


def task_error_rate(tasks: DataFrame, kind: str) -> DataFrame:
    """(kind, total, failed, discarded, error_rate): a task without a file path is discarded, whatever its status."""
    counts = tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(is_blank(F.col("file_path"))).alias("discarded"))
    return counts.select(F.lit(kind).alias("kind"), "total", "failed", "discarded", ratio(F.col("failed"), F.col("total")).alias("error_rate"))


def errors_by_message(tasks: DataFrame) -> DataFrame:
    """Failed tasks by message; a null message is a group."""
    return tasks.where("status = 'failed'").groupBy("error_message").agg(F.count("*").alias("n"))


def history_length_stats(records: DataFrame) -> DataFrame:
    """(growth_percent, repeated): mean history length in percent above 1, over records with a history; -100 if there is none."""
    sizes = records.where(F.size("history") > 0).agg(F.avg(F.size("history")).alias("mean"), F.count_if(F.size("history") > 1).alias("repeated"))
    return sizes.select((F.coalesce("mean", F.lit(0.0)) * 100 - 100).alias("growth_percent"), "repeated")


def history_task_issues(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(entity_id, history_issues): in history order, an issue per task that is known and unsuccessful."""
    places = records.select("entity_id", F.posexplode("history").alias("pos", "h")).select("entity_id", "pos", F.col("h.task_id").alias("task_id"))
    bad = places.join(tasks.where("status != 'success'").select("task_id"), "task_id")
    issue = F.struct("pos", F.format_string("player_task_%d_not_success", "task_id").alias("text"))
    return bad.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(issue)), lambda x: x["text"]).alias("history_issues"))


def detail_task_issues(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(entity_id, detail_issue): no detail task, or one that is known and unsuccessful."""
    return _with_detail_issue(records.select("entity_id", "detail_task_id"), tasks).select("entity_id", "detail_issue")


def _with_detail_issue(records: DataFrame, tasks: DataFrame) -> DataFrame:
    state = tasks.select(F.col("task_id").alias("detail_task_id"), F.col("status").alias("_task"))
    issue = F.when(F.coalesce("detail_task_id", F.lit(0)) == 0, F.lit("no_mastery_task_id")).when(F.col("_task") != "success", F.format_string("mastery_task_%d_not_success", "detail_task_id"))
    return records.join(state, "detail_task_id", "left").withColumn("detail_issue", issue).drop("_task")


def ledger_issues(records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame) -> DataFrame:
    """(entity_id, issues) of the records that have any, in a fixed order; the texts are fixed values.

    A history holds paths and task ids in one array, so both are missing or empty together.
    """
    own = _with_detail_issue(records.join(history_task_issues(records, snapshot_tasks), "entity_id", "left"), detail_tasks)
    when = lambda test, text: F.when(test, F.lit(text))
    status = F.when(F.coalesce("detail_status", F.lit("None")) != "success", F.concat(F.lit("mastery_status: "), F.coalesce("detail_status", F.lit("None"))))
    history = F.col("history")
    missing = reduce(lambda a, b: a | b, (is_blank(F.col(c)) for c in ("region", "queue", "tier", "division")))
    head = F.array(status, when(history.isNull(), "no_paths"), when(F.size(history) == 0, "empty_paths"), when(history.isNull(), "no_player_task_ids"), when(F.size(history) == 0, "empty_player_task_ids"))
    none = F.array().cast("array<string>")
    issues = F.concat(not_null(head), F.coalesce("history_issues", none), not_null(F.array(F.col("detail_issue"), when(missing, "missing_rank_info"))))
    return own.select("entity_id", issues.alias("issues")).where("size(issues) > 0")


def ledger_summary(records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame) -> DataFrame:
    """One row per task table with its totals and rates, and the records' totals beside them."""
    rates = task_error_rate(snapshot_tasks, "snapshot").unionByName(task_error_rate(detail_tasks, "detail"))
    faulty = ledger_issues(records, snapshot_tasks, detail_tasks).agg(F.count("*").alias("faulty_records"))
    return rates.crossJoin(records.agg(F.count("*").alias("records"))).crossJoin(faulty).crossJoin(history_length_stats(records))  # single rows


def ledger_integrity(records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame) -> dict[str, DataFrame]:
    messages = errors_by_message(snapshot_tasks).withColumn("kind", F.lit("snapshot")).unionByName(errors_by_message(detail_tasks).withColumn("kind", F.lit("detail")))
    return {"summary": ledger_summary(records, snapshot_tasks, detail_tasks), "issues": ledger_issues(records, snapshot_tasks, detail_tasks), "errors": messages}


def integrity_check(records: DataFrame, snapshot_tasks: DataFrame, detail_tasks: DataFrame, snapshot_docs: DataFrame | None = None, detail_docs: DataFrame | None = None, full: bool = False) -> dict[str, DataFrame]:
    """The ledger's report, and with full also that of the files."""
    found = {f"ledger_{k}": v for k, v in ledger_integrity(records, snapshot_tasks, detail_tasks).items()}
    return found | ({f"files_{k}": v for k, v in file_integrity(snapshot_docs, detail_docs).items()} if full else {})


def referential_audit(foreign: list[tuple[str, DataFrame, str, DataFrame, str]], unique: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(constraint, key, n): foreign keys (name, table, column, parent, its column) without a parent, and unique columns' repeated values."""

    def rows(name: str, keys: DataFrame) -> DataFrame:
        return keys.select(F.lit(name).alias("constraint"), F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n"))

    found = []
    for name, child, column, parent, parent_column in foreign:
        keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
        found.append(rows(name, keys.join(parent.select(F.col(parent_column).alias("key")), "key", "left_anti")))
    for name, owner, column in unique:
        found.append(rows(name, owner.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).where("n > 1")))
    return reduce(DataFrame.unionByName, found)


