"""An audit of files that parses each file once: what it found is kept per file, and new files are added to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions.expressions import is_blank
from tallyspan.operators import integrity
from tallyspan.sources import documents
from tallyspan.sources.versions import Versions


def file_rows(docs: DataFrame, kind: str, list_field: str, id_field: str) -> DataFrame:
    """(kind, path, modified, faulty, entity_id) of documents (path, modified, doc): a row per file, and one per entity it names.

    Snapshots name the entities of their entries, details that of their first one. A document is parsed once and gives
    its rows side by side: no join by path.
    """
    if kind == "snapshot":
        ids = F.transform(integrity.leading_objects(list_field), lambda e: F.try_variant_get(e, f"$.{id_field}", "string"))
    else:
        ids = F.array(integrity.first_entity(list_field, id_field))
    read = docs.select("path", "modified", F.coalesce(integrity.is_broken(list_field), F.lit(False)).alias("faulty"), F.filter(ids, lambda i: ~is_blank(i)).alias("ids"))
    own = F.array(F.struct("faulty", F.lit(None).cast("string").alias("entity_id")))
    named = F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.struct(F.lit(False).alias("faulty"), i.alias("entity_id")))
    return read.select("path", "modified", F.explode(F.concat(own, named)).alias("r")).select(F.lit(kind).alias("kind"), "path", "modified", "r.faulty", "r.entity_id")


def new_documents(spark: SparkSession, root: str, seen: DataFrame | None, packed: bool = False) -> DataFrame:
    """The documents below root that seen (path, modified) does not hold; files older than all of it are not opened."""
    # files of the last second seen may still come: they are read again, and told apart by path and time
    last = None if seen is None else seen.agg(F.date_format(F.max("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    docs = (documents.scan_packed if packed else documents.scan_documents)(spark, root, last)
    return docs if last is None else docs.join(seen.select("path", "modified").distinct(), ["path", "modified"], "left_anti")


def audit(spark: SparkSession, log: Versions, step: int, snapshot_root: str, detail_root: str, snapshot_list: str = "players", detail_list: str = "masteries", id_field: str = "puuid", packed: bool = False) -> DataFrame:
    """Adds the files that came since the last step to the log and gives the log's rows, those of each file's last state.

    A step that is in the log already is not done again. A file that was changed counts as it is now.
    packed: both roots hold packed documents (see documents.pack_documents), each a file here, however many share one.
    """
    if not log.has(step):
        seen = log.read(before=step)
        kinds = (("snapshot", snapshot_root, snapshot_list), ("detail", detail_root, detail_list))
        snapshots, details = (file_rows(new_documents(spark, root, None if seen is None else seen.where(F.col("kind") == kind), packed), kind, field, id_field) for kind, root, field in kinds)
        log.write(snapshots.unionByName(details), step)
    rows = log.read(before=step + 1)
    last = rows.groupBy("kind", "path").agg(F.max("modified").alias("modified"))
    return rows.join(last, ["kind", "path", "modified"], "left_semi")


def report(rows: DataFrame) -> dict[str, DataFrame]:
    """The parts of integrity.file_integrity, from an audit's rows."""
    entries = rows.where("kind = 'snapshot' and entity_id is not null").select("path", "entity_id")
    named = rows.where("kind = 'detail' and entity_id is not null").groupBy("entity_id").agg(F.max("path").alias("path"), F.count("*").alias("files"))
    return integrity.file_parts(entries, named, rows.where("faulty").select("path", "kind"))
