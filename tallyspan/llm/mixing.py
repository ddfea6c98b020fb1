"""Mixing sources to target weights by Pfair scheduling with earliest deadline first.

The rows of each source are dealt into blocks. In virtual time v a source of weight w has had its share of w v blocks,
until it has none left; T(v), the blocks all sources have had by then, is the slot that v falls on. Block k of a source
may not come before slot floor(T(k / w)) and must come before slot ceil(T((k + 1) / w)). Giving each slot to the
released block with the earliest deadline keeps every source less than one block away from its share at every slot,
also where sources end and the others go on with their weights.

At whole v every share is a whole number of blocks, so each unit of virtual time (a period) is scheduled by itself. All
periods between two that see a source end have one schedule: a run is such periods and the one that ends them. Sources,
runs, schedules and blocks are tables: nothing of them is held on the driver, and a schedule has at most as many rows as
there are blocks. A task holds one period, whose slots are at most the sum of the weights; the runs, at most one a
source, are numbered by one task, as a stream.

A row's place among its source's rows is its rank in hash order: counts by (source, bucket) give each bucket's
first rank, and ranks inside a bucket (some BUCKET_ROWS rows, whatever the source's size) are numbered by a window.
The first ranks are prefix sums in two steps, of STRIDE buckets and of the strides. Slots come to the rows by their
buckets.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import all_columns, table, written

BLOCK_ROWS = 16
BUCKET_ROWS, STRIDE = 500, 1000
#: Periods of a run that one task writes out for a block of the schedule.
SPAN = 4096
#: Sum of the default weights (each is at least 1), and their exponent.
TOTAL, EXPONENT = 1000, 0.7


def period(weights: list[int], blocks: list[int] | None = None) -> list[tuple[int, int]]:
    """(source, block) of each slot of one period: earliest deadline first among the released blocks.

    blocks: those that each source has left in the period, by default its weight; one with fewer ends in it.
    """
    blocks = weights if blocks is None else blocks
    ends = sorted((Fraction(m, w), m, w) for m, w in zip(blocks, weights) if m < w)
    at, had, live = [e for e, _, _ in ends], [0], [sum(weights)]
    for _, m, w in ends:
        had.append(had[-1] + m)
        live.append(live[-1] - w)

    def slots_by(n: int, k: int) -> tuple[int, int]:
        """T(k / weight) rounded down and up."""
        ended = bisect_left(at, Fraction(k, weights[n])) if at else 0
        return had[ended] + live[ended] * k // weights[n], had[ended] - (-live[ended] * k // weights[n])

    waiting = [(0, n, 0) for n, m in enumerate(blocks) if m]  # (release, source, block)
    released: list[tuple[int, int, int]] = []  # (deadline, source, block)
    out: list[tuple[int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, n, k = heapq.heappop(waiting)
            heapq.heappush(released, (slots_by(n, k + 1)[1], n, k))
        deadline, n, k = heapq.heappop(released)
        assert slot < deadline, "a feasible set of blocks misses no deadline"
        out.append((n, k))
        if k + 1 < blocks[n]:
            heapq.heappush(waiting, (slots_by(n, k + 1)[0], n, k + 1))
    return out


def _sources(rows: DataFrame, weights: dict | None, block_rows: int) -> DataFrame:
    """Rows (source, rows, weight, blocks, last): last is the period that a source's last block is in; written."""
    spark = rows.sparkSession
    sized = written(rows.groupBy("source").agg(F.count("*").alias("rows")), "mix-sizes")
    if weights is None:
        power = F.pow(F.col("rows").cast("double"), F.lit(EXPONENT))
        total = sized.agg(F.sum(power)).first()[0] or 1.0
        weighted = sized.withColumn("weight", F.greatest(F.lit(1), F.rint(TOTAL * power / total)).cast("long"))
    else:
        kind = rows.schema["source"].dataType.simpleString()
        given = spark.createDataFrame([((s,), w) for s, w in weights.items()], f"source {kind}, weight long")
        weighted = sized.join(given, "source", "left")
        if missing := weighted.where("weight is null or weight < 1").select("source.source").limit(5).collect():
            raise ValueError(f"sources without a positive weight: {[r.source for r in missing]}")
    blocks = F.expr(f"(rows + {block_rows - 1}) div {block_rows}")
    return written(weighted.withColumn("blocks", blocks).withColumn("last", F.expr("(blocks - 1) div weight")), "mix-sources")


def _runs(sources: DataFrame, block_rows: int) -> DataFrame:
    """Rows (run, last, free, live, start, gone, missing), one for each period that sees a source end; written.

    The run is free whole periods of live slots each, from slot start, and then period last. By start, gone sources
    have ended, and their last blocks were missing so many rows.
    """
    ends = sources.groupBy("last").agg(
        F.sum("weight").alias("weight"), F.sum(F.expr("blocks - last * weight")).alias("part"), F.count("*").alias("ended"), F.sum(F.expr(f"blocks * {block_rows} - rows")).alias("lack")
    )
    order = Window.orderBy("last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("live", F.sum("weight").over(Window.orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("free", F.col("last") - F.lag("last", 1, -1).over(order) - 1)
    sums = {"start": F.expr("free * live + live - weight + part"), "gone": F.col("ended"), "missing": F.col("lack")}
    runs = ends.withColumns(sums).withColumn("run", F.row_number().over(order).cast("long") - 1)
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(c) for c in sums]
    return written(runs.select("run", "last", "free", "live", *earlier), "mix-runs")


def _scheduled(group: pa.Table) -> pa.Table:
    """Rows (run, whole, name, weight, left, lack) of one period: its slots, and what ended in it before each."""
    columns = group.to_pydict()
    order = sorted(range(group.num_rows), key=lambda n: (columns["name"][n] is not None, columns["name"][n]))
    weight, left, lack, ends = ([columns[c][n] for n in order] for c in ("weight", "left", "lack", "ends"))
    slots = period(weight, left)
    lacking, gone, missed, ended = [], [], 0, 0
    for n, k in slots:
        lacking.append(missed)
        gone.append(ended)
        if ends[n] and k + 1 == left[n]:
            missed, ended = missed + lack[n], ended + 1
    rows = pa.array([order[n] for n, _ in slots], pa.int64())
    named = group.select(["run", "whole", "name", "weight"]).take(rows)
    for name, values in (("k", [k for _, k in slots]), ("place", range(len(slots))), ("lacking", lacking), ("ended", gone)):
        named = named.append_column(name, pa.array(values, pa.int64()))
    return named


def _blocks(sources: DataFrame, runs: DataFrame, block_rows: int) -> DataFrame:
    """Rows (source, block, weight, phase, slot, first), one a block: first is the position of its first row."""
    numbered = sources.join(runs.select("run", "last"), "last").select("source", "weight", "rows", "blocks", "last", F.col("run").alias("own"))
    shared = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), "own"))).join(runs.select("run", "free"), "run")
    # a run's whole periods, where it has any, and its last one
    shared = shared.withColumn("whole", F.explode(F.when(F.col("free") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    shared = shared.withColumn("ends", (F.col("run") == F.col("own")) & ~F.col("whole"))
    left = F.when(F.col("ends"), F.expr("blocks - last * weight")).otherwise(F.col("weight"))
    shared = shared.select("run", "whole", F.col("source.source").alias("name"), "weight", left.alias("left"), "ends", F.expr(f"blocks * {block_rows} - rows").alias("lack"))
    kind = shared.schema["name"].dataType.simpleString()
    slots = shared.groupBy("run", "whole").applyInArrow(_scheduled, f"run long, whole boolean, name {kind}, weight long, k long, place long, lacking long, ended long")
    slots = written(slots, "mix-slots").join(runs, "run").withColumn("times", F.when(F.col("whole"), F.col("free")).otherwise(F.lit(1)))
    # a run of any length in parts of SPAN periods
    parts = slots.withColumn("from", F.explode(F.expr(f"sequence(0L, times - 1, {SPAN}L)"))).repartition("run", "whole", "name", "k", "from")
    each = parts.withColumn("turn", F.explode(F.expr(f"sequence(`from`, least(`from` + {SPAN}L, times) - 1)")))
    turn = F.when(F.col("whole"), F.col("turn")).otherwise(F.col("free"))
    each = each.withColumn("turn", turn).withColumn("slot", F.expr("start + turn * live + place"))
    first = F.col("slot") * block_rows - F.col("missing") - F.col("lacking")
    return each.select(F.struct(F.col("name").alias("source")).alias("source"), F.expr("(last - free + turn) * weight + k").alias("block"), "weight", (F.col("gone") + F.col("ended")).alias("phase"), "slot", first.alias("first"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, weight, block, phase, slot, position. Every row is placed once.
    With carry, also row: a struct of all columns of docs.

    weights: positive integers by source (null is a source of its own); by default in proportion to the row counts to
    the power EXPONENT, so that large sources get less than their share and small ones more. There may be any number
    of sources. slot is the block's place in the mix and (slot, place in the block) gives position, from 0; phase is the
    number of sources that had their last block before. Rows that repeat an id are rows of their own; which of them comes first
    is not defined, as they cannot be told apart. Other columns are not read. An empty table gives no rows.
    """
    more = ["row"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.col(source_col).alias("source")).alias("source"), *([all_columns(docs).alias("row")] if carry else []))
    sources = _sources(rows, weights, block_rows)
    blocks = _blocks(sources, _runs(sources, block_rows), block_rows)

    order = F.xxhash64("doc_id")
    buckets = sources.select("source", F.expr(f"(rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}").alias("buckets"))
    keyed = rows.join(buckets, "source").withColumn("bucket", F.pmod(order, "buckets")).drop("buckets")
    strides = keyed.groupBy("source", "bucket").count().withColumn("stride", F.expr(f"bucket div {STRIDE}"))
    earlier = lambda *by: F.coalesce(F.sum("count").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = strides.groupBy("source", "stride").agg(F.sum("count").alias("count")).select("source", "stride", earlier("source", "stride").alias("before"))
    offsets = strides.withColumn("inside", earlier("source", "stride", "bucket")).join(before, ["source", "stride"])
    offsets = offsets.select("source", "bucket", "count", (F.col("before") + F.col("inside")).alias("offset"))
    # the blocks that a bucket's ranks fall in: some BUCKET_ROWS / block_rows
    spans = offsets.withColumn("block", F.explode(F.expr(f"sequence(offset div {block_rows}, (offset + count - 1) div {block_rows})")))
    taken = spans.join(blocks, ["source", "block"]).groupBy("source", "bucket").agg(F.first("offset").alias("offset"), F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("block", "phase", "slot", "first"))).alias("taken"))
    taken = written(taken, "mix-buckets")

    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(order, "doc_id")) - 1
    ranked = keyed.withColumn("rank", rank).join(taken, ["source", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    at = F.get("taken", (F.expr(f"rank div {block_rows}") - F.col("taken")[0]["block"]).cast("int"))
    placed = ranked.withColumn("at", at)
    position = F.col("at.first") + F.col("rank") % block_rows
    return placed.select("doc_id", F.col("source.source").alias("source"), "weight", "at.block", "at.phase", "at.slot", *more, position.alias("position"))


def mixed_documents(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs, their columns, in the order of the mix (ranges of positions, sorted inside each)."""
    placed = mix(docs, weights, block_rows, carry=True).select("position", "row")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
