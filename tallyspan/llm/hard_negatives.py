"""Hard negatives: exact integer scores of anchors against all rows by Strassen's multiplication on tiles.

Every component becomes floor(256 * x). The anchors (1 in ANCHOR_EVERY) are a stated query set that meets all rows, in
cells: a group of at most GROUP anchors by one of SLICES slices of the rows. A cell is a sorted stream in one task: its
anchors first, then its candidates in the order of their ids, TILE at a time, so that its memory is bounded whatever
the input. Tiles are multiplied as int64 by Strassen's recursion, padded with zeros; int64 wraps around, so sums that
leave the range on the way do no harm, and scores themselves are checked to fit.

The first pass keeps a heap of the best positives per anchor, the second a heap per anchor and window of scores (a
window follows from a positive's score). Heaps of the cells are merged by rank: SLICES of them per anchor, whatever the
number of rows, so what is shuffled grows with the anchors and, by the number of groups, with the candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import table, written

ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
GROUP, SLICES, TILE = 1 << 13, 16, 512
#: Numbers in a group's matrix: of long vectors fewer anchors make a group.
GROUP_VALUES = 1 << 23
#: Anchors of a tile, and the side at which the recursion multiplies as usual.
ANCHOR_TILE, LEAF = 256, 16
#: A base whose window is empty.
NO_BASE = -1
HITS = "anchor long, base long, rid long, vec_id long, score long"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64; odd sides get a row or column of zeros, tiles of a side up to LEAF are multiplied as usual."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        return strassen(a, np.pad(b, ((0, k % 2), (0, m % 2))))[:n, :m]
    h, i, j = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    m1, m2, m3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    m4, m5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    m6, m7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    return np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])


class Heaps:
    """For each of several anchors and bases the k best (score, then smaller id, then smaller row) of what is offered.

    floor holds the score of the k-th best where k are held, so that most offers are refused for whole tiles at once.
    """

    def __init__(self, n: int, k: int):
        self.k, self.held, self.floor = k, [[] for _ in range(n)], np.full(n, np.iinfo(np.int64).min)

    def offer(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rids: np.ndarray, first: int) -> None:
        """scores (anchors, candidates) of the heaps from number first on."""
        at, col = np.nonzero(allowed & (scores >= self.floor[first : first + len(scores), None]))
        for h, score, vec_id, rid in zip((at + first).tolist(), scores[at, col].tolist(), ids[col].tolist(), rids[col].tolist()):
            heap, entry = self.held[h], (score, -vec_id, -rid)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
                if len(heap) == self.k:
                    self.floor[h] = heap[0][0]
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
                self.floor[h] = heap[0][0]


def _matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Lists as rows of int64, short ones filled up."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _cells(k: int, width: int, n_bases: int, window: tuple[int, int] | None):
    """Cells sorted by (cell, kind, vec_id, rid): their heaps as rows of HITS.

    Anchors have kind 0 and candidates kind 1. Without a window candidates of the anchor's label compete, the anchor
    itself apart; with one, for each of the anchor's bases those of other labels whose score is in its window.
    """

    def run(batches):
        cell, anchors, heaps, waiting = None, [], None, []
        own_rid = own_label = bases = matrix = low = high = None

        def begin():
            nonlocal own_rid, own_label, bases, matrix, low, high, heaps
            own_rid, own_label, bases, matrix = (np.concatenate(c) for c in zip(*anchors))
            heaps = Heaps(len(matrix) * n_bases, k)
            if window is not None:  # hundredths of base = 100 * whole + rest, without leaving 64 bits
                whole, rest = np.divmod(bases, 100)
                low, high = window[0] * whole - -window[0] * rest // 100, window[1] * whole + window[1] * rest // 100

        def multiply(label, vec_id, rid, vectors):
            right = vectors.T.copy()
            for first in range(0, len(matrix), ANCHOR_TILE):
                part = slice(first, first + ANCHOR_TILE)
                allowed = own_label[part, None] == label
                if window is None:
                    allowed &= own_rid[part, None] != rid
                    if allowed.any():
                        heaps.offer(strassen(matrix[part], right), allowed, vec_id, rid, first)
                elif not allowed.all():
                    scores, other = strassen(matrix[part], right), ~allowed
                    for n in range(n_bases):
                        heaps.offer(scores, other & (scores >= low[part, n, None]) & (scores <= high[part, n, None]), vec_id, rid, n * len(matrix) + first)

        def taken(force: bool):
            nonlocal waiting
            if waiting and (force or sum(len(w[0]) for w in waiting) >= TILE):
                joined = [np.concatenate(c) for c in zip(*waiting)]
                for at in range(0, len(joined[0]), TILE):
                    multiply(*(c[at : at + TILE] for c in joined))
                waiting = []

        def finished():
            if heaps is None:
                return
            taken(True)
            names, base = np.tile(own_rid, n_bases).tolist(), bases.T.ravel().tolist()
            for first in range(0, len(heaps.held), 1024):
                part = slice(first, first + 1024)
                rows = [(a, b, -r, -v, s) for a, b, held in zip(names[part], base[part], heaps.held[part]) for s, v, r in held]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["anchor", "base", "rid", "vec_id", "score"])

        for batch in batches:
            cells, kinds = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "kind"))
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                if start == end:
                    continue
                rows = batch.slice(start, end - start)
                if cells[start] != cell:
                    yield from finished()
                    cell, anchors, heaps, waiting = cells[start], [], None, []
                label, vec_id, rid = (rows[c].to_numpy(zero_copy_only=False) for c in ("label", "vec_id", "rid"))
                vectors = _matrix(rows["vector"], width)
                if kinds[start] == 0:
                    anchors.append((rid, label, _matrix(rows["bases"], n_bases, NO_BASE), vectors))
                elif anchors:
                    if heaps is None:
                        begin()
                    waiting.append((label, vec_id, rid, vectors))
                    taken(False)
        yield from finished()

    return run


def _mined(anchors: DataFrame, rows: DataFrame, n_anchors: int, width: int, n_bases: int, k: int, window: tuple[int, int] | None = None) -> DataFrame:
    """The k best of rows for each row and base of anchors (HITS, with their rank), merged over the cells."""
    group_rows = max(1, min(GROUP, GROUP_VALUES // max(1, width)))
    groups, slices = max(1, -(-n_anchors // group_rows)), F.lit(SLICES)
    names = ["rid", "vec_id", "label", "bases", "vector"]
    group = F.pmod(F.xxhash64("rid"), F.lit(groups))
    left = anchors.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), slices - 1), lambda s: group * slices + s))).select(F.lit(0).alias("kind"), "cell", *names)
    slice_of = F.pmod(F.xxhash64("rid"), slices)
    right = rows.withColumn("bases", F.lit(None).cast("array<long>")).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * slices + slice_of))).select(F.lit(1).alias("kind"), "cell", *names)
    cells = left.unionByName(right).repartitionByRange(groups * SLICES, "cell").sortWithinPartitions("cell", "kind", "vec_id", "rid")
    hits = cells.mapInArrow(_cells(k, width, n_bases, window), HITS)
    order = Window.partitionBy("anchor", "base").orderBy(F.col("score").desc(), "vec_id", "rid")  # at most SLICES * k rows
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """(rid, vec_id, label, vector as whole numbers) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", whole.alias("vector"))


def hard_negatives(vectors: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOWEST, HIGHEST)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding).

    label and anchor are columns over the rows: the label that counts, and which rows are anchors (by default every
    hundredth vec_id). Rows with a null vec_id, label, vector or component, or one that is not finite, take no part.
    An anchor's positives are its best other rows of the same label, its negatives of a positive the best rows of other
    labels in the window, by score, then smaller vec_id, then row. Rows that repeat a vec_id are rows of their own;
    vectors of unlike length are padded with zeros. An anchor without positives, or a positive without negatives, has no
    rows; an empty table gives none. Scores beyond 64 bits are an error. Other columns are not read.
    """
    rows = written(usable(vectors, label), "negatives-rows")
    is_anchor = F.pmod("vec_id", F.lit(ANCHOR_EVERY)) == 0 if anchor is None else anchor
    chosen = written(rows.where(is_anchor).withColumn("bases", F.array(F.lit(0).cast("long"))), "negatives-anchors")
    largest = F.coalesce(F.array_max(F.transform("vector", lambda v: F.abs(v))), F.lit(0).cast("long"))
    width, most = (x or 0 for x in rows.agg(F.max(F.size("vector")), F.max(largest)).first())
    if most * most * width >= 2**63:
        raise ValueError(f"{width} components of up to {most} make scores beyond 64 bits")
    n = chosen.count()
    found = written(_mined(chosen, rows, n, width, 1, positives), "negatives-positives")
    bases = found.groupBy(F.col("anchor").alias("rid")).agg(F.collect_set("score").alias("bases"))
    near = _mined(chosen.drop("bases").join(bases, "rid"), rows, n, width, positives, negatives, window)
    near = near.select("anchor", F.col("base").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.join(chosen.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    pairs = pairs.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(near, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
