"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Sets are sorted arrays of 64-bit shingle numbers: 5 bits of a commonness level from a count sketch over all
documents, then 59 hash bits, so that every set lists its rare shingles first. Two sets of n and m shingles with
Jaccard t or more overlap in a = ceil(t (n + m) / (1 + t)) shingles, and so share one that is among the first
n - a + 1 of the one and the first m - a + 1 of the other: only these places of the matrix are multiplied (the
prefixes), and the smaller side needs no more than its first m - ceil(2 t m / (1 + t)) + 1. The product gives
candidate pairs with their overlap so far and where it ended; pairs that cannot reach a with what both sides have
left after that are discarded, and so are pairs whose parities (of the shingles in each of some n hash cells) differ
in more cells than two linked sets can differ in shingles; the rest are counted in full.

Components need no pair whose two sides are already joined, so the product is taken in blocks:
 - documents with equal sets are one row (their class), however many they are;
 - hub rounds: in each column and size band every class meets only the column's hub, the class that has fewest rarer
   shingles of its own, and is checked against the hub it shares most with; each round takes hubs that were none
   before, until a round finds no link or HUB_ROUNDS are over; what they find is contracted to components;
 - last, the blocks of a column are the components in it: each is multiplied with the others, never with itself,
   and only where a size band says that the places can be in both prefixes. Where blocks are many for
   the number of classes, the columns are taken in several passes, so that no more is shuffled at once.
No column or pair is capped. Pairs are checked in blocks of a hub's classes, so that a hub of a third of all rows is
spread over tasks; a task passes over pairs that its earlier links already connect.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import ASCII_LOWER, delete_path, rows_of, table, written, written_alone

WORDS_A_SHINGLE, PERCENT = 4, 85
#: What near duplicates are for the pipeline.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Counters of the sketch (its size, whatever the input) and how many travel in one row.
SKETCH, SKETCH_PAGE = 1 << 20, 1 << 14
LEVEL_SHIFT = 59
HUB_ROUNDS = 2
#: 64-bit words of parities that a set has at least, a power of 2; larger sets have a word for each 64 shingles.
PARITY_WORDS = 8
#: Words of them (a power of 2) that go along in the last product, which is tested against the others after it.
CROSS_WORDS = 2
#: Size bands of the last product to each range from the smallest to the largest size that a set can link with.
BANDS = 1
#: Blocks, for each class, that one pass of the last product multiplies.
BLOCKS_A_CLASS = 16
#: Classes checked against one hub in one block.
BLOCK_ROWS = 64
#: Bits for each id, and in all at most, of the filter that tells a scan which documents' sets are wanted. It only
#: saves work: beyond that size more sets pass, and the join that follows drops them.
WANTED_BITS_A_ROW, MOST_WANTED_BITS, WANTED_PAGE = 64, 1 << 27, 1 << 19
#: Characters of text whose sets a task holds at a time, and bytes of sets that it compares at a time.
SLICE_CHARS, SLICE_BYTES = 1 << 21, 1 << 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = WORDS_A_SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a text, repeats too; with fewer words than a shingle, of the whole as one."""
    words = (text or "").encode().translate(ASCII_LOWER).split()  # bytes.split(): exactly [\x20\x09-\x0D]
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def ranked(text: str | None, levels: np.ndarray, size: int = WORDS_A_SHINGLE) -> np.ndarray:
    """The set of a text in prefix order: the level of how common a shingle is, then its hash."""
    h = shingles(text, size)
    level = levels[h & np.uint64(SKETCH - 1)].astype(np.uint64)
    return np.unique(level << np.uint64(LEVEL_SHIFT) | h >> np.uint64(64 - LEVEL_SHIFT))


def levels_of(sketch: np.ndarray) -> np.ndarray:
    """The level of each cell: 0 up to some times the mean count, then one for each doubling."""
    usual = 4 * int(sketch.mean()) + 16
    return np.minimum(np.frexp((sketch // usual).astype(np.float64))[1], 31).astype(np.uint8)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters or bytes in a column, one row at least."""
    sizes = np.cumsum([len(x.as_py() or "") for x in batch.column(column)]) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _sketch_rows(size: int):
    def run(batches):
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part in _slices(batch, 0, SLICE_CHARS):
                cells, n = np.unique(np.concatenate([shingles(t.as_py(), size) for t in part.column(0)]) & np.uint64(SKETCH - 1), return_counts=True)
                total[cells.astype(np.int64)] += n.astype(np.uint32)
        pages = [(n, total[n * SKETCH_PAGE : (n + 1) * SKETCH_PAGE]) for n in range(SKETCH // SKETCH_PAGE)]
        used = [(n, p) for n, p in pages if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in used], pa.int32()), pa.array([p.astype("<u4").tobytes() for _, p in used], pa.binary())], ["page", "counts"])

    return run


def _sum_pages(rows: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_PAGE, np.uint64)
    for x in rows.column("counts"):
        total += np.frombuffer(x.as_py(), "<u4")
    return pa.table({"page": rows.column("page")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def count_sketch(docs: DataFrame, size: int = WORDS_A_SHINGLE) -> np.ndarray:
    """How often shingles of each of SKETCH hash cells occur in all documents: 4 MB, whatever the input."""
    parts = docs.select("text").mapInArrow(_sketch_rows(size), "page int, counts binary")
    # two steps, so that no task gathers a page from all tasks at once
    some = parts.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64)))
    some = some.groupBy("page", "part").applyInArrow(lambda t: _sum_pages(t.select(["page", "counts"])), "page int, counts binary")
    pages = written(some.groupBy("page").applyInArrow(_sum_pages, "page int, counts binary"), "join-sketch")
    out = np.zeros(SKETCH, np.uint64)
    for row in pages.toLocalIterator():
        out[row.page * SKETCH_PAGE : (row.page + 1) * SKETCH_PAGE] = np.frombuffer(row.counts, "<u4")
    _removed(pages)
    return out.astype(np.uint32)


def _key(ranked_set: np.ndarray) -> bytes:
    return hashlib.blake2b(ranked_set.tobytes(), digest_size=16).digest()


def parity(ranked_set: np.ndarray) -> np.ndarray:
    """For each hash cell whether the set has an odd number of shingles in it, as bits of signed 64-bit words."""
    words = max(PARITY_WORDS, 1 << (len(ranked_set) // 64).bit_length())
    odd = np.bincount((ranked_set & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(parity: Column, words: Column) -> Column:
    """The parities in so many words (a power of 2) of a set's own, which are as many or more."""
    word = lambda k: F.aggregate(F.sequence(k, F.size(parity) - 1, words), F.lit(0).cast("long"), lambda a, at: a.bitwiseXOR(F.get(parity, at)))
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def _can_link(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that differ in so many at least can overlap in a."""
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(sketch, size: int, percent: int):
    def run(batches):
        counts = sketch.value
        for batch in batches:
            for part in _slices(batch, 1, SLICE_CHARS):
                sets = [ranked(t.as_py(), counts, size) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()),
                     pa.array([s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                     pa.array([parity(s) for s in sets], pa.list_(pa.int64())), part.column(2)],
                    ["doc_id", "n", "set_key", "prefix", "parity", "text_key"],
                )

    return run


def _place(doc_id: int | None, bits: int) -> int:
    return zlib.crc32(repr(doc_id).encode()) % bits


def _wanted_sets(sketch, wanted, size: int):
    """The sets of documents that the filter lets through."""

    def run(batches):
        counts, bits = sketch.value, wanted.value
        for batch in batches:
            places = [_place(doc_id, 8 * len(bits)) for doc_id in batch.column(0).to_pylist()]
            let_through = pa.array([bool(bits[p >> 3] >> (p & 7) & 1) for p in places], pa.bool_())
            for part in _slices(batch.select([1]).filter(let_through), 0, SLICE_CHARS):
                sets = [ranked(t.as_py(), counts, size) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "set"])

    return run


def _filter_pages(bits: int):
    page = min(WANTED_PAGE, bits)

    def run(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            for doc_id in batch.column(0).to_pylist():
                p = _place(doc_id, bits)
                pages.setdefault(p // page, np.zeros(page // 8, np.uint8))[p % page // 8] |= 1 << (p & 7)
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], ["page", "bits"])

    return run


def _or_pages(rows: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("bits")])
    return pa.table({"page": rows.column("page")[:1], "bits": pa.array([total.tobytes()], pa.binary())})


def _wanted_filter(ids: DataFrame, n: int) -> np.ndarray:
    bits = min(MOST_WANTED_BITS, 1 << max(16, (WANTED_BITS_A_ROW * n - 1).bit_length()))
    out, page = np.zeros(bits // 8, np.uint8), min(WANTED_PAGE, bits) // 8
    pages = ids.mapInArrow(_filter_pages(bits), "page int, bits binary").groupBy("page").applyInArrow(_or_pages, "page int, bits binary")
    pages = written(pages, "join-filter")
    for row in pages.toLocalIterator():
        out[row.page * page : (row.page + 1) * page] = np.frombuffer(row.bits, np.uint8)
    _removed(pages)
    return out


class _Joined:
    """Which nodes the links of a task connect."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, node: int) -> int:
        while (up := self.above.get(node, node)) != node:
            self.above[node] = self.above.get(up, up)
            node = up
        return node

    def join(self, a: int, b: int) -> None:
        self.above[self.top(a)] = self.top(b)


def _overlaps(percent: int):
    """Rows (hub, block, a, set) sorted by hub and block, each block led by the hub's own set (a is null): links.

    A link between two nodes that earlier links of the task already connect is left out.
    """

    def run(batches):
        hub = block = hub_set = None
        joined = _Joined()
        for batch in batches:
            for part in _slices(batch, 3, SLICE_BYTES):
                found = []
                for h, b, a, raw in zip(*(part.column(n).to_pylist() for n in range(4))):
                    if a is None:
                        hub, block, hub_set = h, b, np.frombuffer(raw, np.uint64)
                        continue
                    assert (hub, block) == (h, b), "a hub's set leads each of its blocks"
                    if joined.top(a) == joined.top(h):
                        continue
                    values = np.frombuffer(raw, np.uint64)
                    at = np.searchsorted(hub_set, values)
                    at[at == len(hub_set)] = 0
                    both = int((hub_set[at] == values).sum())
                    if 100 * both >= percent * (len(values) + len(hub_set) - both):
                        joined.join(a, h)
                        found.append((a, h))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], ["a", "b"])

    return run


def _checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sketch, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, enough of them to connect what all of them connect; written."""
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(classes.join(nodes, "node", "left_semi").select("node", "set_key", "min_id"), "join-known")
    wanted = spark.sparkContext.broadcast(_wanted_filter(known.select("min_id"), known.count()))
    sets = docs.select("doc_id", "text").mapInArrow(_wanted_sets(sketch, wanted, size), "set_key binary, set binary")
    # several rows may have had the same set; a class has one key, so the sets lie together already
    sets = written(known.hint("merge").join(sets, "set_key").dropDuplicates(["set_key"]).select("node", "set"), "join-sets")
    # the block of a pair is drawn by its own side: about BLOCK_ROWS rows for a hub of any size
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sized = pairs.join(sizes, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    members = sized.join(sets, sized["a"] == sets["node"]).select("b", "block", "a", "set")
    hubs = sized.select("b", "block").distinct().join(sets, F.col("b") == sets["node"]).select("b", "block", F.lit(None).cast("long").alias("a"), "set")
    rows = members.unionByName(hubs).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    links = written(rows.mapInArrow(_overlaps(percent), "a long, b long"), "join-links")
    _removed(sets, known)
    wanted.destroy()
    return links


def _removed(*scratch: DataFrame) -> None:
    """Removes the folders of written tables that are not read again."""
    for table in scratch:
        if files := table.inputFiles():
            delete_path(table.sparkSession, files[0].rpartition("/")[0])


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of the links (a, b): label is the smallest node reachable; written.

    Each turn takes the smallest label among neighbours and then the label's own label, so that long chains
    shrink by halves; it ends when no label changes.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "join-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "join-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        new = written(new, "join-labels")
        _removed(labels)
        if new.where("label != old").isEmpty():
            _removed(edges)
            return new.drop("old")
        labels = new.drop("old")


def _near_in_size(n: Column, i: Column, m: Column, percent: int) -> Column:
    """Whether place i (from 0) of a set of n is in its prefix for sets of m: a <= n - i."""
    return percent * (n + m) <= (100 + percent) * (n - i)


def _reaches(n: Column, i: Column, m: Column, j: Column, so_far: Column, percent: int) -> Column:
    """Whether the overlap so far and all that may follow can reach the bound.

    i and j are the places of the last shingle that both prefixes hold. Whatever else the sets share stands after it in
    both: before it, it would be in both prefixes and counted.
    """
    return percent * (n + m) <= (100 + percent) * (so_far + F.least(n - i, m - j) - 1)


def _several(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their component (col comp) in the columns that hold several."""
    own = postings.join(labels.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    many = own.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("gram")
    return own.join(many, "gram", "left_semi")


def _hub_pairs(block: DataFrame, used: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b): each class and the hub it shares most with, of those that it may link with. used: earlier hubs."""
    free = block.join(used, block["node"] == used["hub"], "left_anti") if used is not None else block
    rank = F.struct("i", "node")
    hubs = free.groupBy("gram", "band").agg(F.min(rank)["node"].alias("b"), F.min_by("n", rank).alias("m"), F.min("i").alias("j"), F.min_by("comp", rank).alias("other"))
    n, i, m, j = (F.col(c) for c in "nimj")
    met = block.join(hubs, ["gram", "band"]).where((F.col("comp") != F.col("other")) & _near_in_size(n, i, m, percent) & _near_in_size(m, j, n, percent))
    met = met.groupBy("node", "b").agg(F.count("*").alias("count"), *(F.max(c).alias(c) for c in "nimj"))
    # what is left out here, as it may share more than it shares as the hub's, is met in the last product
    met = met.where(_reaches(n, i, m, j, F.col("count"), percent))
    return met.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities let them link. marks: (node, n, parity)."""
    # names that marks has not itself: a column that keeps its name makes another plan of the other side's shuffle, and
    # the two sides are one shuffle read twice
    side = lambda node, size, own: marks.select(F.col("node").alias(node), F.col("n").alias(size), F.col("parity").alias(own))
    # merged at every size: what is shuffled then grows as the input does
    both = pairs.hint("merge").join(side("a", "na", "pa"), "a").hint("merge").join(side("b", "nb", "pb"), "b")
    words = F.least(F.size("pa"), F.size("pb"))
    short = lambda c: F.when(F.size(c) == words, F.col(c)).otherwise(folded(F.col(c), words))
    differ = F.aggregate(F.zip_with(short("pa"), short("pb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return both.where(_can_link(F.col("na"), F.col("nb"), differ, percent)).select("a", "b")


def _pairs_across(block: DataFrame, marks: DataFrame, percent: int, classes: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may link: a is the smaller set; written. marks: (node, n, parity)."""
    n, i, m, j = (F.col(c) for c in "nimj")
    step = -np.log(percent / 100) / BANDS
    band = lambda size: F.floor(F.log(size.cast("double")) / float(step))
    small = block.select("gram", F.col("comp").alias("one"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"))
    small = small.where(_near_in_size(m, j, m, percent)).withColumn("band", band(m))
    least, most = F.ceil(n * percent / 100), F.least(n, F.floor((100 + percent) * (n - i) / percent) - n)
    large = block.select("gram", F.col("comp").alias("two"), F.col("node").alias("b"), "n", "i").where(least <= most)
    large = large.withColumn("band", F.explode(F.sequence(band(least), band(most))))
    blocks = small.select("gram", "band", "one").distinct().join(large.select("gram", "band", "two").distinct(), ["gram", "band"])
    blocks = written(blocks.where("one != two"), "join-blocks")
    # parities go only with what is multiplied
    words = range(CROSS_WORDS)
    parities = marks.select("node", folded(F.col("parity"), F.lit(CROSS_WORDS)).alias("parity"))
    with_parity = lambda rows, node, name: rows.join(parities, rows[node] == parities["node"]).select(*rows.columns, *(F.get("parity", F.lit(k)).alias(f"{name}{k}") for k in words))
    small = written(with_parity(small.join(blocks, ["gram", "band", "one"], "left_semi"), "a", "p"), "join-small")
    large = written(with_parity(large.join(blocks, ["gram", "band", "two"], "left_semi"), "b", "q"), "join-large")
    differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in words), F.lit(0))
    # so many columns at a time that what is shuffled at once follows the classes, not the blocks, which grow faster
    passes, parts = 1 + blocks.count() // (BLOCKS_A_CLASS * classes + 1), []
    for k in range(passes):
        part = blocks.where(F.pmod(F.xxhash64("gram"), F.lit(passes)) == k)
        met = part.join(small, ["gram", "band", "one"]).join(large, ["gram", "band", "two"])
        met = met.where(_can_link(n, m, differ, percent) & _near_in_size(n, i, m, percent) & _near_in_size(m, j, n, percent) & ((m < n) | (m == n) & (F.col("a") < F.col("b"))))
        parts.append(written(met.groupBy("a", "b").agg(F.count("*").alias("count"), *(F.max(c).alias(c) for c in "nimj")), "join-met"))
    _removed(blocks, small, large)
    met = reduce(DataFrame.unionByName, parts)
    if passes > 1:
        met = met.groupBy("a", "b").agg(F.sum("count").alias("count"), *(F.max(c).alias(c) for c in "nimj"))
    pairs = written(met.where(_reaches(n, i, m, j, F.col("count"), percent)).select("a", "b"), "join-across")
    _removed(*parts)
    return pairs


def near_components(docs: DataFrame, size: int = WORDS_A_SHINGLE, percent: int = PERCENT, text_key: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, class_size, component_id.

    Documents link when the Jaccard similarity of their sets of size-word shingles is percent or more; component_id is the smallest
    doc_id reachable by links, itself included. A text without words, or null, has an empty set and links with
    nothing. Rows that repeat an id are rows of their own. A null doc_id counts as no id: its row's component is
    that of the rows it links with. Other columns are not read. An empty table gives no rows. text_key: also text_key,
    a 64-bit hash of the row's text, and label, a number of the row's component (null without words).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.xxhash64("text") if text_key else F.lit(None).cast("long")).alias("text_key"))
    sketch = spark.sparkContext.broadcast(levels_of(count_sketch(docs, size)))
    found = docs.mapInArrow(_prefixes(sketch, size, percent), "doc_id long, n long, set_key binary, prefix array<long>, parity array<long>, text_key long")
    rows = written(found.withColumn("rid", F.monotonically_increasing_id()), "join-rows")
    # a class is known by the number of one of its rows, which has its prefix and parities
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("class_size"), F.min("rid").alias("node"))
    classes = written(classes, "join-classes")
    marks = rows.select(F.col("rid").alias("node"), "n", "parity")

    # merged at every size: what is shuffled then grows as the input does
    first = rows.where("n > 0").select(F.col("rid").alias("node"), "prefix").join(classes.select("node").hint("merge"), "node", "left_semi")
    places = first.select(F.posexplode("prefix").alias("i", "gram"), "node")
    # written before the places meet it: the shuffles of the two are never on disk together
    shared = written(places.groupBy("gram").count().where("count > 1").select("gram"), "join-shared")
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)))
    postings = places.join(shared, "gram", "left_semi").join(marks.select("node", "n"), "node")
    postings = written(postings.select("gram", "node", "n", F.col("i").cast("long").alias("i"), band.alias("band")), "join-postings")
    _removed(shared)

    # at first each class is a component, and all columns hold several; what is left of the columns is written once a round
    block, links, used = postings.withColumn("comp", F.col("node")), None, None
    labels = spark.createDataFrame([], "node long, label long")
    for _ in range(HUB_ROUNDS):
        pairs = written(_alike(_hub_pairs(block, used, percent), marks, percent), "join-pairs")
        if pairs.isEmpty():
            break
        found = _checked(docs, classes, pairs, sketch, size, percent)
        if found.isEmpty():
            break
        hubs = pairs.select(F.col("b").alias("hub"))
        used = written((used.union(hubs) if used is not None else hubs).distinct(), "join-used")
        links = written(links.unionByName(found), "join-links") if links is not None else found
        labels = components(links)
        before, block = block, written(_several(block.drop("comp"), labels), "join-block")
        _removed(before, pairs)

    across = _pairs_across(block, marks, percent, classes.count())
    pairs = written(_alike(across, marks, percent), "join-pairs")
    _removed(block, across)
    if not pairs.isEmpty():
        found = _checked(docs, classes, pairs, sketch, size, percent)
        labels = components(links.unionByName(found) if links is not None else found)

    joined = classes.join(labels, "node", "left").select("set_key", "min_id", "class_size", F.coalesce("label", "node").alias("label"))
    # written, so that the join below has a plain shuffle on both sides and a large component can be split
    least = written(joined.groupBy("label").agg(F.min("min_id").alias("component_id")), "join-least")
    by_key = joined.join(least, "label").select("set_key", "class_size", "component_id", "label")
    found = rows.join(by_key, "set_key", "left")
    out = [F.col("n").alias("n_shingles"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return found.select("doc_id", *out, *(["text_key", "label"] if text_key else []))


def one_of_each(docs: DataFrame, size: int = NEAR_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """Of each component of docs the row with the smallest doc_id (a null last), then the smallest hash of its text; all columns.

    Rows without words, which link with nothing, all stay. Rows that repeat both id and text are one row, of which one
    stays; rows that repeat an id alone are rows of their own. An empty table gives no rows.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")

    def keys() -> DataFrame:
        found = near_components(docs, size, percent, text_key=True)
        best = found.where("label is not null").groupBy("label").agg(F.min(order).alias("b"), F.count("*").alias("n")).select("b.doc_id", "b.text_key")
        kept = best.unionByName(found.where("label is null").select("doc_id", "text_key"))
        return kept.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.count("*")).select("id", "key")

    kept = written_alone(docs.sparkSession, "join-kept", keys)
    return rows_of(docs, kept, F.xxhash64, "join-repeated")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
