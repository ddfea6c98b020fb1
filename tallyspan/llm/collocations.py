"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass.

First pass. Tasks count the n-grams (of 1 to max_words words) of some SEGMENT_WORDS words at a time and send each
hash partition its sorted keys and counts: summaries too small to have lost anything. A partition's task learns its
mass (all occurrences in it) first, sets its capacity to more than mass / threshold, and merges the summaries as they
stream in: counters are added, and when there are more than the capacity, the next largest counter is taken from all.
What is taken from a counter in all is less than threshold, so every n-gram that occurs threshold times survives.
The number of partitions grows with the bytes of the texts, so that a summary stays at some megabytes.

Second pass. Which keys survived is told to the tasks as a Bloom filter of at most FILTER_BITS, whatever the input
(beyond its size more n-grams pass, and none is lost). N-grams that pass are counted as text, so neither a collision
of keys nor the filter shows in the result. Scores are decimals of 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import LOWER, UPPER, table, written

MAX_WORDS, THRESHOLD, TOP, ABSORBED = 3, 10, 2000, 50
SEGMENT_WORDS, BLOCK_BYTES = 1 << 19, 1 << 21
PART_BYTES, LEAST_PARTS = 1 << 23, 16
FILTER_BITS, PAGE_BITS, PROBES = 1 << 27, 1 << 19, 4
ROWS, RANKED = 1 << 14, 16
#: What a piece ends at; a byte that UTF-8 never has stands for it.
ENDS, EDGE = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, LOWER.encode() + b" " + EDGE * len(ENDS))
_BORDER, _MIX = EDGE, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of at most about BLOCK_BYTES bytes of a text, cut where a word ends."""
    start = 0
    while len(data) - start > BLOCK_BYTES:
        end = max(data.rfind(b" ", start, start + BLOCK_BYTES), data.rfind(EDGE, start, start + BLOCK_BYTES))
        if end <= start:  # a word longer than a block
            found = [p for p in (data.find(b" ", start + 1), data.find(EDGE, start + 1)) if p > 0]
            end = min(found, default=len(data))
        yield data[start:end]
        start = end
    yield data[start:]


class Segment:
    """Words of texts of one language, numbered as they come; number 0 is the border of a piece.

    carried: the last words of a text that goes on from the segment before; n-grams that end in them were counted there.
    """

    def __init__(self, lang: str, carried: list[bytes]):
        self.lang, self.carried, self.size = lang, len(carried), 0
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_BORDER]
        self.parts: list[np.ndarray] = []
        self.add(carried)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def close(self) -> None:
        self.ids = np.concatenate(self.parts)
        self.words = list(self.number)

    def starts(self, order: int) -> np.ndarray:
        """Where n-grams of order words begin that lie in one piece and end in a new word."""
        n = len(self.ids) - order + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(n, bool)
        for j in range(order):
            whole &= self.ids[j : n + j] > 0
        whole[: max(0, self.carried - order + 1)] = False
        return np.flatnonzero(whole)

    def keys(self, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, 64-bit keys) of the n-grams of each order."""
        seed = xxhash.xxh32_intdigest(self.lang.encode())
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)[self.ids]
        found = own
        for order in range(1, max_words + 1):
            if order > 1:
                found = found[:-1] * _MIX[0] + own[order - 1 :] if len(found) > 1 else found[:0]
                found = (found ^ found >> np.uint64(31)) * _MIX[1]
                found ^= found >> np.uint64(29)
            at = self.starts(order)
            yield at, found[at]

    def counted(self, at: np.ndarray, order: int) -> Iterator[tuple[str, int]]:
        """(n-gram, occurrences) of those that begin at the given places, compared word by word."""
        if not len(at):
            return
        code = self.ids[at]
        for j in range(1, order):
            code = np.unique(code * len(self.words) + self.ids[at + j], return_inverse=True)[1]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        for begin, times in zip(at[first].tolist(), n.tolist()):
            yield b" ".join(self.words[i] for i in self.ids[begin : begin + order]).decode(), times


def segments(batches, max_words: int) -> Iterator[list[Segment]]:
    """The segments, one per language, of each SEGMENT_WORDS words or so of rows (text, lang)."""
    held: dict[str, Segment] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            lang, carried = "und" if lang is None else lang, []
            for block in blocks((text or "").encode().translate(_TABLE)):
                if sum(s.size for s in held.values()) >= SEGMENT_WORDS:
                    yield list(held.values())
                    held = {}
                if lang not in held:
                    held[lang] = Segment(lang, carried)
                words = block.replace(EDGE, b" \xff ").split()
                held[lang].add(words)
                carried = (carried + words)[-(max_words - 1) :] if max_words > 1 else []
            held[lang].add([_BORDER])
    if held:
        yield list(held.values())


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences and counts less 1, byte by byte of all: most are zeros, which compress."""
    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view("u1").reshape(len(x), -1).T).tobytes()
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8"), planes(counts - 1, "<u4")


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = lambda x, kind: np.ascontiguousarray(np.frombuffer(x, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(plain(keys, "<u8"), dtype=np.uint64), plain(counts, "<u4").astype(np.int64) + 1


class Summary:
    """A Misra-Gries summary of at most capacity counters; lost is what each counter may be short of."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.waiting, self.n_waiting = capacity, 0, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(self.capacity, ROWS):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            kept = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[kept], self.counts[kept] - cut, self.lost + cut

    def frequent(self, threshold: int) -> np.ndarray:
        """The keys that may have occurred threshold times; all that did are among them."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def _summaries(max_words: int, parts: int):
    """Rows (part, kind, mass, keys, counts): a mass (kind 0) and a small summary (kind 1) per segment and partition."""

    def run(batches):
        for group in segments(batches, max_words):
            found = []
            for s in group:
                s.close()
                found += [keys for _, keys in s.keys(max_words)]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            if not len(keys):
                continue
            part = part_of(keys, parts)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for first in range(0, len(edges), 64):
                rows = []
                for low, high in zip(edges[first : first + 64], [*edges[first + 1 : first + 64], edges[first + 64] if first + 64 < len(edges) else len(keys)]):
                    own = int(part[low])
                    rows += [(own, 0, int(counts[low:high].sum()), None, None), (own, 1, None, *packed(keys[low:high], counts[low:high]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "kind", "mass", "keys", "counts"])

    return run


def _survivors(threshold: int):
    """Rows of _summaries sorted by part and kind: the keys of each partition that survive, and how many they are."""

    def run(batches):
        part, mass, summary = None, 0, None

        def finished():
            if summary is not None:
                keys = summary.frequent(threshold)
                for first in range(0, len(keys), 1 << 17):
                    own = keys[first : first + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["n", "keys"])

        for batch in batches:
            for own, kind, more, keys, counts in ([x.as_py() for x in row] for row in zip(*batch.columns)):
                if own != part:
                    yield from finished()
                    part, mass, summary = own, 0, None
                if kind == 0:
                    mass += more
                else:
                    summary = summary or Summary(mass // threshold + 1)
                    summary.add(*unpacked(keys, counts))
        yield from finished()

    return run


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(page, bits in it) of keys: neighbours share a page, so a partition of the keys has few of them."""
    page = part_of(keys, bits // PAGE_BITS)
    mixed = (keys ^ keys >> np.uint64(30)) * _MIX[1]
    probes = [(mixed >> np.uint64(8 + 7 * j)).astype(np.int64) % PAGE_BITS for j in range(PROBES)]
    return page, np.stack(probes)


def _pages(bits: int):
    def run(batches):
        for batch in batches:
            for raw in batch["keys"].to_pylist():
                page, places = _places(np.frombuffer(raw, "<u8"), bits)
                for p in np.unique(page).tolist():
                    mask = np.zeros(PAGE_BITS, bool)
                    mask[places[:, page == p].ravel()] = True
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(mask).tobytes()], pa.binary())], ["page", "bits"])

    return run


def _or_pages(batches):
    """Rows sorted by page: one row for each page."""
    page, bits = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["page", "bits"])
    for batch in batches:
        for p, raw in zip(batch["page"].to_pylist(), batch["bits"].to_pylist()):
            if p != page:
                if page is not None:
                    yield row()
                page, bits = p, np.zeros(PAGE_BITS // 8, np.uint8)
            bits |= np.frombuffer(raw, np.uint8)
    if page is not None:
        yield row()


def survivor_filter(survivors: DataFrame) -> np.ndarray:
    """The survivors' Bloom filter, 16 bits a key, FILTER_BITS at most."""
    n = survivors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = PAGE_BITS
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    pages = survivors.select("keys").mapInArrow(_pages(bits), "page long, bits binary")
    whole = pages.repartition("page").sortWithinPartitions("page").mapInArrow(_or_pages, "page long, bits binary")
    out = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    for row in whole.toLocalIterator():  # FILTER_BITS / PAGE_BITS pages at most
        out[row.page] = np.frombuffer(row.bits, np.uint8)
    return out


def _exact(bloom, max_words: int):
    """Rows (lang, words, phrase, n) of the n-grams that pass the filter; words 0 has the number of all words."""

    def run(batches):
        pages = bloom.value
        bits = pages.size * 8
        for group in segments(batches, max_words):
            rows = []
            for s in group:
                s.close()
                rows.append((s.lang, 0, "", int(len(s.starts(1)))))
                for order, (at, keys) in enumerate(s.keys(max_words), 1):
                    page, places = _places(keys, bits)
                    passed = np.ones(len(keys), bool)
                    for p in places:
                        passed &= (pages[page, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
                    rows += [(s.lang, order, phrase, n) for phrase, n in s.counted(at[passed], order)]
            for first in range(0, len(rows), ROWS):
                columns = zip(*rows[first : first + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "words", "phrase", "n"])

    return run


def frequent_ngrams(docs: DataFrame, max_words: int = MAX_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, words, phrase, n) of every n-gram that occurs threshold times, and of all words (words 0) per language."""
    own = docs.select("text", "lang")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    small = own.mapInArrow(_summaries(max_words, parts), "part long, kind int, mass long, keys binary, counts binary")
    dealt = small.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind")
    survivors = written(dealt.mapInArrow(_survivors(threshold), "n long, keys binary"), "collocation-survivors")
    bloom = docs.sparkSession.sparkContext.broadcast(survivor_filter(survivors))
    counted = own.mapInArrow(_exact(bloom, max_words), "lang string, words int, phrase string, n long")
    totals = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return totals.where((F.col("n") >= threshold) | (F.col("words") == 0))


def _part(first, length):
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, threshold: int = THRESHOLD, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to max_words words of each language.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut (ties: the first cut), n that of all
    words; score = floor(1000000 a a / (l r)). A phrase that stands in a longer one with absorbed hundredths of its count
    or more is dropped. Order: score, a (both descending), phrase by its bytes. Texts are lower-cased (A-Z) and split at
    [.,;:!?] and line ends into pieces, those at blanks into words. A null text is empty, a null lang is "und", an empty
    table gives no rows; repeated rows count as often as they come; other columns are not read.
    """
    counts = written(frequent_ngrams(docs, max_words, threshold), "collocation-counts")
    known = counts.where("words > 0")
    phrases = known.where("words > 1").withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    up, down = F.lit(1000000).cast("decimal(7,0)") * whole("a", 15) * whole("a", 15), whole("l", 18) * whole("r", 18)
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumns({"up": up, "down": down}).withColumn("score", F.expr("up div down"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where("words > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    longer = inner.select("lang", _part(F.col("first"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    # the best of each of some parts of a language, then of those: no task ranks more than RANKED * top rows
    order = [F.col("cut.score").desc(), F.col("a").desc(), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM numbered, (VALUES (1), (2), (3)) o(k) WHERE len(w) >= k)),
f AS (SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM numbered GROUP BY 1),
cuts AS (
  SELECT lang, phrase, words, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
  FROM f, (VALUES (1), (2)) c(k) WHERE words > k),
scored AS (
  SELECT c.*, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.lp = x.phrase JOIN f y ON c.lang = y.lang AND c.rp = y.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, n, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE words = 3) GROUP BY 1, 2),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON s.lang = g.lang AND s.phrase = g.phrase WHERE g.n IS NULL OR 100 * g.n < 50 * s.a)
SELECT k.lang, row_number() OVER w AS rank, phrase, a, l, r, t.n, score FROM kept k JOIN totals t ON k.lang = t.lang
WINDOW w AS (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""
