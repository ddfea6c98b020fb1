"""Token ids as sorted-string-table shards, keyed by document id.

File format (all numbers little-endian):
  data blocks   entries until BLOCK_BYTES: varint key bytes shared with the entry before (0 at a block's start),
                varint further key bytes, varint value bytes, the key bytes, the value; then the block's crc32 (u32)
  index         per block: its last key (KEY bytes), offset (u64), length without the crc (u32)
  Bloom filter  bytes, BLOOM_BITS per entry
  footer        offsets of index and filter, entries, ids (u64 each), bytes per id, blocks (u32 each), "TSSTABL1"
A key is a flag byte (0: null id, which sorts first) and the id as big-endian u64 with its sign bit flipped, so that
byte order is id order. A value is the document's ids, u16 where the vocabulary allows it, else u32.

Spark deals the documents by ranges of doc_id and sorts them; each task writes shards of some SHARD_BYTES through
pyarrow's file systems under names of its own and returns them as manifest rows. Only shards in the manifest,
which Spark commits, are read: what a lost or repeated task has left is ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import new_path, table, written
from tallyspan.llm.word_codec import WordIds, id_type, load_tokenizer

BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 15, 1 << 24, 10, 7
KEY, MAGIC = 9, b"TSSTABL1"
FOOTER = struct.Struct("<QQQQII8s")
BATCH_CHARS = 1 << 21


def key_of(doc_id: int | None) -> bytes:
    return bytes(KEY) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5A17) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries in key order in, one shard file out."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.offset = self.ids = 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        assert not self.keys or key >= self.keys[-1], "keys come in order"
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append(self.last + struct.pack("<QI", self.offset, len(self.block)))
            self.out.write(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.offset += len(self.block) + 4
            self.block = bytearray()

    def finish(self) -> None:
        self._end_block()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index + bytes(bloom))
        self.out.write(FOOTER.pack(self.offset, self.offset + len(index), len(self.keys), self.ids, self.id_bytes, len(self.index), MAGIC))


class ShardReader:
    """Reads a shard in whole, block by block, or one key by its filter, a binary search of the index and one block."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        index_at, bloom_at, self.entries, self.ids, self.id_bytes, self.blocks, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index_at)
        tail = source.read(source.size() - FOOTER.size - index_at)
        self.index, self.bloom = tail[: bloom_at - index_at], tail[bloom_at - index_at :]

    def _index_entry(self, n: int) -> tuple[bytes, int, int]:
        row = self.index[n * (KEY + 12) : (n + 1) * (KEY + 12)]
        return row[:KEY], *struct.unpack("<QI", row[KEY:])

    def block(self, n: int) -> Iterator[tuple[int | None, bytes]]:
        _, offset, length = self._index_entry(n)
        self.source.seek(offset)
        data = self.source.read(length + 4)
        if zlib.crc32(data[:length]) != struct.unpack("<I", data[length:])[0]:
            raise ValueError(f"block {n} is damaged")
        at, key = 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield id_of(key), data[at + more : at + more + size]
            at += more + size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for n in range(self.blocks):
            yield from self.block(n)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an id: one for each row that had it."""
        key, bits, found = key_of(doc_id), 8 * len(self.bloom), []
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return found
        low, high = 0, self.blocks
        while low < high:  # the first block whose last key is not before the key
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self._index_entry(middle)[0] < key else (low, middle)
        for n in range(low, self.blocks):
            found += [v for i, v in self.block(n) if i == doc_id]
            if self._index_entry(n)[0] > key:
                break
        return found


class WordCodec:
    """Encodes by white-space words, each distinct word once: for tokenizers that drop white space before they split."""

    def __init__(self, path: str, end_id: int | None):
        tokenizer = load_tokenizer(path)
        self.words, self.dtype = WordIds(tokenizer, lower=True), id_type(tokenizer)
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes, with the end id."""
        # Python also splits at these four, which the tokenizer keeps
        odd = [n for n, text in enumerate(texts) if any(c in text for c in "\x1c\x1d\x1e\x1f")]
        out = self.words.of([text.split() for text in texts])
        for n, ids in zip(odd, self.words.library([texts[n] for n in odd])):
            out[n] = ids
        return [ids + self.end for ids in out]


@lru_cache(maxsize=2)
def word_codec(path: str, end_id: int | None) -> WordCodec:
    return WordCodec(path, end_id)


MANIFEST = "part int, seq int, path string, first_id long, last_id long, docs long, ids long"


def _write_shards(folder: str, path: str, end_id: int | None):
    """Rows (doc_id, text) in order: shards of the task's own, and a manifest row for each."""

    def run(batches):
        from pyspark import TaskContext

        fs, base = pa.fs.FileSystem.from_uri(folder)
        code, part, seq = word_codec(path, end_id), TaskContext.get().partitionId(), 0
        writer = out = first = None

        def close():
            nonlocal writer, out, seq
            writer.finish()
            out.close()
            row = [part, seq, name, first, last, len(writer.keys), writer.ids]
            writer, seq = None, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], [x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for ids, texts in _slices(batch):
                for doc_id, value in zip(ids, code.encode(texts)):
                    if writer is None:
                        name = f"{base}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.sst"
                        fs.create_dir(base, recursive=True)
                        out, first = fs.open_output_stream(name), doc_id
                        writer = ShardWriter(out, code.dtype.itemsize)
                    writer.add(doc_id, value)
                    last = doc_id
                    if writer.offset >= SHARD_BYTES:
                        yield close()
        if writer is not None:
            yield close()

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_sstables(docs: DataFrame, path: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs (doc_id, text) in ascending order of doc_id; the manifest: a row per shard.

    A null text counts as empty: the end id alone. A null doc_id is a key of its own and sorts first; rows that
    repeat an id are entries of their own, in the order of their texts. Other columns are not read, whatever their
    names. An empty table gives no shard. folder: a URI that pyarrow's file systems open for writing on every
    executor; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sst")
    folder = re.sub(r"^(file:)?/+", "file:///", folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(_write_shards(folder, path, end_id), MANIFEST), "sst-manifest")
    # tasks hold ranges of ids in their order: a sum over the tasks, then one over each task's shards
    earlier = lambda window: F.coalesce(F.sum("ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("_before"))
    start = F.col("_before") + earlier(Window.partitionBy("part").orderBy("seq"))
    root = F.lit(folder[: folder.index("/", folder.index("://") + 3)])  # scheme and authority
    return manifest.join(tasks, "part").withColumns({"start": start, "uri": F.concat(root, "path")}).drop("_before")


def read_sstables(manifest: DataFrame, derive: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, and what derive makes of a document's ids: a value per column of schema)."""
    full = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    more = manifest.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    full = pa.schema([*full, *to_arrow_schema(more.schema)])

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as source:
                    reader, rows = ShardReader(source), []
                    for doc_id, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.id_bytes}")
                        rows.append((doc_id, start, len(ids), *derive(ids)))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), full)], schema=full)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), full)], schema=full)

    n = manifest.count()
    tasks = max(1, min(n, max(manifest.sparkSession.sparkContext.defaultParallelism, n // 16)))
    return manifest.select("uri", "start").repartition(tasks).mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def crc_of(ids: np.ndarray) -> list:
    return [zlib.crc32(ids.astype("<u4").tobytes())]


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_sstables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_sstables(manifest, crc_of, "ids_crc32 long")
