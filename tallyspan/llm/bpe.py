"""BPE encoding and decoding with content-defined chunk reuse.

1. Texts are cut where a rolling hash of the last 32 bytes ends in zeros, so that a passage that several documents
   share is cut alike in each of them. Chunk digests are counted (each task counts its own first).
2. A document none of whose chunks is shared is encoded where it is read. Of the others, the runs between shared
   chunks are encoded where they are read, and a shared chunk is left as its digest.
3. Each shared chunk's text, once per task, is shuffled by digest and encoded once; a join brings the ids to the
   documents that hold it (one row per place, so that adaptive execution can split a hot chunk).
4. The pieces of a document are put together: at each join the text between the nearest sure word starts on both
   sides is encoded anew, further ones being taken until token borders agree on both sides.

Which chunks are shared is told to the tasks as a Bloom filter of at most BLOOM_BYTES, whatever the input: beyond
that size more unshared chunks take the path of the shared ones, with the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import table, written
from tallyspan.llm.word_codec import WordIds, byte_letters, id_type, load_tokenizer

#: A cut where the rolling hash has so many zero bits: chunks of some 2 ** CUT_BITS bytes, from LEAST to MOST.
CUT_BITS, LEAST, MOST = 10, 128, 16384
WINDOW = 32
BLOOM_BYTES, BLOOM_HASHES = 1 << 23, 4
#: Distinct chunk digests that a task counts before it sends them on.
COUNTED = 200_000
#: Rows handed to the tokenizer at a time, and characters.
BATCH_ROWS, BATCH_CHARS = 128, 1 << 20
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data, never inside a UTF-8 character; the last one is len(data)."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    step = 1
    while step < WINDOW:  # the sum of GEAR[b] << age over the last 2 * step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ends = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS) == 0) & ((raw[1:] & 0xC0) != 0x80)) + 1
    out, last, k = [], 0, 0
    while last < n:
        k = int(np.searchsorted(ends, last + LEAST))
        end = int(ends[k]) if k < len(ends) else n
        if end - last > MOST:
            end = last + MOST
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append(end)
        last = end
    return out


def chunks_of(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cut_points(data):
        yield data[start:end]
        start = end


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Codec:
    """A tokenizer file with its ids' bytes."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.words, self.dtype = WordIds(self.tokenizer, lower=False), id_type(self.tokenizer)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        letter = byte_letters()
        self.bytes_of = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(letter[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids. Between two characters that aren't white space, a space always starts a word, so texts
        without other spaces are encoded by such words, each distinct one once."""
        out: list[bytes] = [b""] * len(texts)
        plain = [n for n, text in enumerate(texts) if not _OTHER_SPACE.search(text) and not self.has_special.search(text)]
        words = [texts[n].split(" ") for n in plain]
        heads = self.words.library([ws[0] for ws in words])
        for n, head, rest in zip(plain, heads, self.words.of([ws[1:] for ws in words])):
            out[n] = head + rest
        others = sorted(set(range(len(texts))) - set(plain))
        for n, ids in zip(others, self.words.library([texts[n] for n in others])):
            out[n] = ids
        return [np.frombuffer(ids, self.dtype) for ids in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def join(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The ids of the text that the pieces spell, each of which is the encoding of its own text."""
        done: list[np.ndarray] = []
        left = pieces[0] if pieces else np.empty(0, self.dtype)
        for right in pieces[1:]:
            kept, left = self.mend(left, right)
            done.append(kept)
        return np.concatenate([*done, left]) if done else left

    def mend(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that stay as they are, and those that follow: the end of left encoded anew with right."""
        span = 16
        while True:
            whole = span >= len(left) and span >= len(right)
            a, b = left[-span:], right[:span]
            start, end = _sure_start(self.decode(a), last=True), _sure_start(self.decode(b), last=False)
            at = self._border(a, start, len(a) == len(left))
            to = self._border(b, end, len(b) == len(right), at_end=True)
            if at is not None and to is not None:
                text = self.decode(np.concatenate([a[at:], b[:to]])).decode()
                middle = self.encode([text])[0]
                return left[: len(left) - len(a) + at], np.concatenate([middle, right[to:]])
            if whole:
                raise AssertionError("a whole piece has a border at its end")
            span *= 4

    def _border(self, ids: np.ndarray, position: int, all_of_it: bool, at_end: bool = False) -> int | None:
        """Number of ids before the byte position if a token begins there; the outer end of the piece if it is wholly here."""
        if position >= 0:
            ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            k = int(np.searchsorted(ends, position))
            if ends[k] == position:
                return k
        return (len(ids) if at_end else 0) if all_of_it else None


#: A space at an end or beside white space: it need not start a word.
_OTHER_SPACE = re.compile(r"^ | $|\s | \s")
_SURE = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")


def _sure_start(data: bytes, last: bool) -> int:
    """A space between printable ASCII characters, where a word starts whatever comes before and after; -1 if none."""
    found = -1
    for m in _SURE.finditer(data):
        found = m.start()
        if not last:
            break
    return found


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _bloom_places(digests: np.ndarray, bits: int) -> np.ndarray:
    """For digests as rows of two uint64: BLOOM_HASHES bit numbers each."""
    k = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return (digests[:, :1] + k * (digests[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _count_chunks(batches):
    counts: Counter = Counter()
    send = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])
    for batch in batches:
        for text in batch.column(0):
            counts.update(map(digest, chunks_of((text.as_py() or "").encode())))
            if len(counts) > COUNTED:
                yield send()
                counts.clear()
    if counts:
        yield send()


def _set_bits(bits: int):
    """Each task's part of the Bloom filter, a row per 64 KB page that it touches."""

    def run(batches):
        pages: dict[int, np.ndarray] = {}
        page = 1 << 19
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            for p in np.unique(_bloom_places(np.frombuffer(raw, "<u8").reshape(-1, 2), bits)).tolist():
                pages.setdefault(p // page, np.zeros(page // 8, np.uint8))[p % page // 8] |= 1 << p % 8
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], ["page", "bits"])

    return run


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bloom filter (bytes) of the digests of chunks that occur twice or more."""
    counted = docs.select("text").mapInArrow(_count_chunks, "digest binary, n long")
    shared = written(counted.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"), "bpe-shared")
    n = shared.count()
    size = min(BLOOM_BYTES, max(1 << 16, 1 << (2 * n).bit_length()))
    out = np.zeros(size, np.uint8)
    page = (1 << 19) // 8
    # at most BLOOM_BYTES reach the driver: pages are or-ed on the executors
    pages = shared.mapInArrow(_set_bits(8 * size), "page long, bits binary").groupBy("page").applyInArrow(_or_pages, "page long, bits binary")
    for row in pages.toLocalIterator():
        out[row.page * page : (row.page + 1) * page] |= np.frombuffer(row.bits, np.uint8)
    return out


def _or_pages(rows: pa.Table) -> pa.Table:
    total = np.zeros((1 << 19) // 8, np.uint8)
    for x in rows.column("bits"):
        total |= np.frombuffer(x.as_py(), np.uint8)
    return pa.table({"page": rows.column("page")[:1], "bits": pa.array([total.tobytes()], pa.binary())})


#: A finish turns (codec, list of id arrays) into columns; schema says their names and types.
Finish = Callable[[Codec, list[np.ndarray]], list[pa.Array]]


def ids_and_text(code: Codec, many: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tolist() for x in many], pa.list_(pa.int32())), pa.array([code.decode(x).decode("utf-8", "replace") for x in many], pa.string())]


IDS_AND_TEXT = "ids array<int>, decoded string"


def digests(code: Codec, many: list[np.ndarray]) -> list[pa.Array]:
    """Number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded text."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return [
        pa.array([len(x) for x in many], pa.int64()),
        pa.array([sha(",".join(map(code.decimal.__getitem__, x.tolist())).encode()) for x in many], pa.string()),
        pa.array([sha(code.decode(x)) for x in many], pa.string()),
    ]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _first_pass(path: str, bloom, finish: Finish, names: list[str]):
    """From rows (rid, kept, text), rows of three kinds: a finished document (rid, kept, the finish's columns), a piece of
    one (rid, seq, ids or digest; the first also kept), a shared chunk (digest, chunk)."""

    def run(batches):
        code, bits = codec(path), bloom.value
        sent: set[bytes] = set()
        for batch in batches:
            for rows in _slices(batch):
                yield encode_rows(code, bits, sent, batch.schema.field("kept").type, *rows)

    def encode_rows(code, bits, sent, kept_type, rids, kept, texts):
        whole, plans, chunks, kept_of = [], [], [], dict(zip(rids, kept))
        for rid, text in zip(rids, texts):
            text = text or ""
            pieces = None if code.has_special.search(text) else _plan(text.encode(), bits)
            if pieces is None:
                whole.append((rid, text))
            else:
                plans += [(rid, seq, *p) for seq, p in enumerate(pieces)]
        for _, _, chunk, key in plans:
            if key is not None and key not in sent:
                if len(sent) > COUNTED:
                    sent.clear()
                sent.add(key)
                chunks.append((key, chunk))
        own = [p for p in plans if p[3] is None]
        encoded = code.encode([t for _, t in whole] + [p[2].decode() for p in own])
        done = finish(code, encoded[: len(whole)])
        ids = iter(encoded[len(whole) :])
        n, m, k = len(whole), len(plans), len(chunks)
        pad = lambda a, before, after: pa.concat_arrays([pa.nulls(before, a.type), a, pa.nulls(after, a.type)])
        columns = [
            pa.array(["done"] * n + ["piece"] * m + ["chunk"] * k, pa.string()),
            pa.array([r for r, _ in whole] + [p[0] for p in plans] + [None] * k, pa.int64()),
            pa.array([kept_of[r] for r, _ in whole] + [kept_of[p[0]] if p[1] == 0 else None for p in plans] + [None] * k, kept_type),
            pa.array([None] * n + [p[1] for p in plans] + [None] * k, pa.int32()),
            pa.array([None] * n + [next(ids).tobytes() if p[3] is None else None for p in plans] + [None] * k, pa.binary()),
            pa.array([None] * n + [p[3] for p in plans] + [c[0] for c in chunks], pa.binary()),
            pa.array([None] * (n + m) + [c[1].decode() for c in chunks], pa.string()),
            *(pad(a, 0, m + k) for a in done),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kind", "rid", "kept", "seq", "ids", "digest", "chunk", *names])

    return run


def _slices(batch: pa.RecordBatch):
    """The columns of a batch as lists of at most BATCH_ROWS rows and about BATCH_CHARS characters of the last column."""
    rows, size = [[] for _ in batch.columns], 0
    for k in range(batch.num_rows):
        values = [c[k].as_py() for c in batch.columns]
        for out, v in zip(rows, values):
            out.append(v)
        size += len(values[-1] or "")
        if len(rows[0]) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield rows
            rows, size = [[] for _ in batch.columns], 0
    if rows[0]:
        yield rows


def _plan(data: bytes, bits: np.ndarray) -> list[tuple[bytes, bytes | None]] | None:
    """Pieces (bytes, digest if it may be shared) of a text, unshared neighbours as one; None if none is shared."""
    chunks = list(chunks_of(data))
    if not chunks:
        return None
    keys = [digest(c) for c in chunks]
    places = _bloom_places(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), 8 * len(bits))
    shared = (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
    if not shared.any():
        return None
    out: list[tuple[bytes, bytes | None]] = []
    for chunk, key, is_shared in zip(chunks, keys, shared.tolist()):
        if not is_shared and out and out[-1][1] is None:
            out[-1] = (out[-1][0] + chunk, None)
        else:
            out.append((chunk, key if is_shared else None))
    return out


def _encode_distinct(path: str):
    """Rows (digest, chunk) sorted by digest: each digest encoded once."""

    def run(batches):
        code, last = codec(path), None
        for batch in batches:
            for keys, texts in _slices(batch):
                new = []
                for key, text in zip(keys, texts):
                    if key != last:
                        new.append((key, text))
                        last = key
                ids = code.encode([t for _, t in new])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.binary()), pa.array([x.tobytes() for x in ids], pa.binary())], ["digest", "found"])

    return run


def _assemble(path: str, finish: Finish, names: list[str]):
    """Rows (rid, seq, kept, ids) sorted by rid and seq: one finished row per rid."""

    def run(batches):
        code, kept_type = codec(path), None
        rid, kept, pieces, ready = None, None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ready], kept_type), *finish(code, [x for _, x in ready])], ["kept", *names])

        for batch in batches:
            kept_type = batch.schema.field("kept").type
            for r, seq, k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if r != rid and pieces:
                    ready.append((kept, code.join(pieces)))
                    pieces = []
                    if len(ready) >= BATCH_ROWS:
                        yield flush()
                        ready.clear()
                rid, kept = r, k if seq == 0 else kept
                pieces.append(np.frombuffer(ids, code.dtype))
        if pieces:
            ready.append((kept, code.join(pieces)))
        if ready:
            yield flush()

    return run


def encode_documents(docs: DataFrame, path: str, finish: Finish = ids_and_text, schema: str = IDS_AND_TEXT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns in keep, and what finish makes of its ids (by default ids and decoded text).

    The ids are those of the tokenizers library for the whole text, special tokens in it recognised, none added.
    A null text counts as empty: no ids. Every row is encoded on its own account, repeated ids and rows too; other
    columns are not read, whatever their names. An empty table gives no rows.
    path: a byte-level BPE file whose pre-tokenizer starts a word at a space between two printable characters.
    """
    spark = docs.sparkSession
    schema = ", ".join(f"out_{x}" for x in schema.split(", "))  # apart from the names used here
    names = [x.split()[0] for x in schema.split(", ")]
    final = ["kept.*", *(F.col(x).alias(x[4:]) for x in names)]
    bloom = spark.sparkContext.broadcast(shared_filter(docs))
    # a row's number, what is kept of it and its pieces are written in one go: they fit whatever is computed again later
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keep).alias("kept"), "text")
    kept_type = keyed.schema["kept"].dataType.simpleString()
    first = keyed.mapInArrow(_first_pass(path, bloom, finish, names), f"kind string, rid long, kept {kept_type}, seq int, ids binary, digest binary, chunk string, {schema}")
    first = written(first, "bpe-first", "kind")
    place = first.where("kind = 'piece'").select("rid", "seq", "kept", "ids", "digest")
    chunks = first.where("kind = 'chunk'").select("digest", "chunk").repartition("digest").sortWithinPartitions("digest")
    found = chunks.mapInArrow(_encode_distinct(path), "digest binary, found binary")
    borrowed = place.where("digest is not null").join(found, "digest").select("rid", "seq", "kept", F.col("found").alias("ids"))
    pieces = place.where("digest is null").drop("digest").unionByName(borrowed)
    joined = pieces.repartition("rid").sortWithinPartitions("rid", "seq").mapInArrow(_assemble(path, finish, names), f"kept {kept_type}, {schema}")
    return first.where("kind = 'done'").select(*final).unionByName(joined.select(*final))


def op4_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests, DIGESTS)
