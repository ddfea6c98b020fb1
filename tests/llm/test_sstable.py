import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from tallyspan.llm.sstable import ShardReader, ShardWriter, WordCodec, crc_of, id_of, key_of, read_sstables, write_sstables

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_equal_the_library(library):
    random.seed(2)
    code = WordCodec(PATH, 1)
    parts = ["a", "b", " ", "\n", "'s", "'", "é", "é", "日本", "1", "!", " the,", "\x85", "\xa0", "　", "\x1c", "İ", "Σ", "Éa", "<|endoftext|>", "́", "﻿", "ARE;", "..."]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(code.encode([text])[0], code.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_lookup_and_damage():
    out = io.BytesIO()
    writer = ShardWriter(out, 2)
    rows = [(None, b"zz")] + [(i, bytes([i % 256, 0]) * (i % 700)) for i in sorted([*range(-300, 2000, 3), 300, 300])]
    for i, v in rows:
        writer.add(i, v)
    writer.finish()
    reader = ShardReader(Source(out.getvalue()))
    assert list(reader) == rows
    assert reader.blocks > 5
    for i in [None, -300, 0, 300, 1998, -299, 5000]:
        assert reader.get(i) == [v for k, v in rows if k == i]
    hurt = bytearray(out.getvalue())
    hurt[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(ShardReader(Source(bytes(hurt))))
    assert [id_of(key_of(i)) for i in (None, -(2**63), 0, 2**63 - 1)] == [None, -(2**63), 0, 2**63 - 1]


def test_documents(docs, clashing, library):
    texts = [(9, "Hello there, World."), (2, None), (-4, ""), (9, "again"), (None, "no id"), (5, "x y\x1cz <|endoftext|>"), (7, "ab, " * 30_000)]
    manifest = write_sstables(clashing(docs(*texts)), PATH)
    got = read_sstables(manifest, crc_of, "ids_crc32 long").orderBy("start").collect()
    start = 0
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    uri = manifest.first().uri
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    assert fs.get_file_info(name).size > 0


def test_empty_table(docs):
    manifest = write_sstables(docs("x").where("false"), PATH)
    assert read_sstables(manifest, crc_of, "ids_crc32 long").count() == 0
