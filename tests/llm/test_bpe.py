import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspan.llm.bpe import DIGESTS, chunks_of, codec, digests, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def prose(n, seed):
    random.seed(seed)
    return " ".join(random.choice(["the", "House,", "river", "d'été", "don't", "42", "\nNew", "über", "x"]) for _ in range(n))


def test_joins_are_repaired_exactly(library):
    random.seed(3)
    code = codec(PATH)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "日本", "1", "!", " the", " of", "\t", "ing", " ", "<|endof", "text|>"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 60)))
        if "<|endoftext|>" in text:
            continue
        cuts = sorted(random.sample(range(len(text) + 1), min(len(text), random.randint(0, 4))))
        pieces = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)]) if i < j]
        assert code.join(code.encode(pieces)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_follow_content():
    shared = prose(3000, 1)
    a = set(chunks_of((prose(50, 2) + shared).encode()))
    b = set(chunks_of((prose(70, 3) + shared).encode()))
    assert len(a & b) > len(a) / 2
    for data in (b"", b"a", b"a" * 50_000, ("é" * 30_000).encode(), shared.encode()):
        assert b"".join(chunks_of(data)) == data
        assert all(c.decode() for c in chunks_of(data))


def test_documents_equal_the_library(docs, clashing, library):
    shared = prose(2000, 5)
    texts = [None, "", " ", shared, "x" + shared, "  " + shared + "\n", prose(900, 6) + shared, shared + shared, "a<|endoftext|>b " + shared, "日本語" * 4000, "a" * 40_000, prose(20_000, 7), shared]
    got = {r.doc_id: r for r in encode_documents(clashing(docs(*texts)), PATH).collect()}
    sums = {r.doc_id: r for r in encode_documents(docs(*texts), PATH, digests, DIGESTS).collect()}
    for n, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(got[n].ids) == ids
        assert got[n].decoded == decoded
        assert (sums[n].n_tokens, sums[n].ids_sha256, sums[n].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_repeated_rows_and_empty_table(docs):
    rows = encode_documents(docs((1, "a b"), (1, "a b"), (None, "c")), PATH, digests, DIGESTS).collect()
    assert len(rows) == 3
    assert encode_documents(docs("x").where("false"), PATH).count() == 0
