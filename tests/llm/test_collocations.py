import random
import re
from collections import Counter

import numpy as np

from tallyspan.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
        if words := [w for w in re.split("[ \t]+", piece) if w]:
            yield words


def brute(rows, max_words=3, threshold=10, top=2000, absorbed=50):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, own in rows:
            if (own or "und") == lang:
                for w in pieces(text):
                    f.update(tuple(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        scored = []
        for p, a in found.items():
            if any(inside(p, q) and 100 * b >= absorbed * a for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(n, seed, words=12):
    rng = random.Random(seed)
    letters = ["a", "B", "b", "É", "жук", "x\x1cy", "c", "d", "e", "New", "York", "city"][:words]
    return ["".join(rng.choice(letters) + rng.choice([" ", " ", " ", "\t", ", ", "\n", ".", "  "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def mined(frame, **how):
    return sorted(tuple(r) for r in C.collocations(frame, **how).collect())


def test_phrases_equal_plain_python(spark):
    rows = [(t, [None, "en", "fr", "und"][n % 4]) for n, t in enumerate(texts(200, 1))] + [(None, "en"), ("", None), ("...", "de")]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA).repartition(3)
    got = mined(frame)
    assert got == brute(rows) and len(got) > 50
    assert mined(frame, threshold=4, top=7, absorbed=80) == brute(rows, threshold=4, top=7, absorbed=80)
    assert mined(frame, max_words=4, threshold=3) == brute(rows, max_words=4, threshold=3)


def test_small_segments_and_blocks_change_nothing(spark):
    """Texts cut into blocks of a few words, segments of a few words, in the function that the tasks run."""
    rows = [(t, "en") for t in texts(30, 2)] + [("wordlongerthanablock " * 30 + "a b c", "en")]
    want = Counter(tuple(w[i : i + k]) for t, _ in rows for w in pieces(t) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["text", "lang"])
    before = C.SEGMENT_WORDS, C.BLOCK_BYTES
    for C.SEGMENT_WORDS, C.BLOCK_BYTES in ((5, 16), (1, 8), (50, 1 << 20)):
        got = Counter()
        for group in C.segments([batch], 3):
            for s in group:
                s.close()
                for order, (at, keys) in enumerate(s.keys(3), 1):
                    assert len(at) == len(keys)
                    for phrase, n in s.counted(at, order):
                        got[tuple(phrase.split(" "))] += n
        assert got == want
    C.SEGMENT_WORDS, C.BLOCK_BYTES = before


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(4)
    for trial in range(30):
        stream = np.concatenate([rng.integers(0, 2**63, 20_000, dtype=np.uint64), np.repeat(rng.integers(0, 2**63, 300, dtype=np.uint64), 10)])
        rng.shuffle(stream)
        summary = C.Summary(len(stream) // 10 + 1)
        for chunk in np.array_split(stream, 1 + trial):
            summary.add(*(x.astype(t) for x, t in zip(np.unique(chunk, return_counts=True), (np.uint64, np.int64))))
        keys, counts = np.unique(stream, return_counts=True)
        kept = summary.frequent(10)
        assert set(keys[counts >= 10].tolist()) <= set(kept.tolist())
        assert len(summary.keys) <= summary.capacity and summary.lost < 10
        assert len(kept) < len(keys) / 2


def test_keys_survive_packing_and_the_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 2**31, len(keys))
    back = C.unpacked(*C.packed(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    parts = [keys[C.part_of(keys, 7) == p] for p in range(7)]
    assert sum(map(len, parts)) == len(keys)
    frame = spark.createDataFrame([(len(p), bytearray(p.tobytes())) for p in parts], "n long, keys binary")
    bits = C.survivor_filter(frame)
    page, places = C._places(keys, bits.size * 8)
    inside = lambda page, places: np.all([(bits[page, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1) == 1 for p in places], axis=0)
    assert inside(page, places).all()
    other = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert inside(*C._places(other, bits.size * 8)).mean() < 0.01


def test_a_phrase_inside_a_longer_one_is_dropped_even_by_a_dropped_one(spark):
    rows = [("new york city", "en")] * 12 + [("new york", "en")] * 5 + [("york city hall", "en")] * 11
    got = mined(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA))
    assert got == brute(rows)
    assert {g[2] for g in got} == {"new york city", "york city hall"}


def test_edge_cases(spark, clashing):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(None, None, None)], SCHEMA)) == []
    rows = [("a b " * 20_000, None)] + [("A B", "und")] * 3
    frame = clashing(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)).withColumns({"phrase": C.F.lit(1), "a.b": C.F.lit(1)})
    assert mined(frame) == brute(rows)
