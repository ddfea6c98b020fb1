import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, window=(30, 90), every=100):
    """Rows (vec_id, embedding, label) in order; repeated ids are rows of their own."""
    fine = [(i, [math.floor(256 * x) for x in e], la) for i, e, la in rows if i is not None and la is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (a, v, la) in enumerate(fine):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lb) for m, (i, w, lb) in enumerate(fine) if m != n]
        scored.sort(key=lambda s: s[:2])
        for s, p, _ in [s for s in scored if s[2] == la][:positives]:
            near = [(i, -t) for t, i, lb in scored if lb != la and window[0] * -s <= -100 * t <= window[1] * -s][:negatives]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(near, 1)]
    return sorted(out)


def mined(frame, **how):
    return sorted(tuple(r) for r in H.hard_negatives(frame, **how).collect())


def vectors(n, dim, seed, labels=4):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(labels)]
    as_float = lambda x: float(np.float32(x))
    return [(i, [as_float(m + rng.gauss(0, 0.4) + 0.3) for m in middle[i % labels]], i % labels) for i in range(n)]


def test_strassen_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    for leaf in (2, 5, 16):
        monkeypatch.setattr(H, "LEAF", leaf)
        for _ in range(60):
            n, k, m = rng.integers(1, 50, 3)
            a, b = rng.integers(-(2**27), 2**27, (n, k)), rng.integers(-(2**27), 2**27, (k, m))
            assert (H.strassen(a, b) == a @ b).all()
    big = np.full((40, 40), 2**28)  # sums on the way leave 64 bits, scores don't
    assert (H.strassen(big, big) == 40 * 2**56).all()


def test_negatives_equal_plain_python(spark, monkeypatch):
    for name, value in {"GROUP": 3, "SLICES": 4, "TILE": 16, "ANCHOR_TILE": 2, "LEAF": 4}.items():  # many groups, cells and tiles
        monkeypatch.setattr(H, name, value)
    rows = vectors(700, 9, 3)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows) and len(got) > 100


def test_ties_go_to_smaller_ids(spark):
    rows = [(100, [1.0, 0.0], 1), *((n, [1.0, 0.0], 1) for n in (9, 3, 7, 2, 5, 11)), *((n, [0.5, 0.5], 2) for n in range(12, 40))]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows)
    assert [g[1] for g in got if g[2] == 1] == [2, 3, 5, 7, 9] and [g[3] for g in got[:10]] == list(range(12, 22))


def test_edge_cases(spark):
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 0.9], 1), (1, [0.9, 1.0], 1), (2, [0.5, 0.4], 2), (2, [0.5, 0.4], 2), (3, [0.6], 2), (4, [], 2), (5, [0.1, float("nan")], 2), (6, [float("inf"), 0.0], 2), (7, [None, 1.0], 2),
        (8, None, 2), (9, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (200, [-1.0, -1.0], 3), (300, [0.3, 0.3], 9),
    ]
    rows = [(i, e and [x if x is None else float(np.float32(x)) for x in e], la) for i, e, la in rows]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    padded = [(i, e if e is None else e + [0.0] * (2 - len(e)), la) for i, e, la in rows]
    assert mined(frame.withColumns({"rid": F.lit("x"), "base": F.lit("x"), "a.b": F.lit(1)})) == brute(padded)
    assert mined(frame.limit(0)) == []
    huge = spark.createDataFrame([(0, [1e18, 1e18], 1), (1, [1e18, 1.0], 1)], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        H.hard_negatives(huge)


def test_other_anchors_and_windows(spark):
    rows = vectors(120, 5, 8, labels=3)
    got = mined(spark.createDataFrame(rows, SCHEMA), anchor=F.col("vec_id") % 10 == 0, positives=2, negatives=3, window=(50, 100))
    assert got == brute(rows, 2, 3, (50, 100), 10) and got


def test_what_cells_hand_on_does_not_grow_with_the_rows(spark):
    small, large = (spark.createDataFrame(vectors(n, 4, 1), SCHEMA) for n in (400, 1600))
    counts = []
    for frame in (small, large):
        rows = H.usable(frame)
        anchors = rows.where("vec_id < 400 and vec_id % 100 = 0").withColumn("bases", F.array(F.lit(0).cast("long")))
        counts.append(H._mined(anchors, rows, 4, 4, 1, 5).count())
    assert counts[0] == counts[1] == 20


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in H.op12_hard_negatives(spark, sf).collect()) == brute(rows)
