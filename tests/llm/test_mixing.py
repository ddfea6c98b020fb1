import random
from bisect import bisect_left
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyspan.llm.mixing import mix, mixed_documents, period


def shares(v, blocks, weights):
    """Blocks that each source has had by virtual time v in a schedule without rounding."""
    return {s: min(Fraction(n), v * weights[s]) for s, n in blocks.items()}


def slot_of(v, blocks, weights):
    return sum(shares(v, blocks, weights).values())


def test_every_prefix_of_a_period_is_within_one_block():
    random.seed(1)
    for _ in range(100):
        weights = [random.randint(1, 15) for _ in range(random.randint(1, 7))]
        total, seen = sum(weights), Counter()
        for slot, (source, block) in enumerate(period(weights)):
            assert block == seen[source]
            seen[source] += 1
            assert all(abs(seen[s] - Fraction((slot + 1) * w, total)) < 1 for s, w in enumerate(weights))
        assert seen == Counter(dict(enumerate(weights)))


def test_a_period_in_which_sources_end_places_every_block_in_its_window():
    random.seed(2)
    for _ in range(200):
        weights = {s: random.randint(1, 9) for s in range(random.randint(1, 6))}
        blocks = {s: random.randint(0, w) for s, w in weights.items()}
        got = period(list(weights.values()), list(blocks.values()))
        assert sorted(got) == [(s, k) for s, n in blocks.items() for k in range(n)]
        for slot, (s, k) in enumerate(got):
            assert slot_of(Fraction(k, weights[s]), blocks, weights) // 1 <= slot < -(-slot_of(Fraction(k + 1, weights[s]), blocks, weights) // 1)


def test_rows_take_all_positions_and_keep_their_share(docs, clashing):
    rows = docs(*[f"text {n}" for n in range(400)])
    got = sorted(mix(clashing(rows), {"s0": 3, "s1": 1}, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(400))
    assert sorted(r.doc_id for r in got) == list(range(400))
    first = [r for r in got if r.phase == 0]
    seen = Counter()
    for n, r in enumerate(first, 1):
        seen[r.source] += 1
        assert abs(seen["s0"] - 0.75 * n) < 4 * 2  # blocks are whole: one block's deviation, and the one under way
    assert {r.source for r in got if r.phase == 1} == {"s1"}


def test_documents_come_in_the_order_of_the_mix(docs):
    rows = docs(*[(n % 90, f"text {n}") for n in range(100)], (None, None))
    out = mixed_documents(rows)
    assert out.columns == rows.columns
    got = [r.doc_id for r in out.collect()]
    assert Counter(got) == Counter([n % 90 for n in range(100)] + [None])
    want = [r.doc_id for r in sorted(mix(rows).collect(), key=lambda r: r.position)]
    assert [x for x in got if got.count(x) == 1] == [x for x in want if want.count(x) == 1]


def test_null_sources_empty_tables_and_bad_weights(spark, docs):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (None, "a")], "doc_id long, source string")
    assert sorted(r.position for r in mix(rows, {None: 1, "a": 2}).collect()) == [0, 1, 2, 3]
    assert mix(docs("x").where("false")).count() == 0
    assert mixed_documents(docs("x").where("false")).count() == 0
    with pytest.raises(ValueError, match="without a positive weight"):
        mix(rows, {"a": 1})
    assert {r.source: r.weight for r in mix(rows).collect()} == {None: 500, "a": 500}


def plain_schedule(counts, weights, block_rows):
    """The source of every position: of all blocks, slot by slot, the released one with the earliest deadline, by fractions."""
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    windows, out, left = {}, [], dict(counts)
    for s, n in blocks.items():
        at = [slot_of(Fraction(k, weights[s]), blocks, weights) for k in range(n + 1)]
        windows[s] = [(at[k] // 1, -(-at[k + 1] // 1)) for k in range(n)]
    done = dict.fromkeys(blocks, 0)
    for slot in range(sum(blocks.values())):
        ready = [s for s, n in blocks.items() if done[s] < n and windows[s][done[s]][0] <= slot]
        source = min(ready, key=lambda s: (windows[s][done[s]][1], s))
        assert slot < windows[source][done[source]][1]
        done[source] += 1
        take = min(block_rows, left[source])
        out += [source] * take
        left[source] -= take
    return out


def test_rows_follow_the_plain_schedule(spark, monkeypatch):
    """Sources of very different size, many buckets and strides: the source at each position, and each row once."""
    monkeypatch.setattr("tallyspan.llm.mixing.BUCKET_ROWS", 7)
    monkeypatch.setattr("tallyspan.llm.mixing.STRIDE", 3)
    counts = {"a": 901, "b": 77, "c": 5, "d": 16}
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    rows = [(n, s) for n, s in enumerate(s for s, c in counts.items() for _ in range(c))]
    got = sorted(mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(5), weights, 8).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted((r.doc_id, r.source) for r in got) == rows
    assert [r.source for r in got] == plain_schedule(counts, weights, 8)


def test_many_sources_of_any_weight(spark):
    """5,000 sources, each with an end of its own: all positions taken, every prefix within one block of the shares."""
    random.seed(3)
    counts = {f"s{n:04}": random.randint(1, 9) for n in range(5_000)}
    weights = {s: random.randint(1, 20) for s in counts}
    rows = [(n, s) for n, s in enumerate(s for s, c in counts.items() for _ in range(c))]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(8), weights, 1).select("doc_id", "source", "position", "slot", "phase").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert sorted((r.doc_id, r.source) for r in got) == rows
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    # each row in its window: floor(T(k / w)) <= slot < ceil(T((k + 1) / w)), T by sums over the sources' ends
    ends = sorted((Fraction(n, weights[s]), n, weights[s]) for s, n in counts.items())
    at, had, live = [e for e, _, _ in ends], [0], [sum(weights.values())]
    for _, n, w in ends:
        had.append(had[-1] + n)
        live.append(live[-1] - w)

    def slot_at(v):
        i = bisect_left(at, v)
        return had[i] + live[i] * v

    seen = Counter()
    for slot, s in enumerate(order):
        assert slot_at(Fraction(seen[s], weights[s])) // 1 <= slot < -(-slot_at(Fraction(seen[s] + 1, weights[s])) // 1)
        seen[s] += 1
    last = {s: slot for slot, s in enumerate(order)}
    ended = sorted(last.values())
    assert all(r.phase == bisect_left(ended, r.slot) for r in got)


def test_weights_of_any_size_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr("tallyspan.llm.mixing.SPAN", 7)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = sorted(mix(rows, {"a": 1, "b": 3}, 2).collect(), key=lambda r: r.position)
    assert [r.source for r in got] == plain_schedule({"a": 1000, "b": 2000}, {"a": 1, "b": 3}, 2)
    got = sorted(mix(rows, {"a": 20_000, "b": 30_001}, 2).collect(), key=lambda r: r.position)
    assert [r.source for r in got] == plain_schedule({"a": 1000, "b": 2000}, {"a": 20_000, "b": 30_001}, 2)
