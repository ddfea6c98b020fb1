import random

import numpy as np
from pyspark.sql import functions as F

from tallyspan.llm import common, ngram_join
from tallyspan.llm.ngram_join import near_components, one_of_each, prefix_length


def shingle_set(text, size=4):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(rows, size=4, percent=85):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(sets[n]), least[find(n)]) for n, (i, _) in enumerate(rows))


def check(frame, rows):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_components(frame).collect()) == brute(rows)


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_chains_and_edges(docs, clashing):
    random.seed(11)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    rows = [edited(base, random.choice([0, 1, 2, 3, 5, 8])) for _ in range(40)]
    chain = [f"c{n}" for n in range(160)]
    rows += [" ".join(chain[k : k + 100]) for k in range(0, 60, 4)]  # each links to the next, the ends do not
    common = " ".join(f"p{n}" for n in range(60))
    rows += [common + " " + " ".join(f"d{d}x{n}" for n in range(100)) for d in range(25)]
    rows += [None, "", " \n", "a b", "A  B", "a b c", "a b c d", "a b c d e", " ".join(base).upper(), " ".join(base)]
    order = random.sample(range(len(rows)), len(rows))
    pairs = [(i * 3 - 50, t) for i, t in zip(order, rows)]
    check(clashing(docs(*pairs)), pairs)
    near = near_components(docs(*pairs), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near) == brute(pairs, 5, 80)


def test_sets_of_different_size_whose_shared_shingles_are_rare_or_common(docs):
    random.seed(5)
    rows = []
    for k in range(80):
        short = [f"x{k}y{n}" for n in range(random.randint(84, 95))]
        longer = short + [f"x{k}z{n}" for n in range(100 - len(short))]
        rows += [" ".join(short), " ".join(longer)]  # one set holds the other
    for k in range(12):
        # what two texts share, 40 more that are no near copies have too: their own shingles come first
        shared = [f"b{k}y{n}" for n in range(88)]
        rows += [" ".join(shared + [f"b{k}own{n}" for n in range(12)]), " ".join(shared + [f"b{k}two{n}" for n in range(2)])]
        rows += [" ".join(shared + [f"b{k}far{d}x{n}" for n in range(90)]) for d in range(40)]
    pairs = list(enumerate(rows))
    check(docs(*pairs), pairs)


def test_repeated_rows_and_empty_table(docs):
    pairs = [(4, "x y z w"), (4, "x y z w"), (9, "x y z w"), (9, "other words are here now")]
    check(docs(*pairs), pairs)
    assert sorted(r.doc_id for r in one_of_each(docs(*pairs)).collect()) == [4, 4, 9, 9]
    empty = docs("x").where("false")
    assert near_components(empty).count() == 0
    assert one_of_each(empty).columns == empty.columns


def test_null_ids(docs):
    got = near_components(docs((None, "one two three four five"), (3, "one two three four five"), (None, "alone here and now"))).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 3), (3, 3), (None, None)], key=str)


def test_prefixes_hold_a_common_shingle():
    for n in range(1, 300):
        for m in range(n, 300):
            if 100 * n >= 85 * m:
                least = -(-85 * (n + m) // 185)
                assert prefix_length(n) > n - least
                assert prefix_length(m) > m - least


def near_group(n):
    """Copies of a text that is not among them, with two edits each: most are no near copies of one another."""
    base = [f"w{random.randrange(10**6)}" for _ in range(100)]
    return [(k, edited(base, 2)) for k in range(n)]


def test_a_large_group_of_borderline_copies(docs, monkeypatch):
    """Exact, and what is multiplied grows with the group, not with its square."""
    made, checked = [], ngram_join._checked

    def counted(documents, classes, pairs, *rest):
        made.append(pairs.count())
        return checked(documents, classes, pairs, *rest)

    monkeypatch.setattr(ngram_join, "_checked", counted)
    sums = []
    for n in (200, 400):
        random.seed(23)
        pairs = near_group(n)
        made.clear()
        check(docs(*pairs), pairs)
        sums.append(sum(made))
        assert sum(made) < 2 * n
    print("pairs", sums)


def test_components_are_multiplied_with_others_only(docs, monkeypatch):
    """Hundreds of copies of one text link with it; what is left to the last product are few pairs."""
    random.seed(29)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    pairs = [(k, edited(base, random.choice([0, 1, 1, 2, 3, 4, 5]))) for k in range(300)]
    across = ngram_join._pairs_across
    made = []

    def counted(*args):
        made.append(across(*args).count())
        return across(*args)

    monkeypatch.setattr(ngram_join, "_pairs_across", counted)
    check(docs(*pairs), pairs)
    assert made[0] < 300


def test_parities_never_differ_more_than_the_sets(spark):
    random.seed(3)
    rows = []
    for _ in range(60):
        n = random.choice([5, 90, 600, 1500])
        one = np.array(sorted(random.sample(range(2**60), n)), np.uint64)
        two = np.array(sorted({*one[: random.randrange(n)].tolist(), *random.sample(range(2**60), random.randrange(1, 3 * n))}), np.uint64)
        least = len(set(one.tolist()) ^ set(two.tolist()))
        rows.append((ngram_join.parity(one).tolist(), ngram_join.parity(two).tolist(), least))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>, least int")
    words = F.least(F.size("x"), F.size("y"))
    folded = frame.select("x", "y", "least", ngram_join.folded(F.col("x"), words).alias("fx"), ngram_join.folded(F.col("y"), words).alias("fy")).collect()
    for r in folded:
        assert len(r.fx) == len(r.fy) and (r.fx == r.x or len(r.x) > len(r.y))
        differ = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) + 2**64).bit_count() for a, b in zip(r.fx, r.fy))
        assert differ <= r.least and (differ - r.least) % 2 == 0


def test_one_row_of_each_component_stays_where_ids_repeat(docs):
    base = " ".join(f"w{n}" for n in range(60))
    rows = docs((1, base), (5, base + " extra"), (5, "another text of its own with words"), (7, base + " extra"), (7, base + " extra"), (8, None), (8, ""), (8, None), (None, "yet another text with words of its own"), (9, "repeated words stay once"), (9, "repeated words stay once"))
    named = rows.withColumn("a.b", F.lit(1))
    got = one_of_each(named)
    assert got.columns == named.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("1", base), ("5", "another text of its own with words"), ("8", ""), ("8", ""), ("None", "yet another text with words of its own"), ("9", "repeated words stay once")])
    assert one_of_each(named.where("false")).count() == 0


def test_sets_are_shuffled_once_to_meet_their_classes(spark, docs, monkeypatch):
    from tallyspan.llm import ngram_join as module

    plans = []

    def written(df, label, *partition_by, plain=module.written):
        if label == "join-sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label, *partition_by)

    monkeypatch.setattr(module, "written", written)
    base = [f"w{n}" for n in range(60)]
    got = near_components(docs((3, " ".join(base)), (5, " ".join([*base, "more"])), (8, "something else is here")), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (8, 8)]
    assert plans and not any("hashpartitioning(node" in plan for plan in plans)


def test_parities_are_shuffled_once_for_both_sides(spark):
    rows = [(k, 90, ngram_join.parity(np.arange(k, k + 90, dtype=np.uint64)).tolist()) for k in range(0, 400, 5)]
    marks = ngram_join.written(spark.createDataFrame(rows, "rid long, n long, parity array<long>"), "test-marks")
    pairs = spark.createDataFrame([(k, k + step) for k in range(0, 300, 5) for step in (5, 50)], "a long, b long")
    found = ngram_join._alike(pairs, marks.select(F.col("rid").alias("node"), "n", "parity"), 85)
    assert sorted((r.a, r.b) for r in found.collect()) == [(k, k + 5) for k in range(0, 300, 5)]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_columns_are_gathered_once_a_round_that_found_links(docs, monkeypatch):
    base = [f"w{n}" for n in range(60)]
    made, several = [], ngram_join._several
    monkeypatch.setattr(ngram_join, "_several", lambda *args: made.append(1) or several(*args))
    apart = [(k, " ".join([*base[:10], *(f"d{k}x{n}" for n in range(60))])) for k in range(4)]
    check(docs(*apart), apart)
    assert not made  # no round found a link
    near = [*apart, (7, " ".join(base)), (9, " ".join([*base, "more"]))]
    check(docs(*near), near)
    assert 1 <= len(made) <= ngram_join.HUB_ROUNDS


def test_few_sets_are_worked_out_that_no_pair_wants(spark):
    bits = ngram_join._wanted_filter(spark.range(3000).withColumnRenamed("id", "doc_id"), 3000)
    passes = lambda k: bool(bits[(p := ngram_join._place(k, 8 * len(bits))) >> 3] >> (p & 7) & 1)
    assert all(map(passes, range(3000)))
    assert sum(map(passes, range(10**6, 10**6 + 20000))) < 0.02 * 20000


def test_the_last_product_in_passes_finds_the_same(docs, monkeypatch):
    """Columns in passes: each is multiplied once, and what the passes counted of a pair is added up."""
    random.seed(7)
    rows = []
    for k in range(6):
        shared = [f"b{k}y{n}" for n in range(88)]
        rows += [" ".join(shared + [f"b{k}own{n}" for n in range(12)]), " ".join(shared + [f"b{k}two{n}" for n in range(2)])]
        rows += [" ".join(shared + [f"b{k}far{d}x{n}" for n in range(90)]) for d in range(8)]
    pairs, made = list(enumerate(rows)), []
    monkeypatch.setattr(ngram_join, "written", lambda df, label, *by, plain=ngram_join.written: made.append(label) or plain(df, label, *by))
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    for most, passes in ((10**6, 1), (16, 3)):
        monkeypatch.setattr(ngram_join, "BLOCKS_A_CLASS", most)
        made.clear()
        check(docs(*pairs), pairs)
        assert made.count("join-met") == passes


def test_only_the_ids_that_stay_are_left_of_the_stage(docs, tmp_path, monkeypatch):
    """Neither sets nor columns outlive the stage."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    random.seed(23)
    pairs = near_group(40)
    rows = one_of_each(docs(*pairs))
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["join-kept", "join-repeated"]
    assert sorted(r.doc_id for r in rows.collect()) == sorted({least for _, _, least in brute(pairs, 5, 80)})
