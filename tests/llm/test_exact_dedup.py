import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import common
from tallyspan.llm import exact_dedup as module
from tallyspan.llm.exact_dedup import exact_dedup, exact_groups


def brute(rows):
    norm = {n: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for n, (_, t) in enumerate(rows)}
    groups = {}
    for n in norm:
        groups.setdefault(norm[n], []).append(n)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda n: (-len(rows[n][1] or ""), rows[n][0] is None, rows[n][0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[n][0], rows[best][0], len(members), sha) for n in members]
    return sorted(out, key=repr)


def check(docs, rows):
    found = exact_groups(docs(*rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == brute(rows)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_groups_of_all_depths(docs):
    random.seed(5)
    long = "".join(random.choice("abcdé") for _ in range(5000))
    rows = [long, long[:64], long[:63], long[:256], long + "x", long, " ".join(long), long[:1000] + "\n", long[:1000], None, "", " \t\n", "é" * 32, "é" * 33, "é" * 32]
    check(docs, list(enumerate(rows)))


def test_random_prefixes(docs):
    random.seed(9)
    base = "".join(random.choice("ab ") for _ in range(600))
    check(docs, [(n, base[: random.choice([10, 63, 64, 65, 200, 256, 257, 600])] + random.choice(["", "z", " "])) for n in range(60)])


def test_ties_repeats_nulls_and_extra_columns(docs, clashing):
    rows = [(5, "a b"), (3, "ab "), (3, "ab "), (None, "a b"), (None, None), (7, "q")]
    check(docs, rows)
    kept = exact_dedup(clashing(docs(*rows))).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == [(3, "ab "), (7, "q"), (None, None)]


def test_empty_table(docs):
    empty = docs("x").where("false")
    assert exact_groups(empty).count() == 0
    assert exact_dedup(empty).columns == empty.columns


def test_the_stage_keeps_one_row_of_each_group(docs, clashing):
    rows = clashing(docs((1, "a b"), (1, "a b"), (2, "ab"), (3, None), (4, ""), (5, "x" * 300_000), (6, "x" * 300_000 + " "), (None, "q"), (None, "q"), (7, "a  b")))
    got = exact_dedup(rows)
    assert got.columns == rows.columns
    assert sorted(((r.doc_id, len(r.text or "")) for r in got.collect()), key=str) == sorted([(7, 4), (3, 0), (6, 300_001), (None, 1)], key=str)
    assert exact_dedup(rows.where("false")).count() == 0


@pytest.mark.parametrize("most", [1 << 26, 8])
def test_texts_are_not_shuffled_and_a_full_filter_loses_nothing(spark, docs, monkeypatch, most):
    plans = {}

    def written(df, label, *partition_by, plain=module.written):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, label, *partition_by)

    monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(module, "MOST_SHARED_BITS", most, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(docs, [(n, f"text {n % 40} " + "word " * (n % 40)) for n in range(60)] + [(None, None), (70, " ")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plans["radix-runs"].splitlines() if "Join" in line]
    assert joins and all("strategy=broadcast" in line for line in joins)


def test_no_copy_of_the_texts_is_left_of_the_stage(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = exact_dedup(docs((1, "a b"), (2, "a  b"), (3, "c"), (3, "c"), (4, None), (None, "c")))
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["radix-kept", "radix-repeated"]
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == [(2, "a  b"), (3, "c"), (4, None)]


def test_shuffle_files_go_with_the_end_of_a_write(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disks.getAllFiles().mkString(" ")))
    before = files()
    out = module.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().hint("merge").join(spark.range(9), F.col("k") == F.col("id")), "test-shuffles")
    for _ in range(50):  # executors remove them in their own time
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7
