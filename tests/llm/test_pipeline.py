import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspan.llm import registry
from tallyspan.llm.mixing import BLOCK_ROWS, EXPONENT, TOTAL
from tallyspan.llm.quality_rules import LEAST_LEFT_PERCENT
from tests.llm.test_mixing import plain_schedule
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_quality_rules import brute as measures_of
from tests.llm.test_quality_rules import brute_line

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        out.append((name, before, docs.collect(), docs.columns))
    return out


def cleaned(text):
    """What the quality rules leave of a text, in plain Python; None if it is rejected."""
    n_words, word_chars, *_, failed = measures_of(text)
    left = list(dict.fromkeys(x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and brute_line(x)))
    chars = len(re.sub(r"[\x20\x09-\x0D]", "", "".join(left)))
    return None if failed or 100 * chars < LEAST_LEFT_PERCENT * word_chars else "\n".join(left)


def test_stages_keep_what_they_should(stages):
    rules, exact, near, mixing, bpe = stages
    assert {r.doc_id: r.text for r in rules[2]} == {r.doc_id: clean for r in rules[1] if (clean := cleaned(r.text)) is not None}

    strip = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    best = {}
    for r in exact[1]:
        k = strip(r.text)
        if k not in best or (-len(r.text), r.doc_id) < best[k][0]:
            best[k] = ((-len(r.text), r.doc_id), r.doc_id)
    assert {r.doc_id for r in exact[2]} == {i for _, i in best.values()}

    sets = {r.doc_id: shingle_set(r.text, 5) for r in near[1]}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    assert {r.doc_id for r in near[2]} == {i for i, x in root.items() if i == x}

    assert sorted(r.doc_id for r in mixing[2]) == sorted(r.doc_id for r in mixing[1])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in bpe[1]}
    assert len(bpe[2]) == len(texts)
    for r in bpe[2]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def schedule(counts):
    """The source of every position, by the plain schedule with the default weights."""
    power = {s: n**EXPONENT for s, n in counts.items()}
    return plain_schedule(counts, {s: max(1, round(TOTAL * p / sum(power.values()))) for s, p in power.items()}, BLOCK_ROWS)


def test_the_result_has_the_order_of_the_mix(stages):
    got = sorted(stages[-1][2], key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    assert [r.source for r in got] == schedule(Counter(r.source for r in got))


def test_the_order_comes_from_the_mixing_stage(spark, docs):
    rows = docs(*[f"some text number {n}" for n in range(200)])
    near = corpus_pipeline.written(rows, "test")
    mixed = corpus_pipeline.written(corpus_pipeline.mixing_stage(spark, near, SF), "test")
    out = corpus_pipeline.written(corpus_pipeline.bpe_stage(spark, mixed, SF), "test")
    got = {r.doc_id: r.position for r in out.collect()}
    assert got == {r.doc_id: r.position for r in corpus_pipeline.mixing.mix(near).collect()}
    assert got != {r.doc_id: r.position for r in corpus_pipeline.bpe_stage(spark, near, SF).collect()}
    written = out.select("position", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r.position for r in sorted(written, key=lambda r: (r.file_name, r.row_index))] == list(range(200))


def test_columns(stages):
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, _, columns in stages[:-1])


def test_registry():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_take_nulls_repeats_and_other_columns(spark, docs, tmp_path):
    """Through all stages: null and empty texts, repeated ids and rows, columns with a dot or of the operators' names."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if not measures_of(r.text)[5]][:40]
    rows = docs(*enumerate(good), (3, good[5]), (3, good[3]), (None, good[7] + " and more"), (50, None), (51, ""))
    rows.withColumns({"a.b": F.lit(1), "row": F.lit("x"), "file": F.lit("y")}).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.position for r in out.collect()) == list(range(out.count()))
    assert 20 < out.count() <= 41
    rows.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
