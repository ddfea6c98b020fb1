import random

import numpy as np
import pytest

from tallyspan.llm import language_id as L

WORDS = {"en": "the and of to house river with over that small green".split(), "de": "der und die haus fluß mit über das klein grün schön".split(), "fr": "le et la maison rivière avec sur que petite verte été".split()}


def text(lang, n, seed):
    random.seed(f"{lang}{seed}")
    return " ".join(random.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, text(lang, 60, n), lang) for n in range(60) for lang in WORDS] + [(900, None, "en"), (901, "words", None)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy_and_rejection(found):
    langs, share, bits, rejected = found.predict([text(lang, 30, 1000 + n) for n in range(20) for lang in WORDS])
    assert langs == list(WORDS) * 20
    assert all(0.9 < s <= 1 for s in share)
    assert sum(rejected) <= 3
    assert found.predict(["zxq jwv kqz xxjq wvvk qzzj"])[3] == [True]


def test_probabilities_sum_to_one(found):
    """Over the characters that the model has seen and the thousand it keeps a share for."""
    model = found.models[0]
    seen = sorted(set("".join(WORDS["de"]) + " "))
    for context in ("  t", "die", "qqq"):
        p = 2.0 ** model.log2(np.array([[*map(ord, context), ord(c)] for c in [*seen, "ж"]], np.uint32))
        assert abs(p[:-1].sum() + 1000 * p[-1] - 1) < 1e-6
        assert (p > 0).all()


def plain_kneser_ney(texts, order=L.ORDER):
    """log2 P(character | those before it) from dictionaries, by the book."""
    from collections import Counter, defaultdict

    runs = Counter()
    for t in texts:
        c = "".join(chr(x) for x in L.symbols(t))
        c = " " * (order - 1) + c
        runs.update(c[k : k + order] for k in range(len(c) - order + 1))
    levels = {order: runs}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(x[1:] for x in levels[n + 1])
    discount, total, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for n, counts in levels.items():
        ones, twos = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for x, v in counts.items():
            total[n][x[:-1]] += v
            kinds[n][x[:-1]] += 1

    def p(run):
        n = len(run)
        if n == 0:
            return 1 / (len(levels[1]) + 1000)
        lower, context = p(run[1:]), run[:-1]
        if not total[n][context]:
            return lower
        return (max(levels[n][run] - discount[n], 0) + discount[n] * kinds[n][context] * lower) / total[n][context]

    return lambda run: np.log2(p(run))


def test_models_equal_plain_dictionaries(spark):
    texts = [text("fr", 50, n) for n in range(9)]  # fewer than ten documents: all train
    found = L.fit(spark.createDataFrame([(n, t, "fr") for n, t in enumerate(texts)], "doc_id long, text string, lang string"))
    plain = plain_kneser_ney(texts)
    unseen = text("fr", 40, 99) + " quelque chose d’autre: été, jamais vu"
    chars = "   " + "".join(chr(x) for x in L.symbols(unseen))
    runs = [chars[k : k + 4] for k in range(len(chars) - 3)]
    want = [plain(r) for r in runs]
    got = found.models[0].log2(np.array([[ord(c) for c in r] for r in runs], np.uint32))
    assert np.allclose(got, want)
    assert np.allclose(found.entropies([unseen])[0, 0], -np.mean(want))


def test_rows(docs, clashing, found):
    rows = clashing(docs((1, None), (2, ""), (3, "12 !?"), (4, "the house"), (4, "the house"), (None, "das haus"), (6, "la maison " * 30_000)))
    got = L.identify(rows, found).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "fr")], key=str)
    assert all(0 <= r.score <= 1 for r in got)
    assert L.identify(rows.where("false"), found).count() == 0


def test_no_language_is_lost(spark):
    """However many there are, with one document each, or with one text that is longer than all others together."""
    single = [(n, f"only text of language number {n}", f"l{n:03}") for n in range(80)]
    uneven = [(1000 + n, "die " * 600_000 if n % 6 == 0 else text("de", 20, n), f"u{n // 6}") for n in range(30)]
    found = L.fit(spark.createDataFrame(single + uneven, "doc_id long, text string, lang string").repartition(8))
    assert found.languages == sorted({lang for _, _, lang in single + uneven})
    grün = L.symbols("grün")
    for model in found.models[-5:]:  # the short texts train too, and the long one does not fill the sample
        assert L.codes(grün, 4)[0] in model.levels[0][0].keys
        assert model.levels[0][0].values.sum() <= 5 * 150 + L.DOC_CHARS + 10


def test_without_training_text(docs):
    none = L.fit(docs("x").where("false"))
    assert [r.lang_pred for r in L.identify(docs("some text"), none).collect()] == ["und"]


def test_number_signs_are_no_letters():
    assert [L.has_letter(t) for t in ("½ ①", "٣ 12 _", "", "½ x", "ж", "ª")] == [False, False, False, True, True, True]
