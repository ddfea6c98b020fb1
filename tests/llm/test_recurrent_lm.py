import math
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyspan.llm import recurrent_lm as R


def vocabulary():
    common = [(b"", 50)] + [(b"w%d" % k, 100 - k // 30) for k in range(2500)]
    return R.Vocabulary(common, 100_000, 5000, dict.fromkeys(range(R.RARE), (5000, 900)))


def test_gradients_by_differences():
    random = np.random.default_rng(1)
    model = R.Model.first(vocabulary())
    model.p = {k: v.astype(np.float64) + random.normal(0, 0.1, v.shape) for k, v in model.p.items()}
    target = random.integers(0, R.WORDS + R.RARE, (5, 7)).astype(np.int32)
    given = random.integers(0, R.WORDS + R.RARE, (5, 7)).astype(np.int32)
    fresh = np.zeros((5, 7), bool)
    fresh[2, 3] = True

    def loss():
        h, states = np.zeros((7, R.HIDDEN)), []
        for t in range(5):
            h = model.step(given[t], h * ~fresh[t][:, None])[0]
            states.append(h)
        return -model.outputs(np.concatenate(states), target.ravel())[0].sum()

    found = {}

    class Watched(R.Trainer):
        def _update(self, value, square, g, at=slice(None)):
            found[next(k for k, v in self.model.p.items() if v is value)] = (g * target.size, at)

    Watched(model)._window(given, target, fresh, np.zeros((7, R.HIDDEN)))
    for k, value in model.p.items():
        g, at = found[k]
        full = np.zeros_like(value)
        full[at] = g
        for place in (np.unravel_index(np.abs(full).argmax(), full.shape), np.unravel_index(full.argmin(), full.shape)):
            value[place] += 1e-5
            up = loss()
            value[place] -= 2e-5
            down = loss()
            value[place] += 1e-5
            assert abs(full[place] - (up - down) / 2e-5) < 1e-4 * max(1, abs(full[place]))


def test_every_token_is_trained_on():
    """Also those that do not fill the lanes; what fills the last lanes up changes nothing."""
    random = np.random.default_rng(4)
    symbols = random.integers(0, R.WORDS, 16 * R.LANES + R.LANES - 1).astype(np.int32)
    starts = np.zeros(len(symbols), bool)
    starts[0] = True

    def after(last):
        trainer = R.Trainer(R.Model.first(vocabulary()))
        trainer.fit(np.concatenate([symbols[:-1], np.array([last], np.int32)]), starts)
        assert trainer.tokens == len(symbols)
        return trainer.model.flat()

    assert not np.array_equal(after(5), after(6))

    given, target = random.integers(0, R.WORDS, (2, R.STEPS, 3)).astype(np.int32)
    zero, live = np.zeros((R.STEPS, 3), bool), np.ones((R.STEPS, 3), bool)
    live[:, 2] = False
    two, three = (R.Trainer(R.Model.first(vocabulary())) for _ in range(2))
    two._window(given[:, :2], target[:, :2], zero[:, :2], np.zeros((2, R.HIDDEN), np.float32))
    three._window(given, target, zero, np.zeros((3, R.HIDDEN), np.float32), live)
    assert np.allclose(two.model.flat(), three.model.flat(), atol=1e-5)


def test_the_model_keeps_its_size():
    assert (R.WORDS, R.HIDDEN, R.LANES) == (2048, 16, 256)


def test_outputs_are_a_distribution():
    model = R.Model.first(vocabulary())
    states = np.random.default_rng(2).normal(0, 1, (1, R.HIDDEN)).astype(np.float32)
    every = np.arange(R.WORDS + R.RARE)
    log, _ = model.outputs(np.repeat(states, len(every), axis=0), every)
    assert abs(np.exp(log.astype(np.float64)).sum() - 1) < 1e-3


def test_documents_side_by_side_equal_one_by_one():
    model, random = R.Model.first(vocabulary()), np.random.default_rng(3)
    docs = [random.integers(0, R.WORDS + R.RARE, n).astype(np.int32) for n in (1, 5, 64, 65, 200, 1)]
    together = R._log10(model, docs)
    for d, value in zip(docs, together):
        h, last, total = np.zeros((1, R.HIDDEN), np.float32), np.zeros(1, np.int32), 0.0
        for x in d:
            h = model.step(last, h)[0]
            last = np.array([x], np.int32)
            total += float(model.outputs(h, last)[0][0]) / math.log(10)
        assert abs(total - value) < 1e-3 * max(1, abs(total))


def test_scores(docs, clashing):
    sentence = "the cat sat on the mat and the dog sat on the log . "
    train = [sentence * k for k in range(1, 40)] + [None, "", "Rare WORDS, here"]
    found = R.fit(clashing(docs(*train)))
    texts = [(1, None), (1, None), (None, ""), (3, sentence * 3), (4, "unseen words, the cat"), (5, "the " * 5000), (6, "RARE words, here")]
    got = {(r.doc_id, r.n_tokens): r for r in R.score(clashing(docs(*texts)), found).collect()}
    counts = Counter(w for t in train for w in [*R.words_of(t), R.END])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        words = [*R.words_of(t), R.END]
        r = got[i, len(words)]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0
    assert got[3, 43].score > got[3, 43].base_score
    assert R.score(docs("x").where("false"), found).count() == 0


def test_without_training_rows(docs):
    r = R.score(docs("two words"), R.fit(docs("x").where("false"))).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.base_score == 0.0


def test_words_are_found_and_numbered_without_a_loop_over_them():
    texts = ["The  cat\x0bsat", None, "", " \t\n", "\x1cÄ the\x85 \r", "CAT\x00 x\u00a0y"]
    words, text = R.words_in(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in R.words_of(t)]
    assert text.tolist() == [n for n, t in enumerate(texts) for _ in R.words_of(t)]
    v = R.Vocabulary([(R.END, 9), (b"the", 5), (b"cat", 3)], 17, 3, {})
    numbers, starts, places, others = v.numbers(pa.array(texts))
    plain = [w for t in texts for w in [*R.words_of(t), R.END]]
    known = {b"": 0, b"the": 1, b"cat": 2}
    assert numbers.tolist() == [known.get(w, -1) for w in plain]
    assert starts.tolist() == [0, 4, 5, 6, 7, 10] and [plain[k] for k in places] == others
    assert v.symbols(numbers, places, others).tolist() == [known.get(w, R.WORDS + R.rare_class(w)) for w in plain]


def test_words_are_counted_and_classed_without_a_loop_over_them(monkeypatch):
    words = [b"", b"a", b"a.", b".", "ä".encode(), "xä".encode(), "жук,".encode(), "a ".encode(), "—".encode(), "q’s…".encode(), b"0", b"\x00"]
    assert R.rare_classes(pa.array(words, pa.binary())).tolist() == [R.rare_class(w) for w in words]
    assert R.rare_classes(pa.array(words, pa.binary())[3:9]).tolist() == [R.rare_class(w) for w in words[3:9]]
    assert R.rare_classes(pa.array([], pa.binary())).tolist() == [] and R.rare_classes(pa.array([b"", b""], pa.binary())).tolist() == [0, 0]

    texts = ["The  cat\x0bsat", None, "", "Ä the\x85 the. \r", *(f"w{k} the жук{k % 3}," for k in range(5000))]
    counts = Counter(w for t in texts for w in [*R.words_of(t), R.END])
    classes = {w: R.rare_class(w) for w in counts}
    v, model = vocabulary(), R.Model.first(vocabulary())

    class Shared:
        def __init__(self, value):
            self.value = value

    rows = pa.array(range(len(texts)), pa.int64())
    monkeypatch.setattr(R, "rare_class", lambda word: {R.END: 0}[word])
    monkeypatch.setattr(R, "words_of", None)
    for most in (R.COUNTED, 1000):
        monkeypatch.setattr(R, "COUNTED", most)
        got, parts = Counter(), list(R._count_words(pa.RecordBatch.from_arrays([pa.array(t)], ["text"]) for t in (texts[:1], texts[1:])))
        for r in (r for p in parts for r in p.to_pylist()):
            got[r["word"]] += r["n"]
            assert r["rare"] == classes[r["word"]]
        assert got == counts and (len(parts) > 1) == (most == 1000)
    scored = pa.Table.from_batches(R._score(Shared(v), Shared(model.flat()))([pa.RecordBatch.from_arrays([rows, rows, pa.array(texts)], ["rid", "kept", "text"])])).to_pylist()
    known = set(v.words.to_pylist())
    for t, r in zip(texts, scored):
        assert dict(zip(r["words"], r["times"])) == {w: n for w, n in Counter(w.lower() for w in (t or "").encode().split()).items() if w not in known}
    assert len(scored) == len(texts) and len(list(R._train(Shared(v), Shared(model.flat()))([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))) == 1


def test_logits_beyond_the_range_of_exponentials():
    model = R.Model.first(vocabulary())
    model.p["W"][3] *= 0
    model.p["w"][3] += np.linspace(0, 500, R.CLASS_SIZE).astype(np.float32)
    model.p["c"][:4] += 300
    states = np.random.default_rng(2).normal(0, 0.5, (200, R.HIDDEN)).astype(np.float32)
    targets = np.random.default_rng(3).integers(0, R.WORDS + R.RARE, 200).astype(np.int32)
    log, back = model.outputs(states, targets, {k: np.zeros_like(x) for k, x in model.p.items()})
    assert np.isfinite(log).all() and np.isfinite(back).all() and (log < 1e-3).all()
