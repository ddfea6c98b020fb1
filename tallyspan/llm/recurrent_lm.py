"""A gated recurrent language model in numpy, trained and applied by Spark tasks.

Counts: every task counts its words, a shuffle adds them up (the table grows with the corpus). The WORDS most
frequent ones have outputs of their own, factored into classes: P(word) = P(class | state) P(word | class, state).
All other words, seen or not, belong to RARE further classes by what their letters look like, inside which they are
drawn by their counts over all training text: (count + 1) / (tokens of the class + its distinct words + 1).

Training: truncated backpropagation over windows of STEPS words, the state carried from window to window. One task
makes a first model from a bounded sample (WARM_TOKENS); then every task goes once through all its training text
from there, and the models are averaged by the words they have seen, block by block of parameters on the executors.

Scoring: documents of like length side by side, state carried across windows from their first word to their end.
Counts of the COMMON most frequent words go to the tasks (a bounded table); for the others each document's words
are joined to the count table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import ASCII_LOWER, fold_of, table, written

HIDDEN, CLASSES, CLASS_SIZE, RARE = 16, 32, 64, 16
WORDS = CLASSES * CLASS_SIZE
COMMON = 60_000
LANES, STEPS, SCORE_STEPS = 256, 16, 64
RATE, CLIP = 0.05, 2.0
WARM_TOKENS = 400_000
#: Documents scored side by side, distinct words a task counts before it sends them on, parameters in one row, and
#: words whose outputs are worked out together.
GROUP_DOCS, COUNTED, BLOCK, ROWS = 4_000, 500_000, 8_192, 8_192
#: Documents whose words are in memory at a time while they are learned from.
SLICE_DOCS = 2_000
FOLDS, HELD_OUT = 7, 2
#: The end of a document: no word is empty.
END = b""
BEYOND_ASCII = re.compile(rb"[\x80-\xff]+")
LOG10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), without the end."""
    return (text or "").encode().translate(ASCII_LOWER).split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts on end (binary), as words_of has them, and the number of the text of each."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten()
    held = pc.not_equal(pc.binary_length(words), 0)  # white space at either side leaves an empty word
    return words.filter(held).cast(pa.binary()), pc.list_parent_indices(parts).filter(held).to_numpy(zero_copy_only=False)


#: 8 for the bytes of ASCII marks, 0 for letters, digits and bytes beyond ASCII.
_MARK = [0 if b >= 0x80 or chr(b).isalnum() else 8 for b in range(256)]


def rare_class(word: bytes) -> int:
    """0 to RARE - 1, from a word's own letters: whether it ends in a mark, and its first letters beyond ASCII."""
    mark = _MARK[word[-1]] if word else 0
    if word.isascii():
        return mark
    found = BEYOND_ASCII.search(word)[0]
    return mark + 1 + found[1 if len(found) > 1 else 0] % 7


def rare_classes(words: pa.Array) -> np.ndarray:
    """rare_class of each of the words (binary)."""
    out = np.zeros(len(words), np.int32)
    full = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False))
    if not len(full):
        return out
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]
    first, last = at[:-1][full], at[1:][full]
    beyond = np.append(np.flatnonzero(data >= 0x80), len(data))
    found = beyond[np.searchsorted(beyond, first)]  # the first byte beyond ASCII, if it is one of the word's
    second = data[np.minimum(found + 1, last - 1)]
    own = np.where(second >= 0x80, second, data[np.minimum(found, last - 1)])
    out[full] = np.array(_MARK, np.int32)[data[last - 1]] + np.where(found < last, 1 + own % 7, 0)
    return out


def _count_words(batches):
    words, counts = [], []

    def rows():
        one = pa.concat_arrays(words).dictionary_encode()
        n = np.bincount(one.indices.to_numpy(), weights=np.concatenate(counts), minlength=len(one.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([one.dictionary, pa.array(rare_classes(one.dictionary)), pa.array(n)], ["word", "rare", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_DOCS):
            texts = batch.column(0).slice(at, SLICE_DOCS)
            found = words_in(texts)[0].value_counts()
            words += [found.field("values"), pa.array([END], pa.binary())]
            counts += [found.field("counts").to_numpy(), np.array([len(texts)])]
            if sum(map(len, counts)) > COUNTED:
                yield rows()
                words, counts = [], []
    if words:
        yield rows()


class Vocabulary:
    """Numbers of the common words, and what the counts say of all words."""

    def __init__(self, common: list[tuple[bytes, int]], tokens: int, distinct: int, rare: dict[int, tuple[int, int]]):
        self.words = pa.array([w for w, _ in common], pa.binary())
        self.counts = np.array([n for _, n in common] or [0], np.float64)
        self.tokens, self.distinct = tokens, distinct
        # the symbol of a common word: its own up to WORDS, else that of its rare class
        self.symbol = np.array([n if n < WORDS else WORDS + rare_class(w) for n, (w, _) in enumerate(common)] or [0], np.int32)
        totals = np.zeros((RARE, 2))
        for r, (n, v) in rare.items():
            totals[r] = n, v
        for w, n in common[:WORDS]:
            totals[rare_class(w)] -= n, 1
        self.rare_tokens = totals[:, 0]
        self.rare_log10 = np.log10(np.maximum(totals, 0).sum(axis=1) + 1)  # of what a rare word's count + 1 is divided by

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """As numbered, with the words as a list."""
        *found, words = self.numbered(texts)
        return *found, words.to_pylist()

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Numbers of the words of all texts, each text's end after them (-1: not common), where each text starts, and
        the places and words that are not common."""
        words, text = words_in(texts)
        found = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False)
        out = np.full(len(found) + len(texts), 0 if len(self.words) else -1, np.int32)  # the end is word 0
        places = np.arange(len(found)) + text
        out[places] = found
        other = np.flatnonzero(found < 0)
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)) + 1)[:-1]]).astype(np.int64)
        return out, starts, places[other], words.take(pa.array(other))

    def symbols(self, numbers: np.ndarray, places: np.ndarray, words: list[bytes] | pa.Array) -> np.ndarray:
        out = self.symbol[numbers]
        out[numbers < 0] = WORDS + rare_class(END)
        out[places] = WORDS + rare_classes(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
        return out


class Model:
    """Parameters: gates of each input symbol, gates of the state, class outputs, word outputs of each class."""

    SHAPES = {"G": (WORDS + RARE, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES + RARE), "c": (CLASSES + RARE,), "W": (CLASSES, HIDDEN, CLASS_SIZE), "w": (CLASSES, CLASS_SIZE)}

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def first(cls, vocabulary: Vocabulary) -> Model:
        """Small random gates; outputs that say what the counts say."""
        random = np.random.default_rng(7)
        p = {k: np.zeros(s, np.float32) for k, s in cls.SHAPES.items()}
        p["G"] += random.normal(0, 0.3, p["G"].shape).astype(np.float32)
        p["U"] += random.normal(0, HIDDEN**-0.5, p["U"].shape).astype(np.float32)
        known = np.zeros(WORDS)
        known[: min(WORDS, len(vocabulary.counts))] = vocabulary.counts[:WORDS]
        known = known.reshape(CLASSES, CLASS_SIZE) + 0.5
        p["w"][:] = np.log(known / known.sum(axis=1, keepdims=True))
        kinds = np.concatenate([known.sum(axis=1), np.maximum(vocabulary.rare_tokens, 0) + 0.5])
        p["c"][:] = np.log(kinds / kinds.sum())
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Model:
        out, at = {}, 0
        for k, shape in cls.SHAPES.items():
            size = int(np.prod(shape))
            out[k] = values[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return cls(out)

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Gates of the symbols and of the state, one gate after the other: what is worked on lies together."""
        return tuple(np.ascontiguousarray(self.p[k].reshape(-1, 3, HIDDEN).swapaxes(0, 1)) for k in "GU")

    def step(self, symbols: np.ndarray, h: np.ndarray):
        given, state = self.gates()
        return _step(given.take(symbols, axis=1), h, state)

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target symbol (its class alone, for a rare one); with grads, also d/d states."""
        p = self.p
        kind = np.where(targets < WORDS, targets // CLASS_SIZE, targets - WORDS + CLASSES)
        # biases are weights of a last unit that is always 1
        states = np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)
        weights = np.concatenate([p["C"], p["c"][None]])
        logits = states @ weights
        if not _tame(weights):
            logits = _safe(logits)
        out, total = _chosen(logits, kind, grads is not None)
        back = None
        if grads is not None:
            found = (states / total).T @ logits
            grads["C"] += found[:HIDDEN]
            grads["c"] += found[HIDDEN]
            back = logits @ p["C"].T
            back /= total
        # words with outputs of their own, class by class
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        own = order[: ends[-1]]
        parts = [(c, slice(ends[c], ends[c + 1])) for c in range(CLASSES) if ends[c] < ends[c + 1]]
        states, weights = states[own], np.concatenate([p["W"], p["w"][:, None]], axis=1)
        tame = _tame(weights)
        logits = np.empty((len(own), CLASS_SIZE), states.dtype)
        for c, rows in parts:
            np.matmul(states[rows], weights[c], out=logits[rows])
            if not tame:
                logits[rows] = _safe(logits[rows])
        log, total = _chosen(logits, targets[own] % CLASS_SIZE, grads is not None)
        out[own] += log
        if grads is not None:
            states /= total
            more = np.empty((len(own), HIDDEN), states.dtype)
            for c, rows in parts:
                found = states[rows].T @ logits[rows]
                grads["W"][c] += found[:HIDDEN]
                grads["w"][c] += found[HIDDEN]
                np.matmul(logits[rows], p["W"][c].T, out=more[rows])
            more /= total
            back[own] += more
        return out, back


def _step(given: np.ndarray, h: np.ndarray, state: np.ndarray):
    """The next states; given: (3, rows, HIDDEN) gates of the symbols, state: (3, HIDDEN, HIDDEN) those of the state."""
    gh = np.matmul(h, state)
    zr = given[:2] + gh[:2]
    np.exp(np.negative(zr, out=zr), out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r, inner = zr[0], zr[1], gh[2]
    n = r * inner
    n += given[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, inner


def _chosen(logits: np.ndarray, which: np.ndarray, less: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the chosen column of each row, and the rows' sums; logits become their exponentials.

    less: those of the chosen columns less the sums, so that a row over its sum is the gradient.
    """
    places = np.arange(len(which)) * logits.shape[1] + which
    flat = logits.reshape(-1)
    log = flat[places]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    log -= np.log(total)
    if less:
        flat[places] -= total
    return log, total[:, None]


def _tame(weights: np.ndarray) -> bool:
    """Whether exponentials of all logits stay within range, as states are between -1 and 1."""
    return float(np.abs(weights).sum(axis=-2).max()) < 60


def _safe(logits: np.ndarray) -> np.ndarray:
    """Logits whose exponentials stay within range: rows are shifted only if one could overflow or vanish."""
    return logits if -60 < logits.max() < 60 and logits.min() > -80 else logits - logits.max(axis=1, keepdims=True)


class Trainer:
    """Adagrad over windows of lanes of text."""

    def __init__(self, model: Model):
        self.model, self.tokens = model, 0
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.p.items()}

    def fit(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """One pass over documents laid end to end (each with its end); starts marks their first words.

        The last lanes are filled up with what is no text: it has no part in gradients and counts.
        """
        lanes = min(LANES, max(1, len(symbols) // STEPS))
        length = -(-len(symbols) // lanes)
        lay = lambda x: np.concatenate([x, np.zeros(lanes * length - len(x), x.dtype)]).reshape(lanes, length).T
        target, fresh, live = lay(symbols), lay(starts).copy(), lay(np.ones(len(symbols), bool))
        fresh[0] = True
        given = np.zeros_like(target)
        given[1:] = target[:-1]
        given[fresh] = 0  # a document begins as if after an end
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, length, STEPS):
            h = self._window(given[at : at + STEPS], target[at : at + STEPS], fresh[at : at + STEPS], h, live[at : at + STEPS])
        self.tokens += len(symbols)

    def _window(self, given, target, fresh, h, live=None):
        model, p = self.model, self.model.p
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "G"}
        steps, lanes = given.shape
        live = np.ones(given.shape, bool) if live is None else live
        keep = (~fresh).astype(p["U"].dtype)[:, :, None]
        _, state = model.gates()
        gates = np.ascontiguousarray(p["G"].take(given, axis=0).reshape(steps, lanes, 3, HIDDEN).transpose(0, 2, 1, 3))
        before, states, z, r, n, inner = np.empty((6, steps, lanes, HIDDEN), p["U"].dtype)
        for t in range(steps):
            h = np.multiply(h, keep[t], out=before[t])
            h, z[t], r[t], n[t], inner[t] = _step(gates[t], h, state)
            states[t] = h
        if live.all():
            back = model.outputs(states.reshape(-1, HIDDEN), target.ravel(), grads)[1].reshape(states.shape)
        else:
            back = np.zeros_like(states)
            back[live] = model.outputs(states[live], target[live], grads)[1]
        # what the gradient of a state is multiplied by for each of its gates
        for_n = (1 - z) * (1 - n * n)
        for_z = (before - n) * z * (1 - z)
        for_r = for_n * inner * r * (1 - r)
        transposed = np.ascontiguousarray(state.swapaxes(1, 2))
        recurrent = np.empty_like(gates)
        dh = np.zeros((lanes, HIDDEN), p["U"].dtype)
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            g, to = gates[t], recurrent[t]
            np.multiply(dh, for_z[t], out=g[0])
            np.multiply(dh, for_r[t], out=g[1])
            np.multiply(dh, for_n[t], out=g[2])
            to[:2] = g[:2]
            np.multiply(g[2], r[t], out=to[2])
            dh *= z[t]
            dh += np.matmul(to, transposed).sum(axis=0)
            dh *= keep[t]
        grads["U"] = np.matmul(before.swapaxes(1, 2)[:, None], recurrent).sum(axis=0).swapaxes(0, 1).reshape(HIDDEN, -1)
        flat = given.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        rows = np.add.reduceat(gates.transpose(0, 2, 1, 3).reshape(-1, 3 * HIDDEN)[order], first)
        scale = 1.0 / max(1, int(live.sum()))
        self._update(p["G"], self.squares["G"], rows * scale, used)
        for k, g in grads.items():
            self._update(p[k], self.squares[k], g * scale)
        return h

    def _update(self, value, square, g, at=slice(None)):
        squared = g * g
        norm = float(np.sqrt(squared.sum()))
        if norm > CLIP:
            g = g * (CLIP / norm)
            squared = g * g
        square[at] += squared * 1e3  # gradients are means over some thousand words
        value[at] -= RATE * g * 31.6 / np.sqrt(square[at])


def _texts_to_symbols(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    numbers, starts, *other = vocabulary.numbered(texts)
    fresh = np.zeros(len(numbers), bool)
    fresh[starts] = True
    return vocabulary.symbols(numbers, *other), fresh


def _train(vocabulary, start):
    """Each task: a model trained from start over the task's documents, in blocks of parameters."""

    def run(batches):
        trainer = Trainer(Model.from_flat(start.value.copy()))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                trainer.fit(*_texts_to_symbols(vocabulary.value, batch.column(0).slice(at, SLICE_DOCS)))
        if trainer.tokens:
            flat = trainer.model.flat()
            blocks = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([float(trainer.tokens)] * len(blocks))], ["block", "model", "weight"])

    return run


def _mean(rows: pa.Table) -> pa.Table:
    weights = np.array(rows.column("weight").to_pylist())
    total = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(weights, rows.column("model"))) / weights.sum()
    return pa.table({"block": rows.column("block")[:1], "model": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "weight": pa.array([weights.sum()])})


def _trained(texts: DataFrame, vocabulary, start: np.ndarray) -> np.ndarray:
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(start)
    models = texts.mapInArrow(_train(vocabulary, shared), "block int, model binary, weight double")
    # averaged in two steps, so that no task holds a block of every task's model
    some = models.withColumn("part", F.pmod(F.xxhash64("model"), F.lit(64)))
    some = some.groupBy("block", "part").applyInArrow(lambda t: _mean(t.select(["block", "model", "weight"])), "block int, model binary, weight double")
    rows = some.groupBy("block").applyInArrow(_mean, "block int, model binary, weight double").orderBy("block").collect()  # the size of one model
    return np.concatenate([np.frombuffer(r.model, np.float32) for r in rows]) if rows else start


class LanguageModel:
    """A model with its vocabulary and the table of all counts (word, n)."""

    def __init__(self, vocabulary: Vocabulary, parameters: np.ndarray, counts: DataFrame):
        self.vocabulary, self.parameters, self.counts = vocabulary, parameters, counts


def fit(training: DataFrame) -> LanguageModel:
    """Learns from all rows of training (doc_id, text; a null text counts as empty)."""
    spark = training.sparkSession
    training = training.select("doc_id", "text")
    counted = training.select("text").mapInArrow(_count_words, "word binary, rare int, n long")
    counts = written(counted.groupBy("word").agg(F.first("rare").alias("rare"), F.sum("n").alias("n")), "lm-counts")
    per_class = {r.rare: (r.n, r.v) for r in counts.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    # words by the power of two in their count: a few dozen rows say which counts the most frequent words have
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("words")).orderBy(F.desc("power")).collect()
    least, so_far = 0, 0
    for r in powers:
        least, so_far = 2**r.power, so_far + r.words
        if so_far >= COMMON:
            break
    # the end is word 0
    top = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).orderBy(F.col("word") != F.lit(END), F.desc("n"), "word").limit(COMMON).collect()
    vocabulary = Vocabulary([(bytes(r.word), r.n) for r in top], sum(n for n, _ in per_class.values()), sum(v for _, v in per_class.values()), per_class)
    shared = spark.sparkContext.broadcast(vocabulary)
    start = Model.first(vocabulary).flat()
    share = min(1.0, WARM_TOKENS / max(1, vocabulary.tokens))
    # ids and texts in a range of their hash, brought to one task after the rest is filtered out where it is read
    band = F.xxhash64("doc_id", "text").cast("double") / float(2**64) + 0.5 < share
    start = _trained(training.where(band).select("text").repartition(1), shared, start)
    training = training.select("text")
    return LanguageModel(vocabulary, _trained(training, shared, start), counts.select("word", "n"))


def _log10(model: Model, symbols: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's symbols, the end included; documents side by side, longest first."""
    sizes = np.array([len(x) for x in symbols], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([np.empty(0, np.int32), *symbols])
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    given, state = model.gates()
    out = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    last = np.zeros(len(order), np.int32)
    for at in range(0, int(sizes[0]) if len(sizes) else 0, SCORE_STEPS):
        n = int((sizes > at).sum())
        steps = min(SCORE_STEPS, int(sizes[0]) - at)
        live = (sizes[:n] - at).clip(max=steps)
        alive = np.arange(steps)[:, None] < live[None, :]
        doc = np.nonzero(alive)[1]  # step by step; the longest come first, so the living ones are a prefix
        ends = np.cumsum(alive.sum(axis=1))
        wanted = flat[np.repeat(np.arange(steps), alive.sum(axis=1)) + at + starts[doc]]
        states = np.empty((len(doc), HIDDEN), h.dtype)
        begin = 0
        for end in ends.tolist():
            m = end - begin
            h = states[begin:end] = _step(given.take(last[:m], axis=1), h[:m], state)[0]
            last = wanted[begin:end]
            begin = end
        found = np.concatenate([model.outputs(states[k : k + ROWS], wanted[k : k + ROWS])[0] for k in range(0, len(wanted), ROWS)])
        out[:n] += np.bincount(doc, weights=found, minlength=n) / LOG10
    back = np.zeros(len(order))
    back[order] = out
    return back


def _score(vocabulary, parameters):
    """Per document, what is known in the task; words beyond the common ones go along with how often they occur."""

    def run(batches):
        v, model = vocabulary.value, Model.from_flat(parameters.value)
        log_count = np.log10(v.counts + 1)
        base_total = float(np.log10(v.tokens + v.distinct + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_DOCS):
                part = batch.slice(at, GROUP_DOCS)
                numbers, starts, places, others = v.numbered(part.column("text"))
                own = v.symbols(numbers, places, others)
                common = numbers >= 0
                in_training = common & (v.counts[numbers] > 0)
                log = np.where(in_training, log_count[numbers], 0.0)  # what is still to come for the others is 0 here
                rare = own >= WORDS
                fixed = np.where(rare, log - v.rare_log10[np.where(rare, own - WORDS, 0)], 0.0)
                sums = lambda x: np.add.reduceat(x, starts)
                sizes = np.diff([*starts, len(numbers)])
                base = sums(log) - sizes * base_total
                known = sums(in_training.astype(np.int64))
                unknown = others.dictionary_encode()
                several = max(1, len(unknown.dictionary))
                pairs, times = np.unique((np.searchsorted(starts, places, "right") - 1) * several + unknown.indices.to_numpy(), return_counts=True)
                listed = lambda x: pa.ListArray.from_arrays(np.searchsorted(pairs, np.arange(len(starts) + 1) * several).astype(np.int32), x)
                total = _log10(model, np.split(own, starts[1:])) + sums(fixed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("kept"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(total), listed(unknown.dictionary.take(pa.array(pairs % several))), listed(pa.array(times, pa.int64()))],
                    ["rid", "kept", "n_tokens", "known", "base", "total", "words", "times"],
                )

    return run


def score(docs: DataFrame, found: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns in keep, n_tokens, n_known, train_tokens, base_score, score.

    score is the log10 probability of the whole text and its end under the model, base_score that of the smoothed
    counts. A null or empty text is its end alone. Every row is scored on its own account, repeated rows too; other
    columns are not read, whatever their names. An empty table gives no rows; without training rows, all words are unknown.
    """
    spark = docs.sparkSession
    vocabulary, parameters = spark.sparkContext.broadcast(found.vocabulary), spark.sparkContext.broadcast(found.parameters)
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keep).alias("kept"), "text")
    kind = keyed.schema["kept"].dataType.simpleString()
    part = written(keyed.mapInArrow(_score(vocabulary, parameters), f"rid long, kept {kind}, n_tokens long, known long, base double, total double, words array<binary>, times array<long>"), "lm-scored")
    other = part.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    log = F.log10(F.col("n") + 1) * F.col("times")
    more = other.join(found.counts, "word").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(log).alias("log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.drop("words", "times").join(more, "rid", "left").select(
        "kept.*", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(found.vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("log")).alias("base_score"), (F.col("total") + zero("log")).alias("score"),
    )


def op3_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    out = score(docs, fit(docs.where(~held)))
    return out.withColumn("held_out", held)
