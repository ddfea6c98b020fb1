"""Language identification by interpolated Kneser-Ney character models.

Spark counts the character n-grams of each language's training text; a model per language keeps, for each order,
its n-grams as a sorted array of 64-bit hashes with what the recursion needs beside it, and is searched by
bisection. A text goes to the language with the lowest cross-entropy per character.

Fitting uses a bounded sample, as documented: of each language, the documents that come first in the order of a
hash of their id and text, up to SAMPLE_CHARS characters; a text longer than DOC_CHARS gives that many characters in
a row, from a place drawn by the hash. Every language with a labelled text has a model, whatever their number. The
last tenth of the documents in a language's sample is left out of the counts; the first HELD_ROWS of them set the
calibration: the temperature that turns differences of entropy into a probability, and per language the entropy
beyond which a text is rejected as unlike all of its training text. A language of fewer than ten documents trains on all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import fold_of, table, written

ORDER = 4
SAMPLE_CHARS, DOC_CHARS, HELD_ROWS = 1_500_000, 150_000, 100
#: Ranges of the hash whose characters are summed up to see where a language's sample ends.
BUCKETS = 1 << 16
FOLDS, HELD_OUT = 3, 1
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.25
UNDETERMINED = "und"
#: Codes a worker remembers the scores of.
CACHED = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Letters and some number signs.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def symbols(text: str) -> np.ndarray:
    """The text's characters as numbers: lower case, each run of what is no letter as one space, a space around it."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    small = points < 128
    letter = ~small | ((points >= 97) & (points <= 122))
    letter &= ~((points == 0xA0) | (points == 0xAD) | ((points >= 0x2000) & (points < 0x2070)) | (points == 0x3000))
    out = np.where(letter, points, 32)
    return out[letter | np.concatenate([[True], letter[:-1]])]


def codes(chars: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit number for each run of so many characters (21 bits each, mixed beyond three)."""
    out = np.zeros(max(0, len(chars) - order + 1), np.uint64)
    for k in range(order):
        out = out * MULTIPLIER + chars[k : k + len(out)].astype(np.uint64) + np.uint64(1)
    return out


class Counts:
    """Sorted hashes with counts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class KneserNey:
    """Interpolated Kneser-Ney with one discount per order, over arrays of runs of ORDER characters and their counts."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray):
        self.levels = []
        use = counts.astype(np.float64)
        for order in range(ORDER, 0, -1):  # lower orders count the different characters before a run
            keys, contexts = _code_rows(runs), _code_rows(runs[:, :-1])
            ones, twos = float((use == 1).sum()), float((use == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            names, where = np.unique(contexts, return_inverse=True)
            total = np.bincount(where, weights=use)
            kinds = np.bincount(where)
            self.levels.append((Counts(keys, use), Counts(names, total), Counts(names, kinds * discount), discount))
            if order > 1:
                lower, use = np.unique(runs[:, 1:], axis=0, return_counts=True)
                runs, use = lower, use.astype(np.float64)
        self.unseen = 1.0 / (len(self.levels[-1][0].keys) + 1000)

    def log2(self, runs: np.ndarray) -> np.ndarray:
        """log2 P(last character | the ones before it), of rows of ORDER characters."""
        p = np.full(len(runs), self.unseen)
        for order in range(1, ORDER + 1):
            grams, totals, back, discount = self.levels[ORDER - order]
            tail = runs[:, ORDER - order :]
            context = _code_rows(tail[:, :-1])
            total = totals.get(context)
            seen = np.maximum(grams.get(_code_rows(tail)) - discount, 0)
            p = np.where(total > 0, (seen + back.get(context) * p) / np.maximum(total, 1), p)
        return np.log2(p)


def _code_rows(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = out * MULTIPLIER + rows[:, k].astype(np.uint64) + np.uint64(1)
    return out


class Identifier:
    """Models of all languages, with calibration; scores are remembered by run of characters."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.temperature, self.limits = 0.05, np.full(len(languages), np.inf)
        self._reset()

    def _reset(self):
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, len(self.models)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a character of each text (which has a letter) under each language."""
        chars = [symbols(t) for t in texts]
        chars = [np.concatenate([np.full(ORDER - 1, 32, c.dtype), c]) for c in chars]
        parts = [codes(c, ORDER) for c in chars]
        sizes = np.array([len(p) for p in parts])
        every = np.concatenate(parts)
        distinct, where = np.unique(every, return_inverse=True)
        scores = self._scores(distinct, every, chars, where)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.stack([np.add.reduceat(scores[:, n][where], starts) for n in range(len(self.models))], axis=1)
        return -sums / sizes[:, None]

    def _scores(self, distinct: np.ndarray, every: np.ndarray, chars: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        if len(self.keys) > CACHED:
            self._reset()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            first = np.zeros(len(distinct), np.int64)
            first[where[::-1]] = np.arange(len(every) - 1, -1, -1)  # a place of each distinct run
            flat = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in chars])
            runs = flat[first[~known]]
            keys = np.concatenate([self.keys, distinct[~known]])
            rows = np.concatenate([self.rows, np.stack([m.log2(runs) for m in self.models], axis=1)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], rows[order]
            at = np.searchsorted(self.keys, distinct)
        return self.rows[at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, probability among the languages, bits a character, and whether the text is unlike its language."""
        n = len(texts)
        langs, probability, bits, rejected = [UNDETERMINED] * n, [0.0] * n, [None] * n, [True] * n
        with_letter = [k for k, t in enumerate(texts) if t and has_letter(t)]
        if not with_letter or not self.models:
            return langs, probability, bits, rejected
        h = self.entropies([texts[k] for k in with_letter])
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        share = 1 / np.exp((least[:, None] - h) / self.temperature).sum(axis=1)
        for k, b, s, e in zip(with_letter, best.tolist(), share.tolist(), least.tolist()):
            langs[k], probability[k], bits[k], rejected[k] = self.languages[b], s, e, e > self.limits[b]
        return langs, probability, bits, rejected


def _run_counts(batches):
    """Runs of ORDER characters of each language, counted in the batch."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chars = symbols(text or "")
            by.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(ORDER - 1, 32, chars.dtype), chars]), ORDER))
        for lang, parts in by.items():
            runs, counts = np.unique(np.concatenate(parts), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs)), pa.array([r.astype("<u4").tobytes() for r in runs], pa.binary()), pa.array(counts, pa.int64())], ["lang", "run", "n"])


def fit(labelled: DataFrame) -> Identifier:
    """An Identifier from rows (doc_id, text, lang): those without text or lang are left out."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    length = F.char_length("text")
    rows = rows.withColumns({"bucket": F.pmod("h", F.lit(BUCKETS)), "size": F.least(length, F.lit(DOC_CHARS)).cast("long")})
    # the bucket of each language in which its sample ends: at most BUCKETS rows a language, then one
    earlier = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("lang", "bucket").agg(F.sum("size").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    sizes = sums.where(F.col("before") < SAMPLE_CHARS).groupBy("lang").agg(F.max("bucket").alias("last")).collect()
    if not sizes:
        return Identifier([], [])
    by_lang = lambda values: F.map_from_arrays(F.array(*(F.lit(r.lang) for r in sizes)), F.array(*(F.lit(v).cast("long") for v in values)))[F.col("lang")]
    near = rows.where(F.col("bucket") <= by_lang(r["last"] for r in sizes))
    start = F.pmod("h", F.greatest(length - DOC_CHARS, F.lit(0)) + 1).cast("int") + 1
    near = near.withColumn("text", F.substr("text", start, F.lit(DOC_CHARS)))
    order = Window.partitionBy("lang").orderBy("bucket", "h", "doc_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = near.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).withColumns({"turn": F.row_number().over(order), "docs": F.count("*").over(Window.partitionBy("lang"))})
    sample = written(sample.select("text", "lang", (F.col("turn") - F.ceil(F.col("docs") * 9 / 10)).alias("held")), "lid-sample")
    counted = sample.where("held <= 0").select("text", "lang").mapInArrow(_run_counts, "lang string, run binary, n long")
    kept = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()  # at most SAMPLE_CHARS runs a language
    languages = sorted(kept["lang"].unique())
    models = []
    for lang in languages:
        own = kept[kept["lang"] == lang]
        models.append(KneserNey(np.frombuffer(b"".join(own["run"]), "<u4").reshape(-1, ORDER), own["n"].to_numpy()))
    found = Identifier(languages, models)
    held = sample.where(f"held between 1 and {HELD_ROWS}").select("text", "lang").collect()  # at most HELD_ROWS texts and SAMPLE_CHARS a language
    _calibrate(found, [(r.text, r.lang) for r in held if has_letter(r.text) and r.lang in languages])
    return found


def _calibrate(found: Identifier, held: list[tuple[str, str]]) -> None:
    if not held:
        return
    truth = np.array([found.languages.index(lang) for _, lang in held])
    h = found.entropies([t for t, _ in held])
    own = h[np.arange(len(h)), truth]
    loss = lambda t: float(np.mean(np.log(np.exp((own[:, None] - h) / t).clip(1e-30, 1e30).sum(axis=1))))
    found.temperature = min(np.geomspace(0.02, 2, 25), key=loss)
    for n in range(len(found.languages)):
        if (truth == n).any():
            found.limits[n] = REJECT_MARGIN * float(np.quantile(own[truth == n], REJECT_QUANTILE))


def identify(docs: DataFrame, found: Identifier, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, bits_per_char, rejected.

    Only the text is read. Null, empty and letterless texts are `und`, with score 0 and rejected. Ties go to the
    language that sorts first. Every row is judged on its own; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        own = model.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 512):
                part = texts.slice(start, 512).to_pylist()
                langs, share, bits, rejected = own.predict(part)
                yield pa.RecordBatch.from_arrays([ids.slice(start, 512), pa.array(langs), pa.array(share, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_char double, rejected boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fit(docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    out = identify(docs, found)
    return out.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
