"""Toxicity by a convolutional text classifier (operator 6).

Words are embedded by hashing: the sum of vectors looked up under two hashes of the word and one of its first
letters, so inflected forms share something. Filters of several widths run over the words of the whole text,
the maximum of each is kept, and a logistic layer gives the score. All weights start at random and are trained
in numpy on the driver, on a bounded sample of labelled documents; thresholds are calibrated by language, where
the language is itself guessed from the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import held_out, in_small_batches, table

#: Training takes at most SAMPLE labelled rows, in the order of a hash of doc_id, as far as they hold SAMPLE_CHARS characters together.
SAMPLE, SAMPLE_CHARS = 6000, 1 << 26
SLOTS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 6
#: Rows of label 1 count so many times; embeddings and filters learn at RATE, the other weights at a fifth of it.
EPOCHS, RATE, POSITIVE = 4, 0.1, 3.0
PREFIX = 4
#: A part of the sample is kept from training and used for the thresholds.
CALIBRATION = 5
#: Long texts are read in parts of so many words, which overlap by the widest filter.
STRIDE = 1 << 15
#: Texts are hashed in parts of at most so many bytes.
PART = 1 << 16
#: A language's threshold counts for its rows of label 1 in the calibration, the one of all languages for so many.
SHRINK = 20

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Slots of the words of a text, many words at once: a polynomial hash by prefix sums, then mixed."""

    def __init__(self):
        self.up, self.down = _powers(_FACTOR, PART + 8), _powers(_INVERSE, PART + 8)

    def __call__(self, text: str) -> np.ndarray:
        """Three slots a word, as an array of shape (words, 3)."""
        raw = text.lower().encode().translate(_LETTERS)
        if len(raw) <= PART:
            return self._part(raw)
        parts, at = [], 0
        while at < len(raw):
            end = len(raw) if at + PART >= len(raw) else raw.rfind(b" ", at, at + PART)
            if end > at:
                parts.append(self._part(raw[at:end]))
            elif end < 0:  # a word that is longer than a part
                end = raw.find(b" ", at)
                end = len(raw) if end < 0 else end
                parts.append(_slots(*(np.array([self._word(raw, at, x)], np.uint64) for x in (end, at + PREFIX))))
            at = end + 1
        return np.concatenate(parts)

    def _word(self, raw: bytes, start: int, end: int) -> int:
        """The same hash of one word, a part at a time."""
        total = 0
        for k, at in enumerate(range(start, end, PART)):
            part = np.frombuffer(raw[at : min(end, at + PART)], np.uint8)
            total += pow(_FACTOR, k * PART, 1 << 64) * int((part * self.up[: len(part)]).sum(dtype=np.uint64))
        return total % (1 << 64)

    def _part(self, part: bytes) -> np.ndarray:
        raw = np.frombuffer(b" " + part + b"     ", np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros((0, 3), np.int32)
        sums = np.cumsum(raw * self.up[: len(raw)], dtype=np.uint64)
        first = np.minimum(starts + PREFIX, ends)
        return _slots(*((sums[x - 1] - sums[starts - 1]) * self.down[starts] for x in (ends, first)))


def _slots(whole: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.stack([_mixed(whole, 1), _mixed(whole, 2), _mixed(head, 3)], axis=1)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int32)


@dataclass
class Model:
    """What scoring needs: for each hash a table of what its slot adds to each filter's places and to each language."""

    tables: np.ndarray  # (3, SLOTS, places * FILTERS + languages)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    languages: list[str]
    thresholds: np.ndarray  # as logits, one per language

    def logit(self, slots: np.ndarray) -> tuple[float, int]:
        """The uncalibrated score of a text and the number of its likely language."""
        n_filters = len(WIDTHS) * FILTERS
        best, spoken = np.zeros(n_filters), np.zeros(len(self.languages))
        wide = max(WIDTHS)
        for a in range(0, max(1, len(slots)), STRIDE):
            part = slots[a : a + STRIDE + wide - 1]
            if not len(part):
                break
            sums = self.tables[0][part[:, 0]] + self.tables[1][part[:, 1]] + self.tables[2][part[:, 2]]
            best = np.maximum(best, _pooled(sums, self.bias))
            spoken += sums[: min(len(part), STRIDE), _places() * FILTERS :].sum(axis=0, dtype=np.float64)
        return float(best @ self.weight + self.offset), int(spoken.argmax()) if len(self.languages) else 0

    def score(self, slots: np.ndarray) -> float:
        z, language = self.logit(slots)
        z -= self.thresholds[language] if len(self.thresholds) else 0.0
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _places() -> int:
    return sum(WIDTHS)


def _pooled(sums: np.ndarray, bias: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Maximum over the text of each filter's output, 0 at least; where gets the windows' numbers."""
    out, at, n = np.zeros(len(bias)), 0, len(sums)
    for k, w in enumerate(WIDTHS):
        lines = slice(k * FILTERS, (k + 1) * FILTERS)
        if n >= w:
            conv = sums[: n - w + 1, at * FILTERS : (at + 1) * FILTERS]
            for j in range(1, w):
                conv = conv + sums[j : n - w + 1 + j, (at + j) * FILTERS : (at + j + 1) * FILTERS]
            if where is None:
                top = conv.max(axis=0)
            else:
                where[lines] = conv.argmax(axis=0)
                top = conv[where[lines], np.arange(FILTERS)]
            out[lines] = np.maximum(top + bias[lines], 0)
        at += w
    return out


def train(slots: list[np.ndarray], toxic: np.ndarray, languages: list[str | None], seed: int = 1) -> Model:
    """Fit the network by Adagrad on rows that are not for calibration, then the thresholds on the others."""
    rng = np.random.default_rng(seed)
    places, nf = _places(), len(WIDTHS) * FILTERS
    names = sorted({x for x in languages if x is not None})
    spoken = np.zeros((SLOTS, len(names)), np.float64)
    for s, language in zip(slots, languages, strict=True):
        if language is not None:
            spoken[:, names.index(language)] += np.bincount(s[:, 0], minlength=SLOTS)
    spoken = np.log((spoken + 0.5) / (spoken.sum(axis=0) + 0.5 * SLOTS)) if names else spoken
    rows = np.arange(len(slots))
    fit, held = rows[rows % CALIBRATION != 0], rows[rows % CALIBRATION == 0]
    both = len(set(toxic[fit].tolist())) == 2

    E, W = rng.normal(0, 0.1, (3 * SLOTS, DIM)), rng.normal(0, 0.3, (places, DIM, FILTERS))
    place_of, width_of, within = np.concatenate([np.full(FILTERS, sum(WIDTHS[:k])) for k in range(len(WIDTHS))]), np.repeat(WIDTHS, FILTERS), np.tile(np.arange(FILTERS), len(WIDTHS))
    b, v, c = np.zeros(nf), rng.normal(0.5, 0.1, nf) if both else np.zeros(nf), np.array([-1.0])
    sums = {"E": np.full(len(E), 0.01), "W": np.full(W.shape, 0.1), "b": np.full(nf, 0.1), "v": np.full(nf, 0.1), "c": np.full(1, 0.1)}
    base = np.arange(3) * SLOTS

    def go(x: np.ndarray, g: np.ndarray, name: str, rate: float = RATE / 5) -> None:
        sums[name] += g * g
        x -= rate * g / np.sqrt(sums[name])

    for _ in range(EPOCHS if both else 0):
        for i in rng.permutation(fit):
            s = slots[i] + base
            where, words = np.zeros(nf, np.int64), E[s].sum(axis=1)
            h = _pooled((words @ W.transpose(1, 0, 2).reshape(DIM, -1)), b, where) if len(s) else np.zeros(nf)
            err = 1 / (1 + np.exp(-np.clip(h @ v + c[0], -30, 30))) - toxic[i]
            err *= POSITIVE if toxic[i] else 1.0
            if abs(err) < 0.01:
                continue
            on = np.flatnonzero(h > 0)
            g, step = err * v[on], np.zeros_like(W)
            rows_e, back = [], []
            for j in range(max(WIDTHS)):
                f, gf = on[width_of[on] > j], g[width_of[on] > j]
                at, place = where[f] + j, place_of[f] + j
                step[place, :, within[f]] += gf[:, None] * words[at]
                rows_e.append(s[at].reshape(-1))
                back.append(np.repeat(gf[:, None] * W[place, :, within[f]], 3, axis=0))
            go(v, err * h, "v")
            go(c, np.array([err]), "c")
            wide = np.zeros(nf)
            wide[on] = g
            go(b, wide, "b")
            go(W, step, "W", RATE)
            rows_e, back = np.concatenate(rows_e), np.concatenate(back)
            if len(rows_e):
                np.add.at(sums["E"], rows_e, (back * back).sum(axis=1))
                np.subtract.at(E, rows_e, RATE * back / np.sqrt(sums["E"][rows_e])[:, None])
    tables = (E @ W.transpose(1, 0, 2).reshape(DIM, -1)).reshape(3, SLOTS, -1)
    extra = np.zeros((3, SLOTS, len(names)))
    extra[0] = spoken
    model = Model(np.concatenate([tables, extra], axis=2).astype(np.float32), b, v, float(c[0]), names, np.zeros(max(1, len(names))))
    scored = [model.logit(slots[i]) for i in held]
    z, said = np.array([x[0] for x in scored]), np.array([x[1] for x in scored], int)
    everywhere = threshold(z, toxic[held])
    for k in range(len(names)):
        own = z[said == k], toxic[held][said == k]
        n = int(own[1].sum())
        model.thresholds[k] = (n * threshold(*own) + SHRINK * everywhere) / (n + SHRINK)
    return model


def threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the best cuts by F1; 0 where a class has no rows."""
    if len(set(toxic.tolist())) < 2:
        return 0.0
    order = np.argsort(-z)
    hits = np.cumsum(toxic[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    best = int(f1.argmax())
    low = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    return float((z[order[best]] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled rows of docs outside the held-out part.

    The sample is bounded: at most sample rows, those with the smallest hashes of doc_id, until they hold SAMPLE_CHARS
    characters; their texts are fetched when they are chosen. Rows with null label or text are left out, repeated rows
    (equal doc_id and text) count once. Where a doc_id has several labels the largest counts.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = docs.filter("text is not null").withColumn("th", F.xxhash64("text"))
    sizes = named.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "th").agg(F.max(F.length("text")).alias("n")).withColumn("turn", F.xxhash64("doc_id"))
    chosen = sizes.orderBy("turn", "doc_id", "th").limit(sample)
    upto = Window.orderBy("turn", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's rows, without their texts
    chosen = chosen.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= SAMPLE_CHARS).select("doc_id", "th", "turn")
    rows = named.select("doc_id", "th", "text", "lang").join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).join(F.broadcast(marks), "doc_id")
    rows = rows.orderBy("turn", "doc_id", "th").select("text", "lang", "toxic").toArrow()
    hasher = Hasher()
    return train([hasher(x.as_py()) for x in rows["text"]], np.array(rows["toxic"].to_pylist(), float).reshape(-1), rows["lang"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row per row of docs. Null or empty text: the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 10 MB, whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, net = Hasher(), shared.value
        for batch in batches:
            values = [net.score(hasher(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    plain = in_small_batches(docs.select("doc_id", "text"))
    return plain.mapInArrow(scored, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs.

    docs needs doc_id, text and lang (for training only), labels doc_id and toxic; others are ignored. Null
    doc_id: scored, not held out, never trained on. Repeated rows are scored each. Empty docs: an empty result.
    Without labels of both classes all scores are equal, and below 0.5.
    """
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, in one pass and without a join.

    docs needs doc_id, text and lang; all columns are kept, whatever they are called. Null and empty texts are scored as no words, texts of any length whole.
    A score of exactly 0.5 is toxic. Repeated rows are judged alike. Empty docs: an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, net = Hasher(), shared.value
        for batch in batches:
            clean = [net.score(hasher(x.as_py() or "")) < 0.5 for x in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_small_batches(docs).mapInArrow(kept, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
