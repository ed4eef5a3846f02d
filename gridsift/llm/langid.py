"""Language identification by unigram pieces with all segmentations summed (operator 8).

The pieces are those of a fixed public vocabulary; each language has its own probabilities for them, learned by
expectation maximisation. A word's probability is the sum over all ways to cut it into pieces, found by the
forward algorithm; a text's is the product over its words. Pieces never cross words, so words are scored once
per worker and remembered. A long run of letters falls into parts at the places that no piece crosses, which
changes nothing: the sum over its segmentations is the product of its parts' sums.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import held_out, in_small_batches, table

#: Training takes SAMPLE texts of each language at most, in the order of a hash of doc_id, as far as they hold SAMPLE_CHARS characters together.
SAMPLE, SAMPLE_CHARS = 250, 1 << 22
ROUNDS, SMOOTH = 3, 0.05
#: Probability of a character that no piece covers, the same in all languages.
UNKNOWN = 1e-7
#: Runs of more letters are looked through for places that no piece crosses; parts of more are scored one by one.
SPLIT_CHARS, LONG_CHARS = 32, 4096
#: Characters looked up at a time.
AT_ONCE = 1 << 18
START = "▁"
#: A worker forgets its words when it knows so many or they have so many bytes, and scores texts in groups of so many words.
CACHE_WORDS, CACHE_BYTES, GROUP_WORDS = 400_000, 1 << 24, 1_000_000
UNDETERMINED = "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP, _BITS = np.uint64(0x9E3779B97F4A7C15), 20


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with the word start at most in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)] if p and START not in p[1:] and p == p.lower() and all(c.isalpha() for c in p.removeprefix(START))}
    return sorted(kept)


class Pieces:
    """Numbers of the pieces at all places of a text at once, by a hash of code points that is checked to be unique."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        codes = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(np.unique(codes)) != len(codes):
            raise ValueError("two pieces have the same hash")
        self.slots: dict[int, list[int]] = {}
        slot = (codes >> np.uint64(64 - _BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.depth = int(np.bincount(slot).max()) if len(slot) else 1
        self.codes = np.zeros((self.depth, 1 << _BITS), np.uint64)
        self.numbers = np.full((self.depth, 1 << _BITS), self.n, np.int32)
        fill = np.zeros(1 << _BITS, np.int64)
        for i in order:
            self.codes[fill[slot[i]], slot[i]], self.numbers[fill[slot[i]], slot[i]] = codes[i], i
            fill[slot[i]] += 1

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ (ord(c) + 1)) * int(_STEP)) % (1 << 64)
            h ^= h >> 29
        return h

    def find(self, text: np.ndarray) -> np.ndarray:
        """(longest, len(text)): the number of the piece of length k + 1 that starts at each place, n where there is none."""
        out = np.full((self.longest, len(text)), self.n, np.int32)
        h = np.zeros(len(text), np.uint64)
        for k in range(min(self.longest, len(text))):
            h = (h[: len(text) - k] ^ (text[k:].astype(np.uint64) + np.uint64(1))) * _STEP
            h ^= h >> np.uint64(29)
            slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
            for d in range(self.depth):
                same = self.codes[d][slot] == h
                out[k, : len(h)][same] = self.numbers[d][slot[same]]
        return out


class Batch:
    """Words laid out for the forward and backward algorithm: longest first, so each step works on the first few."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        text = np.frombuffer("".join([words[i] for i in self.order]).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(words[i]) for i in self.order], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.found, self.n, self.longest = pieces.find(text), pieces.n, pieces.longest
        self.steps = [int(np.searchsorted(-self.sizes, -j, side="right")) for j in range(int(self.sizes.max(initial=0)) + 1)]

    def at(self, j: int, k: int) -> np.ndarray:
        """Pieces of length k that end at place j of each word that is at least j long."""
        return self.found[k - 1][self.starts[: self.steps[j]] + (j - k)]

    def totals(self, p: np.ndarray) -> np.ndarray:
        """Log probabilities of the words, all segmentations summed, in the order given. p has a row per piece, the last for none, and a column per language."""
        window = [np.ones((len(self.sizes), p.shape[1]))]  # for the last places, what leads there, times exp(-scale)
        scale, out = np.zeros((len(self.sizes), p.shape[1])), np.zeros((len(self.sizes), p.shape[1]))
        for j in range(1, len(self.steps)):
            m = self.steps[j]
            here = np.zeros((m, p.shape[1]))
            for k in range(1, min(j, self.longest) + 1):
                numbers = self.at(j, k)
                if k == 1:
                    here += window[-1][:m] * np.where(numbers[:, None] < self.n, p[numbers], UNKNOWN)
                else:
                    some = np.flatnonzero(numbers < self.n)
                    if len(some):
                        here[some] += window[-k][some] * p[numbers[some]]
            window = [*window[-self.longest + 1 :], here] if self.longest > 1 else [here]
            if j % 8 == 0:
                most = np.max([w[:m] for w in window], axis=0)
                scale[:m] += np.log(most)
                window = [w[:m] / most for w in window]
            done = slice(self.steps[j + 1] if j + 1 < len(self.steps) else 0, m)
            out[done] = np.log(window[-1][done]) + scale[done]
        return out[np.argsort(self.order, kind="stable")]

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces for one language, by the forward and backward algorithm in logs; weights are the words' counts in the order given."""
        with np.errstate(divide="ignore"):
            logs, unknown = np.append(np.log(p[: self.n, 0]), -np.inf), np.log(UNKNOWN)
        m = len(self.steps) - 1

        def chance(j: int, k: int) -> np.ndarray:
            numbers = self.at(j, k)
            return np.where(numbers < self.n, logs[numbers], unknown) if k == 1 else logs[numbers]

        def summed(ways: list[np.ndarray]) -> np.ndarray:
            most = np.max(ways, axis=0)
            return most + np.log(np.sum([np.exp(w - most) for w in ways], axis=0))

        ahead = [np.zeros(len(self.sizes))]
        for j in range(1, m + 1):
            ahead.append(summed([ahead[j - k][: self.steps[j]] + chance(j, k) for k in range(1, min(j, self.longest) + 1)]))
        behind = [np.zeros(0)] * m + [np.zeros(self.steps[m])]
        for j in range(m - 1, -1, -1):
            here = np.zeros(self.steps[j])
            ways = np.full((min(m - j, self.longest), self.steps[j + 1]), -np.inf)
            for k in range(1, len(ways) + 1):
                ways[k - 1, : self.steps[j + k]] = behind[j + k] + chance(j + k, k)
            here[: self.steps[j + 1]] = summed(list(ways))
            behind[j] = here
        total = np.array([ahead[n][i] for i, n in enumerate(self.sizes)])
        scale, counts = np.array([weights[w] for w in self.order]), np.zeros(self.n + 1)
        for j in range(1, m + 1):
            for k in range(1, min(j, self.longest) + 1):
                m_j = self.steps[j]
                share = np.exp(ahead[j - k][:m_j] + chance(j, k) + behind[j] - total[:m_j]) * scale[:m_j]
                counts += np.bincount(self.at(j, k), share, minlength=self.n + 1)
        return counts[: self.n]


def long_total(part: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The log probability of one part of any length by language; memory does not grow with it."""
    text = np.frombuffer(part.encode("utf-32-le"), np.uint32)
    window, scale = np.zeros((pieces.longest, p.shape[1])), np.zeros(p.shape[1])
    window[-1] = 1  # row -k: what leads to the place k characters back
    back = np.arange(pieces.longest)
    for low in range(0, len(text), AT_ONCE):
        first = max(0, low - pieces.longest + 1)
        found = pieces.find(text[first : low + AT_ONCE])
        for j in range(low + 1, min(low + AT_ONCE, len(text)) + 1):
            k = back[: min(j, pieces.longest)]
            chances = p[found[k, j - 1 - k - first]]
            if found[0, j - 1 - first] == pieces.n:
                chances[0] = UNKNOWN
            here = (window[-1 - k] * chances).sum(axis=0)
            window[:-1] = window[1:]
            window[-1] = here
            if j % 8 == 0:
                most = window.max(axis=0)
                scale += np.log(most)
                window /= most
    return np.log(window[-1]) + scale


@dataclass
class Model:
    languages: list[str]
    vocabulary: str
    probabilities: np.ndarray  # a row per piece and one of zeros, a column per language


def train(texts: list[str], languages: list[str], vocabulary: str) -> Model:
    """Piece probabilities of each language by expectation maximisation over its words."""
    names, pieces = sorted(set(languages)), Pieces(vocabulary_pieces(vocabulary))
    columns = []
    for name in names:
        seen = Counter(w for t, x in zip(texts, languages, strict=True) if x == name for w in words_of(t))
        parts = Counter()
        for w, n in seen.items():
            for part in word_parts(w, pieces):
                parts[part] += n
        if not parts:
            parts[START] = 1
        batch, weights = Batch(list(parts), pieces), np.array(list(parts.values()), float)
        p = np.full((pieces.n + 1, 1), 1.0 / pieces.n)
        p[pieces.n] = 0
        for _ in range(ROUNDS):
            counts = batch.expected(p, weights) + SMOOTH
            p[: pieces.n, 0] = counts / counts.sum()
        columns.append(p)
    return Model(names, vocabulary, np.concatenate(columns, axis=1) if columns else np.zeros((pieces.n + 1, 0)))


def word_parts(word: bytes, pieces: Pieces) -> list[str]:
    """The word with its start mark, a long one cut at all places that no piece crosses."""
    whole = START + word.decode()
    if len(whole) <= SPLIT_CHARS:
        return [whole]
    text, cuts = np.frombuffer(whole.encode("utf-32-le"), np.uint32), [0]
    for low in range(0, len(whole), AT_ONCE):
        first = max(0, low - pieces.longest)
        found = pieces.find(text[first : low + AT_ONCE + pieces.longest])
        crossed = np.zeros(found.shape[1] + 1, np.int64)
        for k in range(1, len(found)):  # a piece of k + 1 characters crosses the k places within it
            starts = np.flatnonzero(found[k] < pieces.n)
            np.add.at(crossed, starts + 1, 1)
            np.subtract.at(crossed, starts + k + 1, 1)
        free = np.flatnonzero(np.cumsum(crossed)[: found.shape[1]] == 0) + first
        cuts += free[(free > low - (low > 0)) & (free > 0) & (free < low + AT_ONCE)].tolist()
    return [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True)]


class Scorer(dict):
    """Log probabilities of words by language: word -> row of a table that grows; new words wait until they are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.pieces = model, Pieces(vocabulary_pieces(model.vocabulary))
        self.rows, self.waiting, self.size = np.zeros((1024, len(model.languages))), [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        self.size += len(word)
        return n

    def settle(self) -> None:
        """Score the waiting words."""
        if not self.waiting:
            return
        first, p = len(self) - len(self.waiting), self.model.probabilities
        if len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self), 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        parts, owner, chars = [], [], 0

        def flush() -> None:
            nonlocal chars
            if parts:
                np.add.at(self.rows, np.array(owner), Batch(parts, self.pieces).totals(p))
            parts.clear()
            owner.clear()
            chars = 0

        for i, word in enumerate(self.waiting):
            for part in word_parts(word, self.pieces):
                if len(part) > LONG_CHARS:
                    self.rows[first + i] += long_total(part, self.pieces, p)
                    continue
                parts.append(part)
                owner.append(first + i)
                chars += len(part)
                if chars > 2 * AT_ONCE:
                    flush()
        flush()
        self.waiting = []

    def forget(self) -> None:
        self.clear()
        self.size = 0
        self.rows[:] = 0

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and its posterior probability under equal priors, for each text."""
        out: list[tuple[str, float]] = []
        names, group, held = self.model.languages, [], 0

        def finish() -> None:
            self.settle()
            for ids in group:
                if ids is None:
                    out.append((UNDETERMINED, 0.0))
                    continue
                logs = self.rows[ids].sum(axis=0)
                best = int(logs.argmax())
                out.append((names[best], float(1 / np.exp(np.clip(logs - logs[best], -700, 0)).sum())))
            group.clear()
            if len(self) > CACHE_WORDS or self.size > CACHE_BYTES:
                self.forget()

        for text in texts:
            if not text or not names or not any(map(str.isalpha, text)):
                group.append(None)
                continue
            words = words_of(text)
            group.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if held > GROUP_WORDS:
                finish()
                held = 0
        finish()
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer_for(key: str, model: Model) -> Scorer:
    """The scorer of this process: workers keep it from one task to the next."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def fit(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Model:
    """Learn from rows outside the held-out part whose lang and text are not null.

    The sample is bounded: of each language at most sample rows, those with the smallest hashes of doc_id among some
    more that are drawn by them, until they hold SAMPLE_CHARS characters.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = usable.join(F.broadcast(sizes), "lang").filter(place < F.lit(1.25 * sample) / F.col("n")).withColumn("place", place)
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")  # over the rows drawn
    drawn = drawn.withColumn("turn", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = drawn.filter((F.col("turn") <= sample) & (F.col("before") + F.length("text") <= SAMPLE_CHARS)).orderBy("lang", "turn").select("text", "lang").toArrow()
    return train(rows["text"].to_pylist(), rows["lang"].to_pylist(), vocabulary)


def identify(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of docs.

    docs needs doc_id, text and lang (for training only); other columns are ignored. Null text or text without a
    letter: 'und' with score 0; so is every text where nothing could be learned. Null doc_id: predicted, not held
    out, never learned from. Repeated rows are predicted each. An empty table gives an empty result. vocabulary:
    path of the pieces, which must be on every machine.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, vocabulary or default_vocabulary(), sample))  # pieces x languages numbers
    key = uuid.uuid4().hex

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_for(key, shared.value)
        for batch in batches:
            names, values = [], []
            for a in range(0, batch.num_rows, 256):
                for name, value in scorer.score(batch.column("text").slice(a, 256).to_pylist()):
                    names.append(name)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    plain = in_small_batches(docs.select("doc_id", "text"))
    out = plain.mapInArrow(predicted, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return identify(table(spark, sf_dir, "documents"))
