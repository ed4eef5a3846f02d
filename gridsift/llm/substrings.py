"""Removal of word windows that an earlier document has, by level-wise doubling (operator 12).

Windows of a few words are tested first, then only those that repeat are extended to twice the length, up to the
width asked for; longer windows could cover no further word. Below the full width it is enough to test, in each window of the next length, the
one of this length with the smallest hash: equal windows agree on it, so a window can only repeat if that one does.

Documents lie in blocks of a thousand or so, in a table bucketed by block, so that texts are dealt out once. At every level
a block sends each hash it tests once, however many of its documents share it, to the shard that the hash falls in; the
shard answers with a bit for each. What travels is a hash and a bit for a window, never a text or a list of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from gridsift.llm.common import Shelf, bucketed, in_small_batches, table

WIDTH = 13
#: Shortest windows have at most so many words.
SEED = 8
BLOCK_ROWS, BLOCK_CHARS = 1000, 4_000_000
#: Words of the corpus for each shard of the hashes.
SHARD_WORDS = 2_000_000
REMEMBERED = 300_000
U = np.uint64
FIRST = -(1 << 63)


def lengths(width: int) -> list[int]:
    """The lengths of windows that are tested: each is the half, rounded up, of the next."""
    out = [width]
    while out[0] > SEED:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """Hashes of words; the most recent ones are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), U, len(words))


def hashes(words: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """A hash of the `length` words from each place on."""
    out = np.zeros(max(0, len(words) - length + 1), U)
    for j in range(length):
        out = out * U(multiplier) + words[j : j + len(out)]
    out ^= out >> U(31)
    out *= U(0xBF58476D1CE4E5B9)
    return out ^ (out >> U(29))


def smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """For each place, the first place of the smallest value among the `reach` ones from it on."""
    n = len(values) - reach + 1
    least, at = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, reach):
        less = values[j : j + n] < least
        np.copyto(least, values[j : j + n], where=less)
        at[less] = j
    return at + np.arange(n)


class Block:
    """The words of a block's documents one after the other, and the windows to test at each level."""

    def __init__(self, ids: list, texts: list, width: int, remember: Words):
        split = [(t or "").encode().split() for t in texts]  # bytes are split at the six ASCII white-space characters
        self.counts = np.array([len(w) for w in split], np.int64)
        self.words = np.concatenate([remember(w) for w in split]) if split else np.zeros(0, U)
        self.split, self.lengths = split, lengths(width)
        self.ids = np.array([FIRST if x is None else x for x in ids], np.int64)
        self.doc = np.repeat(np.arange(len(split)), self.counts)

    def level(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the windows of level j from each place, whether they lie in one document, and what each hangs on: the place of its smallest window of the level before."""
        n = self.lengths[j]
        h = hashes(self.words, n, 0x9E3779B97F4A7C15)
        whole = self.doc[: len(h)] == self.doc[n - 1 :] if len(h) else np.zeros(0, bool)
        if j == 0 or not len(h):
            return h, whole, np.zeros(len(h), np.int64)
        before = self.lengths[j - 1]
        return h, whole, smallest(hashes(self.words, before, 0x9E3779B97F4A7C15), n - before + 1)

    def tested(self, answers: list[dict[int, bytes]], shards: int) -> tuple[np.ndarray, "Sent"]:
        """Places of the windows that the next level tests, given the answers to the levels before, and what is sent about them."""
        alive = None
        for j in range(len(answers) + 1):
            h, whole, hangs_on = self.level(j)
            if alive is not None:
                whole &= alive[hangs_on]
            if j + 1 < len(self.lengths):
                _, longer, on = self.level(j + 1)
                some = np.zeros(len(h), bool)
                some[on[longer]] = True
                whole &= some
            at = np.flatnonzero(whole)
            sent = Sent(self, at, h[at], j + 1 == len(self.lengths), shards)
            if j == len(answers):
                return at, sent
            alive = np.zeros(len(h), bool)
            alive[at] = sent.answered(answers[j])
        raise AssertionError

    def removed(self, answers: list[dict[int, bytes]], shards: int) -> np.ndarray:
        """Which words go."""
        at, sent = self.tested(answers[:-1], shards)
        gone = at[sent.answered(answers[-1]) | (self.ids[self.doc[at]] > sent.first[sent.group])]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.lengths[-1], -1)
        return np.cumsum(edge)[:-1] > 0


class Sent:
    """Distinct hashes of a block in the order they are sent: by shard, then by value."""

    def __init__(self, block: Block, at: np.ndarray, h: np.ndarray, last: bool, shards: int):
        self.value, first_at, self.group = np.unique(h, return_index=True, return_inverse=True)
        self.shard = (self.value >> U(20)) % U(shards)
        owner = block.ids[block.doc[at]]
        self.first = np.full(len(self.value), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.group, owner)
        if last:  # 32 bits more, as matches decide now
            n = block.lengths[-1]
            other = np.zeros(len(first_at), U)
            for j in range(n):
                other = other * U(0xD6E8FEB86659FD93) + block.words[at[first_at] + j]
            self.more = (other >> U(32)).astype(np.uint32)
        else:  # whether documents of this block share it
            most = np.full(len(self.value), FIRST)
            np.maximum.at(most, self.group, owner)
            self.more = (most > self.first).astype(np.uint8)
        self.last = last

    def messages(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        for s in np.unique(self.shard):
            i = self.shard == s
            yield int(s), self.value[i].tobytes(), self.more[i].tobytes(), self.first[i].tobytes() if self.last else b""

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answer for each window."""
        yes = np.zeros(len(self.value), bool)
        for s, bits in answers.items():
            i = np.flatnonzero(self.shard == U(s))
            yes[i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(i)).astype(bool)
        return yes[self.group]


def answers(messages: pa.Table) -> pa.Table:
    """The shard's answers to its blocks: for short windows, whether two documents have it; for whole ones, whether a document before all of the block's has it."""
    value = [np.frombuffer(x.as_py(), U) for x in messages["value"]]
    last = len(messages["first"][0].as_py()) > 0
    more = [np.frombuffer(x.as_py(), np.uint32 if last else np.uint8) for x in messages["more"]]
    sizes, (v, m) = [len(x) for x in value], (np.concatenate(value), np.concatenate(more))
    if last:
        first = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in messages["first"]])
        order = np.lexsort((first, m, v))
        new = np.r_[True, (v[order][1:] != v[order][:-1]) | (m[order][1:] != m[order][:-1])]
        least = first[order][np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
        yes = np.empty(len(v), bool)
        yes[order] = least < first[order]
    else:
        _, group, count = np.unique(v, return_inverse=True, return_counts=True)
        shared = np.zeros(len(count), bool)
        shared[group[m > 0]] = True
        yes = (shared | (count > 1))[group]
    bits = [np.packbits(x).tobytes() for x in np.split(yes, np.cumsum(sizes)[:-1])]
    return pa.table({"block": messages["block"], "shard": messages["shard"], "bits": pa.array(bits, pa.binary())})


def blocks(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """block, n_words and rows (all rows of docs in the block), bucketed by block. A block ends with BLOCK_ROWS rows or BLOCK_CHARS characters."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            i, texts = 0, batch.column("text")
            sizes = [len(x.as_py() or "") for x in texts]
            while i < len(sizes):
                k, chars = i, 0
                while k < len(sizes) and k - i < BLOCK_ROWS and (k == i or chars + sizes[k] <= BLOCK_CHARS):
                    chars += sizes[k]
                    k += 1
                words = sum(len((x.as_py() or "").encode().split()) for x in texts[i:k])
                whole = pa.StructArray.from_arrays([c.slice(i, k - i) for c in batch.columns], fields=list(batch.schema))
                rows = pa.ListArray.from_arrays(pa.array([0, k - i], pa.int32()), whole)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64()), rows], ["block", "n_words", "rows"])
                i, n = k, n + 1

    schema = StructType().add("block", LongType()).add("n_words", LongType()).add("rows", ArrayType(docs.schema))
    return bucketed(shelf, "blocks", in_small_batches(docs).mapInArrow(pack, schema), "block")


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of docs with repeated windows deleted from text, and n_words and n_removed (long, words of the text before, and those deleted).

    A window is `width` consecutive words of one document; each word goes that is covered by a window whose words also
    start in a document with a smaller doc_id. What is left is joined by one space. docs needs doc_id (an integer) and text; columns of docs called
    n_words or n_removed are replaced, others may have any names. Null doc_id comes before all others. Rows with equal
    doc_id, also null, delete nothing from one another. Null text stays null and has no words; an empty one stays empty.
    Texts of any length are taken whole; one text must fit in a worker's memory, several times over. An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed")
    shelf = Shelf(docs.sparkSession, "substrings")
    stored = blocks(docs, shelf)
    words = stored.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    levels = len(lengths(width))
    names = docs.columns
    at = names.index("doc_id"), names.index("text")

    def opened(batch: pa.RecordBatch, remember: Words) -> Iterator[tuple[int, pa.StructArray, Block, list[dict[int, bytes]]]]:
        for i in range(batch.num_rows):
            rows = batch.column("rows")[i].values
            said = [{x["shard"]: x["bits"] for x in batch.column(f"said{j}")[i].as_py() or ()} for j in range(levels) if f"said{j}" in batch.schema.names]
            yield batch.column("block")[i].as_py(), rows, Block(rows.field(at[0]).to_pylist(), rows.field(at[1]).to_pylist(), width, remember), said

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Words()
        for batch in batches:
            for number, _, block, said in opened(batch, remember):
                _, sent = block.tested(said, shards)
                out = [(number, *m) for m in sent.messages()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "shard", "value", "more", "first"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Words()
        for batch in batches:
            for _, rows, block, said in opened(batch, remember):
                gone = block.removed(said, shards)
                texts, removed, start = rows.field(at[1]).to_pylist(), [], 0
                for k, (words, n) in enumerate(zip(block.split, block.counts)):
                    mask = gone[start : start + n]
                    removed.append(int(mask.sum()))
                    if texts[k]:
                        texts[k] = b" ".join([w for w, x in zip(words, mask) if not x] if removed[-1] else words).decode()
                    start += n
                columns = rows.flatten()
                columns[at[1]] = pa.array(texts, columns[at[1]].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block.counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    level = stored.drop("n_words")
    for j in range(levels):
        messages = level.mapInArrow(send, "block long, shard int, value binary, more binary, first binary")
        said = messages.groupBy("shard").applyInArrow(answers, "block long, shard int, bits binary")
        said = shelf.put(f"said{j}", said.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(f"said{j}")))
        level = level.join(said.hint("merge"), "block", "left")
    schema = StructType(list(docs.schema)).add("n_words", LongType()).add("n_removed", LongType())
    return level.mapInArrow(finish, schema)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 13 words that a document before them has."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")), 256).alias("kept_sha256"))
