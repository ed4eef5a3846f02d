"""Packing documents into sequences of tokens by length patterns (operator 9).

Documents become pieces of at most one sequence. The histogram of piece lengths, which has as many entries as
a sequence has tokens, is fitted with repeat counts of patterns of a few lengths by non-negative least squares;
the counts are rounded down and what is left is packed best fit, still by length. The plan says which ranks of
each length go to which sequences, so pieces find their places by their rank and nothing else is gathered.
"""

from __future__ import annotations

import array
import base64
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, in_small_batches, running_total, table

CAPACITY, END, PARTS = 1024, 2, 1024
#: White space this long makes the ranks' pattern search recurse too deep.
SPACES = re.compile(r"\s{1000}")


class Encoder:
    """Byte-level BPE of whole texts to little-endian unsigned 32-bit ids.

    The vocabulary's ranks give the ids that the `tokenizers` library gives (tests compare them on odd texts) in a
    sixth of the time and with little memory: nothing is remembered between texts. Texts that hold a special token
    or a very long run of white space go to that library itself, which is loaded when the first such text comes.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).with_suffix(".tiktoken").read_bytes().splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(t["content"] for t in json.loads(Path(vocabulary).read_text()).get("added_tokens", ()))
        self.vocabulary, self.full = vocabulary, None

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or SPACES.search(text):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.vocabulary)
            return array.array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this process: workers keep it from one task to the next."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """start and length of the pieces of n ids: whole sequences, the first piece holding what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces of all rows of docs. Null text: the end id alone."""
    tail = array.array("I", [end]).tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            at, rows = [], []
            for i, x in enumerate(batch.column("text")):
                ids = encode(x.as_py() or "") + tail
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            values = np.array(rows, np.int64).reshape(-1, 4)
            columns = [pa.array(values[:, 0], pa.int32(), safe=False), *(pa.array(values[:, j], pa.int64()) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = in_small_batches(docs.select("doc_id", "text"))
    return plain.mapInArrow(cut_up, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns(capacity: int) -> list[tuple[int, ...]]:
    """Patterns that fill a sequence: all pairs of lengths, and triples whose shortest length is on a grid."""
    step = max(1, capacity // 64)
    out = [(capacity - a, a) for a in range(1, capacity // 2 + 1)]
    for a in range(step, capacity // 3 + 1, step):
        out += [(capacity - a - b, b, a) for b in range(a, (capacity - a) // 2 + 1, max(1, step // 4))]
    return out


def non_negative_fit(counts: np.ndarray, shapes: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """x >= 0 that minimises the squared difference between counts and the lengths in x times shapes, by coordinate descent."""
    x, gap = np.zeros(len(shapes)), counts.astype(float).copy()
    usable = [(i, *np.unique(s, return_counts=True)) for i, s in enumerate(shapes) if all(counts[list(s)] > 0)]
    steps = [(i, lengths, times, float((times**2).sum())) for i, lengths, times in usable]
    for _ in range(sweeps):
        most = 0.0
        for i, lengths, times, norm in steps:
            move = max(-x[i], float(gap[lengths] @ times) / norm)
            if move:
                x[i] += move
                gap[lengths] -= move * times
                most = max(most, abs(move))
        if most < 0.25:
            break
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that use up counts[length] pieces of each length exactly.

    At most capacity patterns besides the enumerated ones: each step of the best fit uses up a length.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(shape: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((shape, int(times)))
            for n in shape:
                left[n] -= times

    use((capacity,), left[capacity])
    shapes = patterns(capacity)
    fit = non_negative_fit(left, shapes)
    for i in np.argsort(-fit, kind="stable"):
        if fit[i] < 1:
            break
        lengths, times = np.unique(shapes[i], return_counts=True)
        use(shapes[i], min(int(fit[i]), int((left[lengths] // times).min())))
    while left.any():
        shape, space, spare = [], capacity, left.copy()
        while space > 0 and len(there := np.flatnonzero(spare[: space + 1])):
            n = int(there[-1])
            shape.append(n)
            spare[n] -= 1
            space -= n
        lengths, times = np.unique(shape, return_counts=True)
        use(tuple(shape), int((left[lengths] // times).min()))
    return out


def placements(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ranks by length: the sorted keys length * 2**40 + first rank, and each range's first sequence and its offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, times in chosen:
        offset = 0
        for n in shape:
            rank = used.get(n, 0)
            rows.append(((n << 40) + rank, sequence, offset))
            used[n] = rank + times
            offset += n
        sequence += times
    rows.sort()
    values = np.array(rows, np.int64).reshape(-1, 3)
    return values[:, 0].copy(), values[:, 1].copy(), values[:, 2].copy()


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of all rows of docs.

    docs needs doc_id and text; other columns are ignored. Null or empty text: one piece with the end id.
    Longer documents than a sequence are cut; no other is. Null doc_id is kept. Repeated rows are packed each.
    An empty table gives an empty result. vocabulary: the path of the tokenizer's JSON file, which must be on
    every machine, its .tiktoken ranks beside it.
    """
    shelf = Shelf(docs.sparkSession, "packing")
    cut_up = shelf.put("pieces", pieces(docs, vocabulary or default_vocabulary(), capacity, end))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_up.groupBy("length").count().collect():  # at most capacity rows
        counts[row["length"]] = row["count"]
    keys, sequences, offsets = placements(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        i = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[i] + key - keys[i], "offset": offsets[i]})

    mixed = F.xxhash64("doc_id", "piece")
    ranked = cut_up.withColumn("_h", mixed).withColumn("_part", F.pmod("_h", F.lit(PARTS)).cast("int"))
    ranked = running_total(ranked, ["length"], [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_part", F.lit(1), "_rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", F.col("_rank") - 1).alias("_at")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack(table(spark, sf_dir, "documents"))
