"""Alignment of two tokenizers over the bytes of texts (operator 11).

Texts are taken a chunk at a time. Both tokenizers start anew at a single space between two characters that are no white
space, so a text is a list of stretches between such spaces, and each distinct stretch of a chunk is encoded and aligned once, in DuckDB:
token intervals over the bytes of all stretches, an as-of join that finds the ends that both have, window sums that number the groups between them,
range joins of tokens with groups, and the pairs of ids that groups link with the number of documents they are in. Spark adds up the
partial counts of all chunks, finds each id's highest, and brings the counts back to the chunks, which sum them over their documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, in_small_batches, table

CHUNK_BYTES = 2 << 20
#: Spaces between which both tokenizers start anew. Python's white space includes all that the byte-level pattern takes for such.
BREAK = re.compile(r"(?<=\S) (?=\S)")
#: White space this long makes the ranks' pattern search recurse too deep.
SPACES = re.compile(r"\s{1000}")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
CHUNK = f"chunk long, doc_id array<{{}}>, {', '.join(f'{c} array<long>' for c in COLUMNS)}, groups_sha256 array<string>, lengths binary, stretches binary, pair_counts binary, pair_ids binary, pair_links binary, a array<int>, b array<int>, docs array<int>"

GROUPS = """
with ends as (select a.stretch, a.e from a asof join b on a.e <= b.e where a.e = b.e)
select stretch, e, coalesce(lag(e) over (order by e), 0) as s, sum(1) over (order by e rows unbounded preceding) - 1 as g from ends
"""
#: Tokens by the group whose bytes hold them: groups follow one another without gaps, so an end lies in the first group that does not end before it.
INSIDE = "select t.stretch, t.id, t.e, groups.g from {} t asof join groups on t.e <= groups.e"
PAIRS = """
with x as (select g, any_value(stretch) as stretch, id, count(*) as n from inside_a group by g, id), y as (select g, id, count(*) as n from inside_b group by g, id)
select x.stretch, x.id as a, y.id as b, cast(sum(x.n * y.n) as bigint) as n from x join y on x.g = y.g group by all
"""
COUNTS = """
with seen as (select distinct doc, stretch from inside)
select a, b, cast(count(distinct doc) as integer) as docs from seen join pairs using (stretch) group by a, b
"""


def squeeze(values: np.ndarray) -> bytes:
    """Small non-negative integers below 2**32, compressed byte by byte of their places."""
    return zstandard.compress(np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


class Aligner:
    """Both tokenizers and a DuckDB connection, kept by a worker."""

    def __init__(self, byte_level: str, pieces: str):
        import duckdb
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(byte_level).with_suffix(".tiktoken").read_bytes().splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.byte_level, self.full = byte_level, None
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("pieces that go on over a space: texts can't be broken at spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.spellings = [f"{i}{sign}" for sign in (",", "|", ";", "\n") for i in range(most)]
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def encode_a(self, text: str) -> list[int]:
        """The byte-level ids of text, strings of special tokens being plain text."""
        if SPACES.search(text):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.byte_level)
                self.full.encode_special_tokens = True
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def align(self, texts: list[str | None]) -> dict:
        """What a chunk's row holds of its texts."""
        broken = [BREAK.split(t) if t else [] for t in texts]
        stretches = list(dict.fromkeys(chain.from_iterable(broken)))
        place = {s: i for i, s in enumerate(stretches)}.__getitem__
        broken = [list(map(place, x)) for x in broken]
        n, spaced = len(stretches), [" " + s for s in stretches]
        ids = {"a": [self.encode_a(s) for s in spaced], "b": self.pieces.encode(stretches, num_threads=1) if stretches else []}
        want = [s.encode() for s in spaced]
        sizes, whole, bad, sides = np.fromiter(map(len, want), np.int64, n), b"".join(want), set(), {}
        for side, tokens, length in (("a", self.a_bytes, self.a_sizes), ("b", self.b_bytes, self.b_sizes)):
            counts, flat = flattened(ids[side])
            of = np.repeat(np.arange(n, dtype=np.int32), counts)
            if not np.array_equal(np.bincount(of, length[flat], n).astype(np.int64), sizes) or b"".join(map(tokens.__getitem__, flat.tolist())) != whole:
                bad |= {i for i, s in enumerate(want) if b"".join(map(tokens.__getitem__, ids[side][i])) != s}
            sides[side] = (of, flat, np.cumsum(length[flat]), counts)
        if bad:
            broken = [[] if not bad.isdisjoint(x) else x for x in broken]
            for side, length in (("a", self.a_sizes), ("b", self.b_sizes)):
                counts, flat = flattened([[] if i in bad else x for i, x in enumerate(ids[side])])
                sides[side] = (np.repeat(np.arange(n, dtype=np.int32), counts), flat, np.cumsum(length[flat]), counts)
        del ids, want, spaced, whole
        for side in "ab":
            self.db.register(side, pa.table({"stretch": sides[side][0], "id": sides[side][1], "e": sides[side][2]}))
        lengths = np.fromiter(map(len, broken), np.int64, len(broken))
        inside = np.fromiter(chain.from_iterable(broken), np.int64, int(lengths.sum()))
        self.db.register("inside", pa.table({"doc": np.repeat(np.arange(len(broken), dtype=np.int32), lengths), "stretch": inside.astype(np.int32)}))
        run = lambda name, sql: self.db.execute(f"create or replace temp table {name} as {sql}")
        run("groups", GROUPS)
        for side in "ab":
            run(f"inside_{side}", INSIDE.format(side))
        run("pairs", PAIRS)
        counted = self.db.execute(COUNTS + " order by a, b").fetchnumpy()
        self.db.register("counted", pa.table({"a": counted["a"], "b": counted["b"], "k": np.arange(len(counted["a"]))}))
        pairs = self.db.execute("select stretch, k, n from pairs join counted using (a, b) order by stretch, k").fetchnumpy()
        group_of = [self.db.execute(f"select g from inside_{s} order by e").fetchnumpy()["g"].astype(np.int64) for s in "ab"]
        each = {"n_a": sides["a"][3], "n_b": sides["b"][3]}
        of_group = self.db.execute("select stretch from groups order by e").fetchnumpy()["stretch"]
        in_group = [np.bincount(g, minlength=len(of_group)) for g in group_of]
        each["n_groups"] = np.bincount(of_group, minlength=n)
        each["n_links"] = np.zeros(n, np.int64)
        np.add.at(each["n_links"], of_group, in_group[0] * in_group[1])
        written = spelled(group_of, [sides["a"][1], sides["b"][1]], of_group, n, self.spellings)
        digest = lambda x: hashlib.sha256(";".join([written[i] for i in x]).encode()).hexdigest() if x else ""
        start = np.cumsum(lengths) - lengths
        total = lambda v: np.diff(np.r_[0, np.cumsum(v[inside])][np.r_[start, len(inside)]])
        return {c: total(each[c]) for c in COLUMNS} | {
            "groups_sha256": [digest(x) for x in broken], "lengths": squeeze(lengths), "stretches": squeeze(inside),
            "pair_counts": squeeze(np.bincount(pairs["stretch"], minlength=n)), "pair_ids": squeeze(pairs["k"]), "pair_links": squeeze(pairs["n"]),
            "a": counted["a"], "b": counted["b"], "docs": counted["docs"],
        }


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each list has, and all of them."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return counts, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))


def spelled(group_of: list[np.ndarray], ids: list[np.ndarray], of_group: np.ndarray, n: int, spellings: list[str]) -> list[str]:
    """Of each stretch, its groups as text: ids of one side by commas, sides by a bar, groups by semicolons. spellings: every id with each sign after it."""
    key = np.concatenate([2 * group_of[0], 2 * group_of[1] + 1])
    order = np.argsort(key, kind="stable")
    key, flat = key[order], np.concatenate(ids)[order]
    after = np.r_[key[1:], key[-1:] + 2] if len(key) else key
    last = np.r_[of_group[1:] != of_group[:-1], True] if len(of_group) else np.zeros(0, bool)
    sign = np.where(after == key, 0, np.where(after >> 1 == key >> 1, 1, np.where(last[key >> 1], 3, 2)))
    if len(sign):
        sign[-1] = 3
    text = "".join(map(spellings.__getitem__, (sign * (len(spellings) // 4) + flat).tolist())).split("\n")
    out = [""] * n
    for i, t in zip(np.unique(of_group).tolist(), text):
        out[i] = t
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def chunks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row for each CHUNK_BYTES or so of text: counts and group digests of its documents, their stretches, and the pairs of those, compressed; and a, b and docs of all pairs."""
    limit = CHUNK_BYTES

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (byte_level, pieces) not in _ALIGNERS:
            _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
        aligner, number = _ALIGNERS[byte_level, pieces], TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            columns = {"chunk": number, "doc_id": ids} | aligner.align(texts)
            return pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(batch.schema.field("doc_id").type)), *((c, pa.list_(pa.int64())) for c in COLUMNS), ("groups_sha256", pa.list_(pa.string())), *((c, pa.binary()) for c in ("lengths", "stretches", "pair_counts", "pair_ids", "pair_links")), *((c, pa.list_(pa.int32())) for c in ("a", "b", "docs"))])
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 8
                if size >= limit:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    plain = in_small_batches(docs.select("doc_id", "text"))
    return plain.mapInArrow(align, CHUNK.format(plain.schema["doc_id"].dataType.simpleString()))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    A is the byte-level vocabulary, B the one of pieces; both files, and A's .tiktoken ranks beside it, must be on every machine. docs needs doc_id and text; other columns are ignored.
    Null and empty texts, and those whose tokens do not spell a space and the text, have zeros and an empty digest. Rows with equal or null doc_id
    are documents each. An id's highest count may be that of several pairs: links of all of them are best. Texts of any length are
    taken whole, a worker holds one of them and its tokens at a time. An empty table gives an empty result.
    """
    import public_tokenizers

    shelf = Shelf(docs.sparkSession, "alignment")
    stored = shelf.put("chunks", chunks(docs, byte_level or str(public_tokenizers.path("byte_bpe_50k.json")), pieces or str(public_tokenizers.path("piece_bpe_32k.model"))))
    parts = stored.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("k", "x")).select("chunk", "k", "x.a", "x.b", "x.docs")
    counts = shelf.put("counts", parts.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    counts = counts.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))  # a row per id of the vocabulary at most
    back = parts.drop("docs").join(counts.hint("merge"), ["a", "b"]).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("k", "count", "is_best"))).alias("x"))
    back = back.select("chunk", "x.count", "x.is_best")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]  # noqa: B023, E731
                links, k, counts, inside, lengths = (unsqueeze(at(c).as_py()) for c in ("pair_links", "pair_ids", "pair_counts", "stretches", "lengths"))
                of = np.repeat(np.arange(len(counts)), counts)
                out = {}
                for name, value in (("n_best", "is_best"), ("count_sum", "count")):
                    value = at(value).values
                    value = np.zeros(0, np.int64) if value is None else value.cast(pa.int64()).to_numpy(zero_copy_only=False)
                    of_stretch = np.zeros(len(counts), np.int64)
                    np.add.at(of_stretch, of, links * value[k])
                    out[name] = pa.array(np.diff(np.r_[0, np.cumsum(of_stretch[inside])][np.r_[0, np.cumsum(lengths)]]))
                yield pa.RecordBatch.from_arrays([at("doc_id").values, *(at(c).values for c in COLUMNS), out["n_best"], out["count_sum"], at("groups_sha256").values], ["doc_id", *COLUMNS, "n_best", "count_sum", "groups_sha256"])

    joined = stored.drop("a", "b", "docs").join(back.hint("merge"), "chunk", "left")
    kind = stored.schema["doc_id"].dataType.elementType.simpleString()
    return joined.mapInArrow(finish, f"doc_id {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two public tokenizers aligned over all documents."""
    return align(table(spark, sf_dir, "documents"))
