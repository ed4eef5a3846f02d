import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from gridsift.llm import substrings
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST = -(1 << 63)


def brute(rows, width):
    """(n_words, n_removed, kept words) of (doc_id, text) rows."""
    starts = defaultdict(set)
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [FIRST if d is None else d for d, _ in rows]
    for d, w in zip(ids, words):
        for i in range(len(w) - width + 1):
            starts[tuple(w[i : i + width])].add(d)
    out = []
    for d, w in zip(ids, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if min(starts[tuple(w[i : i + width])]) < d:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(rng, n, width):
    """Texts that share passages of about the width, some only once within a text, in odd white space."""
    shared = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            k = rng.randint(0, 3)
            w += p[k:] if rng.random() < 0.6 else [rng.choice("klmnopq") for _ in range(rng.randint(1, 9))]
        rows.append((i // 2 if rng.random() < 0.2 else i, "".join(x + rng.choice([" ", "\n", "  ", "\t", "  "]) for x in w)))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(13, 1), (3, 2), (1, 3), (30, 4)])
def test_same_as_brute_force(spark, monkeypatch, width, seed):
    monkeypatch.setattr(substrings, "BLOCK_ROWS", 7)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    rows = corpus(random.Random(seed), 120, width)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, doc_id long, text string").repartition(5)
    got = substrings.dedup_substrings(df, width).orderBy("n").collect()
    assert [(r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"]))) for r in got] == brute(rows, width)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n\t "), (None, passage), (None, passage), (8, passage), (8, passage), (9, "a " + passage + " b"), (10, long), (11, "own " + long), (12, "é ü")]
    df = spark.createDataFrame([(*r, i, i, i) for i, r in enumerate(rows)], "doc_id long, text string, n_words int, block int, rows int")
    got = substrings.dedup_substrings(df)
    assert got.columns == ["doc_id", "text", "block", "rows", "n_words", "n_removed"]
    got = got.orderBy("block").collect()
    assert [(r["n_words"], r["n_removed"], r["text"] or "") for r in got] == brute(rows, 13)
    assert got[0]["text"] is None and got[1]["text"] == ""
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_lengths_double():
    assert substrings.lengths(13) == [7, 13] and substrings.lengths(50) == [7, 13, 25, 50] and substrings.lengths(8) == [8]


def test_smallest_is_the_first_of_the_least():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    assert substrings.smallest(x, 7).tolist() == [i + int(np.argmin(x[i : i + 7])) for i in range(194)]


def test_query_digests(spark, tmp_path):
    rows = corpus(random.Random(9), 40, 13)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op12_substrings(spark, str(tmp_path)).collect()
    want = sorted((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, r, k) in zip(rows, brute(rows, 13)))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
