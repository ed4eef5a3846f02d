"""Every stage of the pipeline against a brute-force version on what its predecessor kept, with odd rows; and on an empty table."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from gridsift.llm import packing, toxicity
from test_linededup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc long, _row string, removed_lines string, gone int, root long, size long"


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = "\n".join(prose(30) for _ in range(3))
    rows = []
    for i in range(160):
        text = "\n".join(prose(rng.randint(5, 40)) for _ in range(rng.randint(1, 4)))
        if i % 9 == 0:
            text += "\n" + passage
        if i % 7 == 0:
            text += " you idiot scum trash"
        rows.append((i, text, "en", [None, "a", "b", "c"][i % 4]))
    base = rows[5][1]
    rows += [(300, base, "en", "a"), (301, base + " tail", "en", "b"), (302, None, None, None), (303, "", "en", "a"), (304, " \n ", None, "b"), (None, "no id at all here", None, None), (None, None, None, None)]
    rows += [rows[3], rows[3], (3, "another text under a used id", "en", "a"), (305, prose(9000), "en", "c")]
    return [(*r, len(r[1]) if r[1] is not None else None, 1, "x", "own", 2, 3, 4) for r in rows]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    prints = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def mixed(rows):
    """How often the queue takes each row, by one loop over all copies in the order of their finish times."""
    size = lambda r: len((r["text"] or "").encode().split())
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = sum(map(size, rows))
    sizes = {s: sum(size(r) for r in rows if r["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), Fraction(3, 2) * total
    while True:
        level = budget / max(1, sum(weight[s] for s in free))
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            budget -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    copies = []
    for k, s in enumerate(names):
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest(), size(r)))
        upto = 0
        for r in own:
            upto += size(r)
            for epoch in range(2):
                copies.append((float(upto + epoch * sizes[s]) / float(target[s]) if target[s] else 0.0, k, upto, epoch, r["doc_id"], size(r)))
    spent, taken = 0, Counter()
    for _, _, _, _, i, n in sorted(copies, key=lambda c: c[:4]):
        spent += n
        if 2 * spent <= 3 * total:
            taken[i] += n
    return +taken


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(160)] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, before, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, df.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        same = lambda rs: Counter(tuple(r[c] for c in columns) for r in rs)  # noqa: B023, E731
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "toxicity":
            said = toxicity.classify(spark.createDataFrame(before, df.schema), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
            toxic = Counter(r["doc_id"] for r in said if r["predicted"])
            assert Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after) == toxic
            assert same(after) <= same(before) and sum(toxic.values()) >= 10
        if name == "line_dedup":
            order = sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _signed(r["text"])))
            left = brute([(r["doc_id"], r["text"]) for r in order], 50)
            want = Counter((r["doc_id"], None if r["text"] is None else t) for r, t in zip(order, left, strict=True))
            assert Counter((r["doc_id"], r["text"]) for r in after) == want
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["removed_lines"] == "own" for r in after)
        if name == "simhash_near_dedup":
            group = groups(before)
            least = {}
            for r, g in zip(before, group, strict=True):
                if r["doc_id"] is not None:
                    least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
            assert Counter(r["doc_id"] for r in after) == Counter(least.get(g) for g in set(group)) and same(after) <= same(before)
        if name == "source_mixing":
            taken = Counter()
            for r in after:
                taken[r["doc_id"]] += len((r["text"] or "").encode().split())
            assert +taken == mixed(before)
        if name == "best_fit_packing":
            own = packing.encoder(packing.default_vocabulary())
            lengths = Counter()
            for r in before:
                ids = np.append(np.frombuffer(own.encode(r["text"] or ""), "<u4"), 2).astype("<u4")
                first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
                for start in [0, *range(first, len(ids), 1024)]:
                    lengths[r["doc_id"], zlib.crc32(ids[start : start + 1024].tobytes() if start else ids[:first].tobytes())] += 1
            assert Counter((r["doc_id"], r["ids_crc32"]) for r in after) == lengths


def _signed(text):
    """Spark's hash of the text, which orders rows of one doc_id."""
    if text is None:
        return 0
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, tmp_path, name):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, none, str(tmp_path))
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == none.columns)
