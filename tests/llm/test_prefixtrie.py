import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from gridsift.llm import prefixtrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The nodes of (conv_id, turn, role, text) rows as tuples."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = convs.get(base, [])[:h] + convs[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for j in range(len(k) + 1):
            leaves[k[:j]] += children[k] == 0
            saved[k[:j]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    return sorted((m[0][0], len(k), members[k[:-1]][0][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest()) for k, m in members.items())


def conversations(rng, n, kinds=3):
    rows = []
    for c in rng.sample(range(-30, 5 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(["a b", " c\n", None, ""][:kinds])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force_and_sql(spark, monkeypatch, seed):
    monkeypatch.setattr(prefixtrie, "RANGE", 3)
    rng = random.Random(seed)
    rows = conversations(rng, 70) + [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None)] + [(40, t, "user", f"t{t % 2}") for t in range(30)] + [(41, t, "user", f"t{t % 2}") for t in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, c int, d int").repartition(4)
    out = prefixtrie.prefix_trie(df)
    want = brute(rows)
    assert sorted(map(tuple, out.collect())) == want
    conversations_ = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    base = duckdb.connect()
    base.register("conversations", conversations_)
    got = base.execute(prefixtrie.ORACLE).fetchall()
    assert sorted(got) == want
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0


def test_copies_make_one_chain(spark):
    rows = [(c, t, "user", f"word {t}") for c in range(0, 4000, 20) for t in range(4)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("depth").collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in got] == [(0, d, 200, int(d < 4), 1) for d in range(5)]
    assert got[0]["saved_tokens"] == 199 * 8
    assert got[4]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(0, 4000, 20))).encode()).hexdigest()
