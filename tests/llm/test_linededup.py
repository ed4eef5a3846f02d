import random
import re
from collections import defaultdict

import pytest
from gridsift.llm import linededup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """The texts that must be left of (doc_id, text) rows, by comparing all places with all earlier ones."""
    docs = []
    for _, text in rows:
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if WORDS.search(x)]
        docs.append((lines, at, [len(WORDS.findall(lines[i])) for i in at]))
    places = defaultdict(list)
    for d, (lines, at, _) in enumerate(docs):
        for n, i in enumerate(at):
            places[lines[i]].append((d, n))
    out = []
    for d, (lines, at, words) in enumerate(docs):
        dead = set()
        for n in range(len(at)):
            for e, k in places[lines[at[n]]]:
                if (e, k) < (d, n):
                    other, there, _ = docs[e]
                    m = 0
                    while n + m < len(at) and k + m < len(there) and lines[at[n + m]] == other[there[k + m]]:
                        m += 1
                    if sum(words[n : n + m]) >= least:
                        dead.update(range(n, n + m))
        gone = {at[n] for n in dead} | {i for n in dead if n + 1 in dead for i in range(at[n], at[n + 1])}
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("least", [1, 7])
def test_same_as_brute_force(spark, least):
    rng = random.Random(least)
    kinds = ["a b c", "d e", "f", "g h i j", "", "  "]
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == brute(rows, least)


def test_odd_rows(spark):
    long = "\n".join(f"word{i} " * 3 for i in range(3000))
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d\ne", None), (3, "a b c d\ne", None), (None, "a b c d\ne\nz", "n"), (None, "q", "n"), (5, long, "l"), (6, "own\n" + long, "l"), (7, " \n\n", "w")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, th string, gone int, _doc int")
    got = linededup.dedup_lines(df, 5)
    assert got.columns == ["doc_id", "text", "th", "gone", "_doc", "removed_lines"]
    again = linededup.dedup_lines(got, 5)  # its own column is replaced
    assert again.columns == got.columns and again.count() == len(rows)
    left = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"] is not None)
    # the row without doc_id comes first; both rows of document 3 are copies of its run
    assert left == [(0, "a b c d\ne\nz"), (0, "q"), (2, ""), (3, ""), (3, ""), (5, long), (6, "own"), (7, " \n\n")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_keep_the_first(spark):
    text = "one two three\nfour five six"
    got = linededup.dedup_lines(spark.createDataFrame([(1, text)] * 3, "doc_id long, text string"), 5).collect()
    assert sorted(r["text"] for r in got) == ["", "", text]
