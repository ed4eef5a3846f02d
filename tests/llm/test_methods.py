"""Parts of the operators by themselves: what their methods rest on, against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from gridsift.llm import html, langid, packing, quality, sharding, simhash, toxicity
from pyspark.sql import functions as F


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.default_vocabulary()), packing.encoder(packing.default_vocabulary())
    alphabet = ["a", "B", "ing", " ", "  ", "\n", "\t", "é", "日", "😀", "'s", "'ll", "1", "23", "_", "-", " ", "　", "\x1c", "\x85", "​", "ß", "İ", "\x00", "<|", "|>", "<|endoftext|>", "\r\n", "½"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" + " " * 5000 + "y", "\n" * 3000, "a" * 20000]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_fingerprints_share_a_cell(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        x = rng.getrandbits(64)
        rows.append((signed(x), signed(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))))
    df = spark.createDataFrame(rows, "x long, y long").select(simhash.pivoted(F.col("x")).alias("x"), simhash.pivoted(F.col("y")).alias("y"))
    assert df.filter(F.array_contains(simhash.cells_within(F.col("y"), 3), simhash.cell(F.col("x"), 3)) & simhash.near(F.col("x"), F.col("y"))).count() == 400


def test_one_key_with_many_small_components(spark):
    """Half of the bits are the same everywhere, so that all fingerprints meet under one key, and few of them are near."""
    rng = random.Random(3)
    low = (1 << 32) - 1
    prints = {(rng.getrandbits(64) & ~low) | 12345 for _ in range(150)}
    prints |= {x ^ (1 << 40) ^ (1 << rng.randint(41, 63)) for x in list(prints)[:50]}
    prints |= {x ^ (1 << 35) for x in list(prints)[:30]}
    prints = sorted(prints)
    group = {x: x for x in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
            old, new = group[b], group[a]
            group = {k: new if v == old else v for k, v in group.items()}
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    from gridsift.llm.common import Shelf

    got = {r["node"]: r["root"] for r in simhash.link_components(fps, Shelf(spark, "test")).collect()}
    sets = defaultdict(set)
    for x in prints:
        sets[got.get(signed(x), signed(x))].add(x)
    want = defaultdict(set)
    for x, g in group.items():
        want[g].add(x)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))


def test_host_verdicts_move_documents(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    noise = lambda i: own(i) + "".join(f" ##{j}##" for j in range(20))
    rows = [(i, noise(i) if i % 2 == 0 else own(i), "noisy") for i in range(400)]  # half of it fails
    rows += [(1000 + i, noise(i) if i == 7 else own(i), "careful") for i in range(400)]  # one fails
    rows += [(2000 + i, noise(i), "none of it") for i in range(100)] + [(2999, own(2999), "none of it")]
    rows += [(3000, noise(1), None), (3001, own(1), None), (3002, None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] == (i % 2 != 0) for i in range(400))
    assert all(kept[1000 + i] for i in range(400))  # the doubt's benefit, at a host that hardly ever fails
    assert not any(kept[2000 + i] for i in range(100)) and not kept[2999]  # a host that surely fails loses all
    assert (kept[3000], kept[3001], kept[3002]) == (True, True, False)  # no host, no verdict


def test_equal_hosts_move_no_document(spark):
    """Where hosts fail alike, none is surely above the mean: only the base rules take documents."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(1000 * h + i, own(i) + "".join(f" ##{j}##" for j in range(20) if i % 5 == 0) if i % 7 else "short", f"host{h}") for h in range(6) for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got) and any(r["soft_failed"] and r["kept"] for r in got)


def test_duplicate_lines_count_against_lines(spark):
    rng = random.Random(4)
    lines = [f"one{i} two{i}" for i in range(30)] * 3
    rng.shuffle(lines)
    rows = [(1, "\n".join(lines), "a"), (2, "\n".join(f"one{i} two{i}" for i in range(90)), "a")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["n_lines"] == 90 and got[1]["n_dup_lines"] == 60 and got[1]["soft_failed"] and not got[2]["soft_failed"]


@pytest.fixture(scope="module")
def model():
    return langid.train(["the thing there and the other thing"] * 3, ["en"] * 3, langid.default_vocabulary())


def test_long_runs_are_the_sum_over_all_segmentations(model, monkeypatch):
    scorer = langid.Scorer(model)
    p, pieces = model.probabilities, scorer.pieces
    run = "thethingthereisöötheronethatandsoonxqxqzz" * 4
    whole = langid.Batch([langid.START + run], pieces).totals(p)[0]
    numbers = {x: i for i, x in enumerate(langid.vocabulary_pieces(model.vocabulary))}
    ways = [1.0]
    text = langid.START + run
    scale = 0.0
    for j in range(1, len(text) + 1):
        here = 0.0
        for k in range(1, min(j, pieces.longest) + 1):
            i = numbers.get(text[j - k : j])
            here += ways[-k] * (p[i, 0] if i is not None else langid.UNKNOWN if k == 1 else 0.0)
        ways.append(here)
        scale += np.log(here)
        ways = [w / here for w in ways[-pieces.longest :]]
    assert whole[0] == pytest.approx(scale)
    parts = langid.word_parts(run.encode(), pieces)
    assert "".join(parts) == text and len(parts) > 1
    assert langid.Batch(parts, pieces).totals(p).sum(axis=0) == pytest.approx(whole)
    assert langid.long_total(text, pieces, p) == pytest.approx(whole)
    monkeypatch.setattr(langid, "AT_ONCE", 23)
    assert langid.long_total(text, pieces, p) == pytest.approx(whole)
    again = langid.word_parts(run.encode(), pieces)
    assert "".join(again) == text and langid.Batch(again, pieces).totals(p).sum(axis=0) == pytest.approx(whole)
    monkeypatch.setattr(langid, "LONG_CHARS", 5)
    assert scorer.rows[scorer[run.encode()]] == pytest.approx(0)
    scorer.settle()
    assert scorer.rows[scorer[run.encode()]] == pytest.approx(whole)


def test_language_of_odd_rows(spark):
    rows = [(i, "the thing and the other" if i % 2 else "der dinge und das andere", "en" if i % 2 else "de", 1, "s") for i in range(40)]
    rows += [rows[0], rows[0], (None, "the thing", None, 2, None), (None, "the thing", "en", 2, None), (50, "日本" * 30_000, None, 3, "x")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, held_out string")).collect()
    assert len(got) == len(rows) and Counter(r["lang_pred"] for r in got if r["doc_id"] is None) == {"en": 2}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False, False] and sum(r["doc_id"] == 0 and r["lang_pred"] == "de" for r in got) == 3


def test_words_of_a_text_hash_alike_in_parts(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30))) for _ in range(500)) + " " + "z" * 300 + " end"
    whole = toxicity.Hasher()(text)
    monkeypatch.setattr(toxicity, "PART", 128)
    parts = toxicity.Hasher()(text)
    assert len(whole) == len(parts) == 502
    assert (whole == parts).all()  # a word that is longer than a part, too


def test_untrained_classifiers_reject_nothing():
    slots = toxicity.Hasher()
    for marks in ([], [0.0] * 20, [1.0] * 20):
        net = toxicity.train([slots("some words here")] * len(marks), np.array(marks), ["en"] * len(marks))
        assert net.score(slots("other words")) == net.score(slots("")) < 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.reject(none, labels).count() == 0 and simhash.keep_one(none).count() == 0 and quality.judge(none).count() == 0


def cut_edges(groups, shards):
    """The least number of links between shards, over all ways to deal the rows of the groups out evenly."""
    rows = [g for g, n in enumerate(groups) for _ in range(n)]
    n = len(rows)
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    best = None

    def place(g, free, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if g == len(groups):
            best = cost
            return
        for split in itertools.product(*(range(min(f, groups[g]) + 1) for f in free)):
            if sum(split) == groups[g]:
                place(g + 1, [f - x for f, x in zip(free, split, strict=True)], cost + (groups[g] ** 2 - sum(x * x for x in split)) // 2)

    place(0, quotas, 0)
    return best


@pytest.mark.parametrize(("groups", "shards"), [((2, 2, 2, 1, 1, 1), 3), ((5, 2, 1, 1), 3), ((3, 3, 1, 1, 1), 3), ((4, 2, 2, 2, 2), 3)])
def test_cut_edges_are_near_the_least(spark, groups, shards):
    rows = [(g * 10 + i, f"text {g}", 1) for g, n in enumerate(groups) for i in range(n)]
    by = defaultdict(Counter)
    for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, n long"), shards).collect():
        by[r["text_crc32"]][r["shard"]] += 1
    cut = sum((sum(x.values()) ** 2 - sum(v * v for v in x.values())) // 2 for x in by.values())
    assert cut <= cut_edges(groups, shards) + 2


def test_circulation_keeps_balance():
    rng = random.Random(7)
    for _ in range(50):
        asked = {(s, t): rng.randint(1, 9) for s in range(5) for t in range(5) if s != t and rng.random() < 0.5}
        room = {s: rng.randint(0, 4) for s in range(5)}
        served = sharding.circulation(asked, room)
        assert all(0 <= n <= asked[k] for k, n in served.items())
        for x in range(5):
            assert sum(n for (_, t), n in served.items() if t == x) - sum(n for (s, _), n in served.items() if s == x) <= room[x]
    assert sharding.circulation({(0, 1): 3, (1, 2): 3, (2, 0): 5}, {0: 0, 1: 0, 2: 0}) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}


P = "Some words here, and then some more of them, which go on. "


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f'<article><p>{P * 3}</p><p class="search-results">{P}</p></article>', [P * 3, P]),
        (f'<article><div class="post-header"><h1>Head</h1></div><p>{P * 3}</p></article>', ["Head", P * 3]),
        (f"<body><div>{P * 4}</div><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><div>{P * 5}</div>", [P * 4, P * 5]),
        (f'<body><div class="post"><h1>H</h1><p>{P}</p><p>x y</p><div class="ad">Buy it now, please.</div><p>{P}</p></div><div class="comments"><p>{P * 3}</p></div>', ["H", P, "x y", P]),
        (f'<body><div id="content" class="sidebar-left"><p>{P * 3}</p><p>{P}</p></div><div class="footer">Copyright, all of us.</div>', [P * 3, P]),
        (f'<div class="ad">Now, now, now. Buy, all of you, at once.</div><article><h1>A head</h1><p>Sh is.</p></article>', ["A head", "Sh is."]),
        (f"<div><p>{P}</p></div><div><p>{P}</p></div>", [P, P]),  # two equal roots
    ],
)
def test_paths_decide_about_blocks(page, lines):
    assert html.main_text(page).split("\n") == [x.strip() for x in lines]


def test_paths_of_deep_pages_are_numbers():
    assert html.main_text("<div>" * 20000 + "deep text" + "</div>" * 20000) == "deep text"
