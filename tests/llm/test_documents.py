"""Small tables with odd rows through the operators on documents, against plain versions of what they must do."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from gridsift.llm import langid, mixing, packing, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, _doc long, _epochs long, _row long"
SPACE = " \t\n\v\f\r"


def words(text):
    return (text or "").encode().split()


def rows():
    rng = random.Random(5)
    some = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = [*some, some[0], some[1] + " tail", None, "", " \n ", "x", "x", "LONG word " * 6000, "line one here\nline one here\n\nother", some[0]]
    return [(i, t, "en" if i % 3 else None, [None, "a", "b", "c"][i % 4] if i % 2 else "hot", 0, 7, 9, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "no id here", None, None, 0, 7, 9, 1, 2, 3), (0, texts[0], "en", "hot", 0, 7, 9, 1, 2, 3), (3, "other text under a used id", "en", "a", 0, 7, 9, 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


def test_mixing_keeps_to_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    size = lambda t: len(words(t))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows())
    total, by_source = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(x[0]["target"] for x in by_source.values()) == pytest.approx(1.5 * total)
    for own in by_source.values():
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r["text"]) for r in mixed.select("text").collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_measures(docs):
    def plain(text):
        w = words(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        covered = {i + k for i, x in enumerate(grams) if seen[x] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    got = Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in quality.judge(docs).collect())
    assert got == Counter((r[0], *plain(r[1])) for r in rows())
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_rejects_a_bad_host(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "good" if i % 2 else "fine") for i in range(60)]
    bad = [(100 + i, "too short", "bad") for i in range(40)] + [(200, " ".join(f"v{j}" for j in range(30)), "bad")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(60)) and not kept[200] and not kept[100]


def test_simhash_against_brute_force(docs):
    def fingerprint(text):
        w = words(text)
        w = [x.lower() for x in w]
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(r[1]) for r in rows()]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows(), group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows(), prints, group, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(group))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    odd = ["<|endoftext|> a", "  x  y\n\n z ", "\ta b \n c", "it's we'll\x1c a\r\nb", "　x  ", " ", "\n", "日本 語", "don't  'll x\n\n\nq"]
    own = packing.encoder(packing.default_vocabulary())
    for text in odd + [r[1] or "" for r in rows()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    got = packing.pack(docs).collect()
    want = Counter()
    for r in rows():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024  # longer ones: whole sequences after the first piece
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : start + 1024] if piece else ids[:first]
            want[r[0], piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert max(k[1] for k in want) > 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r["length"] for r in got) // 1024) + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(toxic):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zzbad", "qqworse"]) if rng.random() < 0.5 else "hxvk" + rng.choice(clean))
        return " ".join(w)

    data = [(i, text(i % 6 == 0), "en", i % 6 == 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t, x, "s") for i, t, x, _ in data] + [(5000, None, None, None), (5001, "", "en", "s"), (None, "fine words", None, None)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, _, y in data] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: int(y) for i, _, _, y in data}
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.9
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    stems = {"en": "the th ing er on and re".split(), "de": "sch ung ein ich der keit en".split(), "fr": "eau oi que ment le ai ou".split()}
    data = [(i, " ".join("".join(rng.choice(stems[x]) for _ in range(rng.randint(1, 4))) for _ in range(30)), x) for i in range(240) for x in [list(stems)[i % 3]]]
    docs = spark.createDataFrame(data + [(900, None, "en"), (901, "123 !?", None), (902, "", None), (903, "the" * 3000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == 244
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "en"
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in data if got[i]["held_out"]]) > 0.95
    assert [r["lang_pred"] for r in langid.identify(docs.filter("lang is null")).collect()] == ["und"] * 3
    assert langid.identify(docs.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    model = langid.train(["the thing there", "ein ding dort"], ["en", "de"], langid.default_vocabulary())
    numbers = {p: i for i, p in enumerate(langid.vocabulary_pieces(model.vocabulary))}
    longest = max(map(len, numbers))

    def total(word, language):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, min(len(word), longest) + 1):
            i = numbers.get(word[:k])
            p = model.probabilities[i, language] if i is not None else langid.UNKNOWN if k == 1 else 0.0
            out += p and p * total(word[k:], language)
        return out

    scorer = langid.Scorer(model)
    scorer.score(["thing xöz there"])
    for word, row in scorer.items():
        for language in range(2):
            assert scorer.rows[row, language] == pytest.approx(np.log(total(langid.START + word.decode(), language)))
