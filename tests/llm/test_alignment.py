import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from gridsift.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers over whole texts: (id, bytes) of the tokens of a text, or None twice."""
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}

    def encode(text):
        if not text:
            return None
        a = [(i, bytes(as_byte[c] for c in byte_level.id_to_token(i))) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
        same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()
        return (a, b) if same else None

    return encode


def brute(texts, encode):
    groups = []
    for t in texts:
        found, sides = [], encode(t)
        if sides:
            ends = []
            for side in sides:
                at, e = [], 0
                for _, x in side:
                    e += len(x)
                    at.append(e)
                ends.append(at)
            start = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                found.append(tuple([i for (i, _), e in zip(side, at) if start < e <= cut] for side, at in zip(sides, ends)))
                start = cut
        groups.append(found)
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = [None, "", " ", "  ", "a", " a b  c   d ", "a\n\n b\t\tc \n", "▁", "x ▁ y", "a▁b c", "<unk> <s> </s> <0x41> <|endoftext|>x", "don't 's 'll we'd", "é ü ß 漢字 かな 😀😀 👩‍👩‍👧", "a b   c　 d", "\x1c \x1c a \x85 b", "é ́ x", "\x00 \x01", "1234567890 12 3", "=" * 90, "!?!? ... --- ,,,", " " * 1500 + "x", "The same words. The same words.", "ﬁ ½ ①", "﻿ a", "a ​ b"]


def test_same_as_whole_texts(spark, monkeypatch, whole):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    rng = random.Random(4)
    bits = [t for t in ODD if t and len(t) < 50] + ["word", "Étion dans", "lich ungheit", " the", ".", "\n"]
    texts = ODD + [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    rows = [(i if i % 7 else None, t, i, i) for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, chunk int, a int").repartition(3)).collect()
    values = lambda r: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
    want = brute(texts, whole)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *values(r)) for r in got) == sorted((-1 if i % 7 == 0 else i, *w) for i, w in enumerate(want))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (1, "")], "doc_id int, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


ALIGNER = alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t  \x1c'▁_.aé漢"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_texts_break_at_spaces(whole, text):
    """Stretches encoded one by one give the tokens of the whole text, or what they spell differs for both."""
    want = whole(text)
    got = ALIGNER.align([text])
    if want is None:
        assert got["groups_sha256"] == [""] and not got["n_a"].any()
    else:
        assert (got["n_a"][0], got["n_b"][0]) == (len(want[0]), len(want[1]))
        assert got["groups_sha256"][0] == brute([text], whole)[0][-1]
