import zlib
from collections import Counter, defaultdict

from gridsift.llm import sharding


def check(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assign(df, shards).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return got


def split(got):
    """Shards used by each group of equal texts."""
    out = defaultdict(set)
    for r in got:
        out[r["text_crc32"], r["size"]].add(r["shard"])
    return out


def test_groups_stay_together(spark):
    rows = [(i, f"pair {i // 2}" if i < 60 else f"own {i}", "x") for i in range(200)]
    assert all(len(s) == 1 for s in split(check(spark, rows, 4)).values())


def test_hot_group_is_split_over_few_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i % 90}", "x") for i in range(240)] + [(None, None, None)] * 3 + [(7, "same", None)] * 2
    hot = split(check(spark, rows, 8))[zlib.crc32(b"hot"), 4]
    assert len(hot) <= 4  # 80 rows, quotas of 30 and 31


def test_few_and_no_rows(spark):
    check(spark, [(1, "", None), (2, None, None), (3, "a" * 100_000, None)], 8)
    check(spark, [(1, "x", None)] * 40, 16)
    assert check(spark, [], 4) == []
