"""A trie of conversation prefixes, built from chains (operator 13).

A prefix is a digest that grows by addition, so running sums in buckets give all prefixes of a conversation of any length.
The smallest conversation with a prefix owns its node. A conversation that owns a depth owns all its
deeper ones, so the first depth it owns is found by binary search, one batched join with the table of minima a round. What it owns
is a chain that hangs from a node of an earlier chain. Sums over subtrees are first made for chains,
bottom-up: in each round, chains take up what lies as far below them as was summed so far. Then they are made for nodes, along their chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import WORD, Shelf, table

#: First turns are taken over from the first conversation of each so many, and fewer than SHARED of them.
FAMILY, SHARED = 20, 4
#: Depths or ids of a bucket.
RANGE = 1024
SALTS = 64
ROUNDS = 3  # of the binary search between two tables written
NODE = ["c", "d"]


def looked_up(df: DataFrame, found: DataFrame, key: list[str], salt: Column) -> DataFrame:
    """df with the columns of found, which has one row a key. However many rows of df share a key, they meet it in SALTS places."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    places = df.select(*key, "_salt").distinct().join(found, key)
    return df.join(places, [*key, "_salt"], "left").drop("_salt")


def running(df: DataFrame, order: list[Column], bucket: str, values: list[str]) -> DataFrame:
    """df whose columns values are replaced by their running sums within c, in the order (bucket, order): within each bucket, and from a table with a row for each bucket but the first."""
    inner = Window.partitionBy("c", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("c", bucket).agg(*(F.sum(v).alias(f"_{v}") for v in values)).select("c", bucket, *(F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values))
    sums = sums.filter(F.col(f"_{values[0]}").isNotNull())
    within = df.withColumns({v: F.sum(v).over(inner) for v in values})
    return within.join(sums, ["c", bucket], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*(f"_{v}" for v in values))


def upward(df: DataFrame, values: list[str]) -> DataFrame:
    """df whose columns values are summed over their depth and those below of the same chain."""
    return running(df.withColumn("_bucket", -F.floor(F.col("d") / RANGE)), [F.col("d").desc()], "_bucket", values).drop("_bucket")


def turns(conversations: DataFrame) -> DataFrame:
    """c, at (place among the turns, from 1), u, v (digests of role and text) and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    out = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("u"), F.xxhash64(text, role, F.lit(1)).alias("v"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), role.alias("role"), text.alias("text"))
    out = out.withColumn("_bucket", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62)))).withColumn("at", F.lit(1).cast("long"))
    return running(out, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "_bucket", ["at"]).select("c", "at", "u", "v", "words")


def rebuilt(conversations: DataFrame, shelf: Shelf) -> DataFrame:
    """c, n (its turns), d (depth from 1), u, v, words: the turns of conversations whose first h come from the first of their family. And a row with d = 0 for each."""
    own = shelf.put("turns", turns(conversations))
    head = own.filter((F.col("c") % FAMILY == 0) & (F.col("at") < SHARED)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "u", "v", "words"))).alias("head"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("own")).withColumn("base", F.col("c") - F.col("c") % FAMILY).join(head, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,u:bigint,v:bigint,words:bigint>>")), F.lit(1), h.cast("int")))
    convs = shelf.put("convs", convs.select("c", "own", "head", (F.size("head") + F.greatest(F.col("own") - h, F.lit(0))).alias("n")))
    before = convs.select("c", "n", F.explode("head").alias("x")).select("c", "n", F.col("x.at").alias("d"), "x.u", "x.v", "x.words")
    # ranges of turns: a long conversation meets its row in many places
    shift = convs.select("c", "n", (F.size("head") - h).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / RANGE))).alias("range"))
    after = own.filter(F.col("at") > h).withColumn("range", F.floor(F.col("at") / RANGE)).join(shift, ["c", "range"])
    top = convs.select("c", "n", *(F.lit(0).cast("long").alias(x) for x in ("d", "u", "v", "words")))
    return top.unionByName(before).unionByName(after.select("c", "n", (F.col("at") + F.col("shift")).alias("d"), "u", "v", "words"))


def prefixes(rows: DataFrame) -> DataFrame:
    """c, n, d, p, q (digests of the first d turns) and words."""
    parts = [x for a in (F.xxhash64("u", "v", "d"), F.xxhash64("v", "u", "d")) for x in (a.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(a, 32))]
    names = [f"s{i}" for i in range(len(parts))]
    rows = rows.select("c", "n", "d", "words", F.floor(F.col("d") / RANGE).alias("_bucket"), *(F.when(F.col("d") > 0, x).otherwise(0).alias(s) for s, x in zip(names, parts)))
    return running(rows, [F.col("d")], "_bucket", names).select("c", "n", "d", F.xxhash64(*names).alias("p"), F.xxhash64(*names[::-1], F.lit(1)).alias("q"), "words")


def first_owned(ends: DataFrame, minima: DataFrame, shelf: Shelf) -> DataFrame:
    """c, n (its turns) and f, the first depth that it owns, n + 1 if it owns none."""
    state = ends.select("c", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    rounds = int((ends.agg(F.max("n")).first()[0] or 0) + 1).bit_length()
    for k in range(rounds):
        state = state.withColumn("d", F.floor((F.col("lo") + F.col("hi")) / 2))
        state = state.join(minima.select("c", "d", F.lit(True).alias("owns")), NODE, "left")
        open_, owns = F.col("lo") < F.col("hi"), F.coalesce("owns", F.lit(False))
        state = state.select("c", "n", F.when(open_ & ~owns, F.col("d") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & owns, F.col("d")).otherwise(F.col("hi")).alias("hi"))
        if k % ROUNDS == ROUNDS - 1 or k == rounds - 1:
            state = shelf.put("search", state)
    return state.select("c", "n", F.col("lo").alias("f"))


def ancestors(chains: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """c, up: the chains that the chains (c, parent) are below, 1, 2, 4 ... chains up, as long as there are any."""
    out = [chains.select("c", F.col("parent").alias("up"))]
    while True:
        nearer = out[-1]
        above = looked_up(nearer, nearer.select(F.col("c").alias("up"), F.col("up").alias("top")), ["up"], F.col("c"))
        above = shelf.put(f"above{len(out)}", above.filter("top is not null").select("c", F.col("top").alias("up")))
        if above.isEmpty():
            return out
        out.append(above)


def subtree_sums(sums: DataFrame, above: list[DataFrame], values: list[str], shelf: Shelf) -> DataFrame:
    """sums(c, values) of chains, summed over each chain and all below it: first those that hang from it, then those that are up to twice as far below, and so on."""
    for up in above:
        below = up.join(sums, "c").groupBy(F.col("up").alias("c")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        sums = shelf.put("sums", sums.join(below, "c", "left").select("c", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
    return sums


def id_digests(ends: DataFrame) -> DataFrame:
    """c, d and ends_sha256 of the ids that end at a node. Ids are joined a range at a time; one task goes through a node's ranges, and holds a few of them."""
    parts = ends.groupBy(*NODE, F.floor(F.col("id") / RANGE).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, so_far = None, None
        batch_of = lambda node, so_far: pa.RecordBatch.from_pylist([{"c": node[0], "d": node[1], "ends_sha256": so_far.hexdigest()}])
        for batch in batches:
            for c, d, ids in zip(*(batch.column(x).to_pylist() for x in ("c", "d", "ids"))):
                if (c, d) != node:
                    if node:
                        yield batch_of(node, so_far)
                    node, so_far = (c, d), hashlib.sha256(ids.encode())
                else:
                    so_far.update(b"," + ids.encode())
        if node:
            yield batch_of(node, so_far)

    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
    return parts.mapInArrow(digest, "c long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each distinct prefix of the rebuilt conversations.

    conversations needs conv_id and turn (integers), role and text; other columns are ignored. Rows without conv_id belong to no conversation and go.
    Turns are in the order of turn, null first, then of role and text; repeated rows are turns each. Null role or text is empty.
    An empty conversation is a member of the root, texts and conversations may have any length. An empty table gives an empty result, without a root.
    """
    shelf = Shelf(conversations.sparkSession, "trie")
    at = shelf.put("prefixes", prefixes(rebuilt(conversations, shelf)))
    owner = F.min(F.struct("c", "n"))
    minima = at.groupBy("d", "p", "q").agg(owner.alias("x"), F.max("words").alias("words"))
    minima = shelf.put("minima", minima.select("d", "p", "q", "x.c", "x.n", "words"))
    last = at.filter("d = n")
    chains = first_owned(last, minima, shelf)
    hangs = at.join(chains.filter("f between 1 and n").select("c", (F.col("f") - 1).alias("d")), NODE, "left_semi")
    # where conversations end and where chains hang, in one lookup
    asked = last.withColumn("end", F.lit(True)).unionByName(hangs.withColumn("end", F.lit(False))).select(F.col("c").alias("id"), "d", "p", "q", "end")
    places = shelf.put("places", looked_up(asked, minima.select("d", "p", "q", "c"), ["d", "p", "q"], F.col("id")).select("c", "d", "id", "end"))
    ends, hung = places.filter("end"), places.filter("not end")
    here = places.groupBy(*NODE).agg(F.sum(F.col("end").cast("long")).alias("n_convs"), F.sum((~F.col("end")).cast("long")).alias("hung"))
    nodes = minima.join(here, NODE, "left").na.fill(0, ["n_convs", "hung"])
    nodes = nodes.select("c", "d", "words", "n_convs", (F.col("hung") + (F.col("d") < F.col("n")).cast("long")).alias("n_children"))
    nodes = shelf.put("nodes", nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    parent = shelf.put("parents", hung.select(F.col("id").alias("c"), F.col("c").alias("parent"), F.col("d").alias("at")))
    above = ancestors(parent, shelf)

    def with_below(nodes: DataFrame, values: list[str]) -> DataFrame:
        """nodes whose values are summed over their subtrees: over all chains that hang from each, then along its own."""
        sums = subtree_sums(nodes.groupBy("c").agg(*(F.sum(v).alias(v) for v in values)), above, values, shelf)
        hanging = parent.join(sums, "c").groupBy(F.col("parent").alias("c"), F.col("at").alias("d")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        whole = nodes.join(hanging, NODE, "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*(f"_{v}" for v in values))
        return upward(whole, values)

    nodes = with_below(nodes, ["n_convs", "n_leaves"])
    nodes = shelf.put("counted", nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("words"))
    tops = parent.select("c", "parent", (F.col("at") + 1).alias("d"))
    out = with_below(nodes, ["saved_tokens"]).join(tops, NODE, "left").join(id_digests(ends), NODE, "left")
    over = F.when(F.col("d") > 0, F.coalesce("parent", "c"))
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), over.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 (polynomial 0xEDB88320) of the decimal id, bit by bit; prefixes as lists of turns.
ORACLE = r"""
with turns as (
    select conv_id as c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as s, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
    from conversations where conv_id is not null),
own as (select c, list(s order by i) as s from turns group by c),
shared as (
    select c, s, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), cast(4294967295 as bigint)) % 4 as h from own),
rebuilt as (select a.c, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) as s from shared a left join own b on b.c = a.c - a.c % 20),
prefixes as (select c, s[1:d] as k, d, len(s) = d as ends from (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt) x),
nodes as (
    select k, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256,
        case when d = 0 then 0 else len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) end as words
    from prefixes group by k, d),
with_parent as (select n.*, p.conv_id as parent_conv_id, p.k as pk from nodes n left join nodes p on n.d = p.d + 1 and p.k = n.k[1:n.d - 1]),
children as (select pk as k, count(*) as n_children from with_parent where pk is not null group by pk),
whole as (select w.*, coalesce(n_children, 0) as n_children from with_parent w left join children using (k)),
up as (select k[1:j] as k, n_convs, words, n_children from (select *, unnest(range(0, d + 1)) as j from whole) x),
sums as (select k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved from up group by k)
select conv_id, d as depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends_sha256 from whole join sums using (k)
"""
