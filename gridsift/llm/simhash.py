"""SimHash near-dedup with pivot distance tables (operator 7).

A fingerprint's Hamming distances to fixed reference fingerprints are its coordinates. Two fingerprints that
differ in at most k bits have no coordinate that differs by more than k, so pairs are discarded by their
largest coordinate difference and only survivors are verified. Pairs are not taken from all rows: fingerprints
that differ in at most 3 of 64 bits agree in at least 3 of 6 fixed parts, so each meets others under 20 keys. Under a
key that many unlike fingerprints share, the first coordinates say which of them meet: each lies in a cell of the
pivot table, and only cells within k of a fingerprint are looked up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, attach, in_small_batches, table, with_keys
from gridsift.operators.spatial import connected

SHINGLE, SEED, RADIUS, PARTS = 3, 42, 3, 6
#: Coordinates that make the cells of the pivot table; a cell is as wide as the range that is looked up, so that range touches two at most.
CELLS = 4
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The reference fingerprints: hashes of their numbers. Two longs hold eight one-byte distances each.
PIVOTS = tuple(_signed(xxhash.xxh64_intdigest(f"pivot-{i}", SEED)) for i in range(16))
#: Masks of the parts kept under each key.
_EDGES = [64 * i // PARTS for i in range(PARTS + 1)]
MASKS = tuple(_signed(sum(((1 << (_EDGES[p + 1] - _EDGES[p])) - 1) << _EDGES[p] for p in kept)) for kept in itertools.combinations(range(PARTS), PARTS - RADIUS))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 where there is no word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n < shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - shingle]))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for i in range(0, len(values), CHUNK):
        part = values[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_doc", "_th")), pa.array(values.view(np.int64), pa.int64())], ["doc_id", "_doc", "_th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its row's keys and fp (the 64 bits as a long), one row per row of docs."""
    plain = in_small_batches(with_keys(docs.select("doc_id", "text")))
    return plain.mapInArrow(_fingerprinted, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, _doc long, _th long, fp long")


def _coordinates(fp: Column, pivots: tuple[int, ...]) -> Column:
    packed = F.lit(0).cast("long")
    for i, p in enumerate(pivots):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
    return packed


def pivoted(fp: Column) -> Column:
    """fp with its packed distances to the reference fingerprints: a row of the pivot table."""
    return F.struct(fp.alias("fp"), _coordinates(fp, PIVOTS[:8]).alias("p"), _coordinates(fp, PIVOTS[8:]).alias("q"))


def near(x: Column, y: Column, radius: int = RADIUS) -> Column:
    """Whether x and y, rows of the pivot table, differ in at most radius bits: first by coordinates, then exactly."""
    byte = lambda v, i: F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))
    apart = F.greatest(*(F.abs(byte(x[c], i) - byte(y[c], i)) for c in ("p", "q") for i in range(8)))
    return F.when(apart > radius, F.lit(False)).otherwise(F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)


def _coordinate(x: Column, i: int) -> Column:
    return F.shiftright(x["p"], 8 * i).bitwiseAND(F.lit(255))


def cell(x: Column, radius: int) -> Column:
    """The number of x's cell in the pivot table."""
    return sum((F.floor(_coordinate(x, i) / (2 * radius + 1)) * 256**i for i in range(1, CELLS)), F.floor(_coordinate(x, 0) / (2 * radius + 1)))


def cells_within(x: Column, radius: int) -> Column:
    """The numbers of the cells that hold whatever differs from x by at most radius in the first coordinates."""
    ends = [[F.floor((_coordinate(x, i) + d) / (2 * radius + 1)) * 256**i for d in (-radius, radius)] for i in range(CELLS)]
    return F.array_distinct(F.array(*(sum(c[1:], c[0]) for c in itertools.product(*ends))))


def link_components(fps: DataFrame, shelf: Shelf, radius: int = RADIUS) -> DataFrame:
    """node, root for the distinct fingerprints fps(fp) that link with others.

    Under each key the smallest and the largest fingerprint are compared with every member, and what is found
    is contracted. Then only members outside their key's largest component are compared with members of other
    components, those in the cells of the pivot table that are near enough, so the pairs within a group of near copies
    are never listed, and yet no link between two components is missed.
    """
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS))).alias("t", "key"))
    groups = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    groups = shelf.put("groups", groups.select("t", "key", "n", pivoted(F.col("low")).alias("low"), pivoted(F.col("high")).alias("high")))
    members = keyed.join(groups.filter("n > 2").select("t", "key", "low", "high").hint("merge"), ["t", "key"])  # the same plan at every size
    members = shelf.put("members", members.select("t", "key", pivoted(F.col("fp")).alias("x"), "low", "high"))
    edge = lambda x, y: (F.col(f"{x}.fp").alias("a"), F.col(f"{y}.fp").alias("b"))
    found = groups.filter(near(F.col("low"), F.col("high"), radius)).select(*edge("low", "high"))
    for end in ("low", "high"):
        found = found.unionByName(members.filter((F.col("x.fp") != F.col(f"{end}.fp")) & near(F.col("x"), F.col(end), radius)).select(*edge(end, "x")))
    first = connected(found, shelf, "near")
    placed = members.select("t", "key", "x", F.col("x.fp").alias("node")).join(first, "node", "left").select("t", "key", "x", F.coalesce("root", "node").alias("root"))
    placed = shelf.put("placed", placed)
    by_root = placed.groupBy("t", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("t", "key").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("t", "key", F.col("main.root").alias("main"))
    mixed = shelf.put("mixed", placed.join(mixed, ["t", "key"]))
    outside = mixed.filter("root != main").select("t", "key", F.explode(cells_within(F.col("x"), radius)).alias("cell"), F.col("x").alias("y"), F.col("root").alias("other"))
    more = outside.join(mixed.withColumn("cell", cell(F.col("x"), radius)), ["t", "key", "cell"]).filter((F.col("root") != F.col("other")) & near(F.col("x"), F.col("y"), radius)).select(F.col("root").alias("a"), F.col("other").alias("b"))
    second = connected(more, shelf, "far")
    out = shelf.put("roots", first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(second.join(first.select("node"), "node", "left_anti").select("node", "root")))
    shelf.drop("groups", "members", "placed", "mixed", "near-nodes", "far-nodes")
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id, one row per row of docs.

    docs needs doc_id and text; other columns are ignored. Null, empty or blank text: fingerprint zero, linked
    like any other. Texts shorter than a shingle hash as a whole. Null doc_id: the row is compared, but its
    doc_id never names a component; a component of such rows only has a null component_id. Repeated rows share
    a component. An empty table gives an empty result.
    """
    out = _named(docs, radius, Shelf(docs.sparkSession, "simhash"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(docs: DataFrame, radius: int, shelf: Shelf) -> DataFrame:
    """doc_id, the row's keys, fp, root (the component's smallest fingerprint) and component_id."""
    rows = shelf.put("rows", fingerprints(docs))
    fps = shelf.put("fps", rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = link_components(fps.select("fp"), shelf, radius)
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    alone = fps.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    names = shelf.put("names", linked.join(least, "root").select("fp", "root", F.col("least").alias("component_id")).unionByName(alone))
    return rows.join(names, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one for each group of near copies: one with the smallest doc_id, any where all are null.

    docs needs doc_id and text; all columns are kept, whatever they are called. Null, empty and blank texts are one group (fingerprint zero), texts of any length are taken whole.
    Of rows with equal doc_id the one with the smallest hash of its text stays, of rows equal in both the first by a hash of all columns, so that reruns agree. Empty docs: an empty result.
    """
    shelf = Shelf(docs.sparkSession, "simhash-kept")
    named = shelf.put("named", _named(docs, radius, shelf))
    known = named.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("_doc", "_th")).alias("row"))
    nameless = named.filter("component_id is null").groupBy("root").agg(F.min(F.struct("_doc", "_th")).alias("row"))
    kept = shelf.put("kept", known.unionByName(nameless).select("row.*"))
    return attach(docs, kept, shelf).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    return near_duplicates(table(spark, sf_dir, "documents"))
