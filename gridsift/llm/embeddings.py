"""Near-duplicate vectors by NN-descent (operator 3).

Every distinct vector keeps a list of its nearest known neighbours. The lists start from blocks of vectors that are
close in the order of random sign codes. They are refined round by round: a block of vectors gathers its neighbours
and those that name it as theirs, and all that meet there are compared, so that neighbours of neighbours find each
other; the next round goes on from the lists that changed, until hardly one does. A list that is full of links is enlarged.

Comparing happens in blocks whose results grow with their rows: the nearest few of each row, and a spanning forest of
all links at the threshold that the block holds. So no link that was ever seen is lost to the length of a list. The
forests make components. Two samples of bounded size, one of all vectors and one of those outside the largest
component, are compared with every vector of their label to audit them; links that the audit finds missing are added,
and as long as the recall is below its mark, another descent with other sign codes continues from the lists so far. As
all links of a vector lie in its component, an exact count follows there, in pairs of blocks, without listing the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, running_total, table
from gridsift.operators.spatial import connected

THRESHOLD = 0.98
#: Length of a neighbour list at first and when enlarged, and neighbours taken in reverse.
NEIGHBOURS, ENLARGED, REVERSE = 8, 32, 8
#: Sign codes of a descent, their bits, vectors compared along a code, and owners of lists that gather neighbours together.
CODES, BITS, ALONG, OWNERS = 4, 48, 1024, 256
#: A descent ends when a round changes less than this share of all list entries.
SETTLED = 0.01
#: Vectors in each sample of the audit; mean share of a vector's links that must be found, and the least that is accepted after PASSES descents.
AUDIT, RECALL, LEAST_RECALL, PASSES = 512, 0.995, 0.9, 6
#: In the exact count, a component has a block for each BLOCK distinct vectors up to SPLIT, then as many as keep a block within HELD bytes.
BLOCK, SPLIT, HELD = 1024, 4, 1 << 26
#: Similarities that are held at a time.
AT_ONCE = 1 << 20
FOUND = "u long, v long, sim double, link boolean, block long"


def classes(vectors: DataFrame, shelf: Shelf) -> DataFrame:
    """id, label, dim, vec, copies, first: the distinct usable vectors of each label; first is the smallest vec_id."""
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    found = vectors.select("vec_id", "label", F.col("embedding").alias("vec")).filter(usable)
    found = found.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    return shelf.put("classes", found.select(F.monotonically_increasing_id().alias("id"), "label", F.size("vec").alias("dim"), "vec", "copies", "first"))


def units(column: pa.Array) -> np.ndarray:
    """The vectors, all of one length, as double rows of length 1; scaled first so that squares neither overflow nor vanish."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of sorted batches; a run longer than twice `most` comes in parts of `most` rows."""
    kept: list[pa.RecordBatch] = []
    rows, key = 0, None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
        for low, high in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if low == high:
                continue
            if kept and values[low] != key:
                yield pa.Table.from_batches(kept)
                kept, rows = [], 0
            key = values[low]
            kept.append(batch.slice(low, high - low))
            rows += high - low
            while most and rows >= 2 * most:
                whole = pa.Table.from_batches(kept)
                yield whole.slice(0, most)
                kept, rows = whole.slice(most).to_batches(), rows - most
    if kept:
        yield pa.Table.from_batches(kept)


def forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The roots once the links (a, b) are added, and those of them that joined two trees."""
    used: list[tuple[int, int]] = []
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return root, used
        ra, rb = root[a], root[b]
        some = np.union1d(np.unique(ra, return_index=True)[1], np.unique(rb, return_index=True)[1])
        up = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y, i, j in zip(ra[some].tolist(), rb[some].tolist(), a[some].tolist(), b[some].tolist(), strict=True):
            if (x := top(x)) != (y := top(y)):
                up[max(x, y)] = min(x, y)
                used.append((i, j))
        moved = np.arange(len(root))
        moved[list(up)] = [top(x) for x in list(up)]
        root = moved[root]


def nearest(x: np.ndarray, ids: np.ndarray, threshold: float, least: np.ndarray, known: list[list[int]] | None = None) -> pa.RecordBatch:
    """FOUND for rows compared with each other: of each row, the nearest NEIGHBOURS beyond least that are not known, and the forest of links.

    ids are ascending where known is given, which holds the ids that each row's list has.
    """
    n, root, used = len(x), np.arange(len(x)), []
    us, vs, sims = [], [], []
    step = max(1, AT_ONCE // n)
    for low in range(0, n, step):
        high = min(n, low + step)
        near = x[low:high] @ x.T
        a, b = np.nonzero(near >= threshold)
        later = b > a + low
        if later.any():
            root, more = forest(a[later] + low, b[later], root)
            used += [(i, j, near[i - low, j]) for i, j in more]
        near[np.arange(high - low), np.arange(low, high)] = -2
        if known is not None:
            row = np.repeat(np.arange(high - low), [len(k) for k in known[low:high]])
            there = np.fromiter((i for k in known[low:high] for i in k), np.int64, len(row))
            at = np.minimum(np.searchsorted(ids, there), n - 1)
            here = ids[at] == there
            near[row[here], at[here]] = -2
        k = min(NEIGHBOURS, n)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, best, axis=1)
        row, col = np.nonzero(sim > least[low:high, None])
        us.append(row + low)
        vs.append(best[row, col])
        sims.append(sim[row, col])
    i, j, s = (np.array(c) for c in zip(*used, strict=True)) if used else (np.zeros(0, np.int64),) * 3
    u, v = np.concatenate([*us, i]).astype(np.int64), np.concatenate([*vs, j]).astype(np.int64)
    link = np.arange(len(u)) >= len(u) - len(i)
    return pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64()), pa.array(np.concatenate([*sims, s]).astype(float)), pa.array(link), pa.nulls(len(u), pa.int64())], ["u", "v", "sim", "link", "block"])


def along_codes(found: DataFrame, threshold: float, seed: int, codes: int) -> DataFrame:
    """FOUND from blocks of ALONG vectors in the order of each sign code; rows with a null v say which block of owners u belongs to."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            values = np.zeros((codes, len(dims)), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(codes, BITS, dim))
                x = units(batch.column("vec").take(pa.array(rows)))
                for t in range(codes):
                    values[t, rows] = (x @ planes[dim][t].T > 0) @ weights
            for t in range(codes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dims), t), pa.int32()), *(batch.column(c) for c in ("label", "dim")), pa.array(values[t]), *(batch.column(c) for c in ("id", "vec"))], ["t", "label", "dim", "code", "id", "vec"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in grouped(batches, ["t", "label", "dim"], ALONG):
            ids = block["id"].to_numpy()
            yield nearest(units(block["vec"].combine_chunks()), ids, threshold, np.full(len(ids), -1.5))
            if block["t"][0].as_py() == 0:
                places = number + np.arange(len(ids)) // OWNERS
                number = int(places[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64()), pa.array(np.zeros(len(ids), bool)), pa.array(places, pa.int64())], ["u", "v", "sim", "link", "block"])

    plain, order = found.select("label", "dim", "id", "vec"), ["t", "label", "dim", "code", "id"]
    kind = {f.name: f.dataType.simpleString() for f in plain.schema}
    rows = plain.mapInArrow(coded, f"t int, label {kind['label']}, dim int, code long, id long, vec {kind['vec']}")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, FOUND)


def listed(pairs: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """u, v, sim, k: the nearest k of pairs(u, v, sim) for each u; lengths(u, k) says k where it is not NEIGHBOURS."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    kept = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("place", place).filter(F.col("place") <= ENLARGED)
    kept = kept.withColumn("k", F.lit(NEIGHBOURS)) if lengths is None else kept.join(lengths, "u", "left").withColumn("k", F.coalesce("k", F.lit(NEIGHBOURS)))
    return kept.filter("place <= k").select("u", "v", "sim", "k")


def descend(found: DataFrame, shelf: Shelf, threshold: float, seed: int, before: DataFrame | None, keep: Callable[[DataFrame], None]) -> DataFrame:
    """Neighbour lists (see listed) after a descent; before: lists that it continues. keep gets the links (a, b) that each step saw."""
    start = shelf.put("start", along_codes(found, threshold, seed, CODES))
    links = lambda df: df.filter("link").select(F.col("u").alias("a"), F.col("v").alias("b"))
    keep(links(start))
    owners = shelf.put("owners", start.filter("v is null").select(F.col("u").alias("owner"), "block"))
    pairs = start.filter("v is not null").select("u", "v", "sim")
    lists = shelf.put("lists", listed(pairs if before is None else pairs.unionByName(before.select("u", "v", "sim")), None if before is None else before.select("u", "k").distinct()))
    changed = owners
    entries = max(1, lists.count())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, ["block"]):
            yield nearest(units(block["vec"].combine_chunks()), block["id"].to_numpy(), threshold, block["least"].to_numpy(), block["known"].to_pylist())

    while True:
        tops = lists.groupBy("u").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"), F.collect_list("v").alias("known"))
        full = F.col("n") >= F.col("k")
        wanted = F.when(full & (F.col("low") >= threshold), F.lit(ENLARGED)).otherwise(F.col("k"))  # nothing but links: a longer list
        tops = shelf.put("tops", tops.select("u", wanted.alias("k"), F.when((F.col("n") >= wanted), F.col("low")).otherwise(F.lit(-1.5)).alias("least"), "known"))
        back = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
        reverse = lists.withColumn("place", F.row_number().over(back)).filter(F.col("place") <= REVERSE).select(F.col("v").alias("owner"), F.col("u").alias("id"))
        around = lists.select(F.col("u").alias("owner"), F.col("v").alias("id")).union(reverse).union(owners.select("owner", F.col("owner").alias("id")))
        met = around.join(changed, "owner").select("block", "id").distinct()
        rows = met.join(found.select("id", "vec"), "id").join(tops.select(F.col("u").alias("id"), "least", "known"), "id", "left")
        rows = rows.withColumn("least", F.coalesce("least", F.lit(-1.5))).withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
        new = shelf.put("new", rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(compared, FOUND))
        keep(links(new))
        lists = shelf.put("lists", listed(new.filter("not link").select("u", "v", "sim").unionByName(lists.select("u", "v", "sim")), tops.select("u", "k")))
        fresh = lists.select("u", "v").join(new.filter("not link").select("u", "v").distinct(), ["u", "v"], "left_semi")
        changed = shelf.put("changed", fresh.groupBy(F.col("u").alias("owner")).agg(F.count(F.lit(1)).alias("n")).join(owners, "owner"))
        moved = changed.agg(F.sum("n").alias("n")).first()["n"] or 0
        changed = changed.select("owner", "block")
        if moved <= SETTLED * entries:
            break
    shelf.drop("start", "tops", "new", "changed", "owners")
    return lists


def audit(found: DataFrame, roots: DataFrame, threshold: float, size: int = AUDIT) -> tuple[float, DataFrame]:
    """The mean share of their links that audited vectors have within components, and the links (a, b) that lie across.

    Audited are size vectors of all and size of those outside the largest component, compared with all of their label.
    """
    largest = [r["root"] for r in roots.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()]
    inside = roots.filter(F.col("root").isin(largest)).select(F.col("node").alias("id"))
    turn = F.xxhash64("id")
    drawn = lambda df: df.orderBy(turn, "id").limit(size).select("id", "label", "dim", "vec")
    sample = {r["id"]: r for df in (found, found.join(inside, "id", "left_anti")) for r in drawn(df).collect()}
    by_key: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r["label"], r["dim"]) for r in sample.values()}:
        own = [r for r in sample.values() if (r["label"], r["dim"]) == key]
        by_key[key] = np.array([r["id"] for r in own]), units(pa.array([r["vec"] for r in own], pa.list_(pa.float64())))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grouped(iter([batch]), ["label", "dim"]):
                key = block["label"][0].as_py(), block["dim"][0].as_py()
                if key in by_key:
                    ids, x = by_key[key]
                    others = block["id"].to_numpy()
                    i, j = np.nonzero(units(block["vec"].combine_chunks()) @ x.T >= threshold)
                    a, b = ids[j], others[i]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    links = found.select("id", "label", "dim", "vec").sortWithinPartitions("label", "dim").mapInArrow(compared, "a long, b long")
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    placed = links.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumn("within", F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False)))
    shares = placed.groupBy("a").agg(F.avg(F.col("within").cast("double")).alias("share"))
    recall = shares.agg(F.avg("share").alias("recall")).first()["recall"]
    return 1.0 if recall is None else recall, placed.filter("not within").select("a", "b")


def counted(x: np.ndarray, copies: np.ndarray, ids: np.ndarray, held: int, threshold: float) -> pa.RecordBatch:
    """id, n for one unit of the exact count. The first `held` rows are a block and are compared with the rest, another block; without a rest, with each other."""
    n = len(x)
    counts = np.zeros(n)
    step = max(1, AT_ONCE // max(1, held))
    for low in range(held % n, n, step):
        high = min(n, low + step)
        first, last = (low, n) if held == n else (0, held)
        near = x[low:high] @ x[first:last].T >= threshold
        if held == n:  # each pair once
            near[:, : high - low] &= np.triu(np.ones((high - low, high - low), bool), 1)
        counts[low:high] += near @ copies[first:last]
        counts[first:last] += copies[low:high] @ near
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(counts[some].astype(np.int64))], ["id", "n"])


def count_links(found: DataFrame, roots: DataFrame, shelf: Shelf, threshold: float) -> DataFrame:
    """id, others: with how many vectors of other classes each class of a component is linked."""
    members = found.select("id", "dim", "vec", "copies").join(roots.select(F.col("node").alias("id"), "root"), "id").withColumn("turn", F.xxhash64("id"))
    placed = running_total(members.withColumn("part", F.shiftright("turn", 54)), ["root"], [F.col("turn"), F.col("id")], "part", F.lit(1), "rank")
    placed = shelf.put("placed", placed.select("root", "id", "vec", "copies", "rank"))
    blocks = F.greatest(F.least(F.lit(SPLIT), F.ceil(F.col("n") / BLOCK)), F.ceil(F.col("n") * F.col("dim") * 8 / HELD)).cast("int")
    groups = shelf.put("groups", members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).select("root", blocks.alias("blocks")))
    rows = placed.join(groups, "root").withColumn("block", (F.col("rank") % F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "vec", "copies")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, ["root", "i", "j"]):
            held = int((unit["block"].to_numpy() == unit["i"][0].as_py()).sum())
            yield counted(units(unit["vec"].combine_chunks()), unit["copies"].to_numpy(), unit["id"].to_numpy(), held, threshold)

    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "id")
    out = shelf.put("counts", dealt.mapInArrow(compared, "id long, n long").groupBy("id").agg(F.sum("n").alias("others")))
    shelf.drop("placed", "groups")
    return out


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of vectors.

    vectors needs vec_id, embedding and label; other columns are ignored. Rows compare only where labels are equal
    and not null and lengths are equal. Null or empty vectors, zero vectors and vectors with null or non-finite
    components link with nothing. Equal vectors are one class; its copies link with each other. Repeated rows
    count each; a component whose vec_ids are all null has a null component_id and keeps nothing. An empty table
    gives an empty result. Similarities that are equal at the end of a list go by id; links that a list has no room for stay in the forests. A similarity of exactly
    the threshold links. Raises RuntimeError if the audited recall stays below LEAST_RECALL.
    """
    shelf = Shelf(vectors.sparkSession, "vectors")
    found = classes(vectors, shelf)
    lists, edges = None, found.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    saved = 0

    def keep(links: DataFrame) -> None:
        nonlocal edges, saved
        saved += 1
        edges = edges.unionByName(shelf.put(f"links-{saved}", links))

    for number in range(1, PASSES + 1):
        lists = descend(found, shelf, threshold, number, lists, keep)
        roots = connected(edges, shelf, "vectors")
        recall, lost = audit(found, roots, threshold)
        keep(lost)
        if recall >= RECALL:
            break
    else:
        if recall < LEAST_RECALL:
            raise RuntimeError(f"NN-descent found {recall:.3f} of the audited links")
    if recall < 1:
        roots = connected(edges, shelf, "audited")
    counts = count_links(found, roots, shelf, threshold)
    linked = found.select("id", "first").join(roots.withColumnRenamed("node", "id"), "id")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(counts, "id", "left").join(least, "root").select("id", "others", "component_id")
    by_class = shelf.put("counted", found.select("id", "label", "vec", "copies", "first").join(linked, "id", "left").select(F.col("label").alias("_label"), "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    plain = vectors.select("vec_id", F.col("label").alias("_label"), F.col("embedding").alias("vec"))
    usable = plain.join(by_class, ["_label", "vec"], "left")
    known = F.col("n_links").isNotNull()
    out = usable.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(known, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors."""
    return link(table(spark, sf_dir, "embeddings"))
