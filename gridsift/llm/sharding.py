"""Sharding by balanced label propagation (operator 10).

Rows with equal texts are linked. Every row starts with a shard as its label, groups dealt round. In each round,
linked rows move to the shard where most of their neighbours are, as far as quotas allow, until no move is left. As
rows of a group are interchangeable, a group is held as its number of rows in each shard, which is what its links
amount to. While labels move, quotas are a little larger; what is then too much in a shard goes to others, which cuts
few groups. Rows without links fill the shards, so that the numbers of rows differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, running_total, table

SHARDS, PARTS = 16, 1024
#: Share of a quota by which a shard may be too full while labels move.
SLACK = 0.25
#: Of the groups that lie in one shard, so many times the rows that need their place, and so many at least, offer to change.
OFFERED, LEAST_OFFERED = 3, 1000
LAW = "rows"


def _quotas(rows: DataFrame, shards: int) -> DataFrame:
    """shard, quota: how many rows each shard gets."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    each = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return each.select("shard", (F.floor(F.col("n") / shards) + (F.col("shard") < F.col("n") % shards).cast("long")).alias("quota"))


def circulation(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to go from one shard to another may go, so that no shard gets more than it gives away and has room for.

    Room is a further node that a full shard's rows never need; cycles are served one after the other until none is left.
    """
    left = {k: n for k, n in asked.items() if n > 0} | {(t, None): n for t, n in room.items() if n > 0}
    served = dict.fromkeys(asked, 0)
    for s, t in sorted(asked):
        while left.get((s, t), 0) > 0:
            came, todo = {t: None}, [t]  # the shortest way back from t to s
            while todo and s not in came:
                x, todo = todo[0], todo[1:]
                for y in [y for (z, y), n in left.items() if z == x and n > 0] + ([s] if x is None else []):
                    if y not in came:
                        came[y] = x
                        todo.append(y)
            if s not in came:
                break
            way, x = [(s, t)], s
            while x != t:
                way.append((came[x], x))
                x = came[x]
            n = min(left[k] for k in way if k[0] is not None)
            for k in way:
                if k[0] is not None:
                    left[k] -= n
                if k in served:
                    served[k] += n
    return served


def propagate(cells: DataFrame, quotas: DataFrame, shelf: Shelf) -> DataFrame:
    """cells(g, shard, n) after label propagation: of group g, n rows are in the shard. quotas has a row per shard.

    Apart from shards that it fills, a group's homes are its largest cells, one for each shard's worth of rows. In a round, all rows outside them ask to
    move there. What is asked between shards (at most a number for each pair of them, which the driver collects) is
    served as far as it goes round or the targets have room, then as far as groups that lie whole in the target change
    places; the rows that join the most go first. Homes are asked in turn from round to round. The sum of squares of all cells grows with each row that moves home,
    so rounds end: when no rows ask or none can move.
    """
    spark = cells.sparkSession
    by_size, whole = Window.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "shard")), Window.partitionBy("g")
    quota = {r["shard"]: r["quota"] for r in quotas.collect()}  # a row per shard
    number = idle = 0
    while True:
        number += 1
        seen = cells.join(F.broadcast(quotas), "shard").filter("n < quota").drop("quota")
        seen = seen.withColumn("place", F.row_number().over(by_size)).withColumn("cells", F.count(F.lit(1)).over(whole))
        seen = seen.withColumn("homes", F.least(F.col("cells"), F.ceil(F.sum("n").over(whole) / F.lit(max(1, *quota.values())))).cast("int"))
        home = F.array_sort(F.collect_list(F.when(F.col("place") <= F.col("homes"), F.struct("place", "shard", "n"))).over(whole))
        asked = seen.withColumn("home", home).filter("place > homes").withColumn("to", F.element_at("home", (F.col("place") - F.col("homes") - 1 + F.lit(number)) % F.col("homes") + 1))
        asked = shelf.put("asked", asked.select("g", "shard", "n", "homes", F.col("to.shard").alias("to"), F.col("to.n").alias("joins"), F.xxhash64("g").alias("turn")))
        between = asked.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.max("homes").alias("homes")).collect()
        flows = {(r["shard"], r["to"]): r["n"] for r in between}
        if not flows:
            break
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        served = circulation(flows, {t: n + max(1, int(SLACK * n)) - load.get(t, 0) for t, n in quota.items()})

        # groups that lie whole in a shard where rows still want to go offer to go where these come from
        unmet = [(t, s, n - served[s, t]) for (s, t), n in sorted(flows.items()) if n > served[s, t]]
        moves = []
        if unmet:
            wanted = {t: sum(n for x, _, n in unmet if x == t) for t, _, _ in unmet}
            wanting = [(t, max(LEAST_OFFERED, OFFERED * n) / load[t], [{"to": s, "unmet": m} for x, s, m in unmet if x == t]) for t, n in wanted.items()]
            wanting = spark.createDataFrame(wanting, "shard int, share double, from array<struct<to int, unmet long>>")
            alone = cells.groupBy("g").agg(F.count(F.lit(1)).alias("cells"), F.first("shard").alias("shard"), F.sum("n").alias("n")).filter("cells = 1").drop("cells")
            drawn = F.pmod(F.xxhash64("g", F.lit(number)), F.lit(1 << 20)) / F.lit(float(1 << 20))
            offers = alone.join(F.broadcast(wanting), "shard").filter(drawn < F.col("share")).withColumn("turn", F.xxhash64("g", F.lit(-number)))
            offers = offers.withColumn("to", F.element_at("from", (F.pmod("turn", F.size("from")) + 1).cast("int"))).filter(F.col("n") <= F.col("to.unmet"))
            offers = offers.select("g", "shard", "n", F.col("to.to").alias("to"), F.col("to.unmet").alias("most"), "turn", (F.floor(F.log2(F.col("n").cast("double"))) * PARTS + F.shiftright("turn", 54) + PARTS // 2).cast("int").alias("bucket"))
            offers = shelf.put("offers", offers)
            offers = running_total(offers, ["shard", "to"], [F.col("n"), F.col("turn"), F.col("g")], "bucket", F.col("n"), "upto").filter("upto <= most")
            offers = shelf.put("accepted", offers.select("g", "shard", "to", F.col("n").alias("moved")))
            for r in offers.groupBy("shard", "to").agg(F.sum("moved").alias("n")).collect():
                served[r["to"], r["shard"]] += r["n"]
            moves.append(offers)
        if not any(served.values()):
            idle += 1
            if idle >= max(r["homes"] for r in between):
                break  # every home was asked
            continue
        idle = 0
        flows = spark.createDataFrame([(s, t, n) for (s, t), n in served.items()], "shard int, to int, served long")
        asked = asked.withColumn("bucket", ((F.lit(64) - F.floor(F.log2(F.col("joins").cast("double")))) * PARTS + F.shiftright("turn", 54) + PARTS // 2).cast("int"))
        home = running_total(asked, ["shard", "to"], [F.col("turn"), F.col("g")], "bucket", F.col("n"), "upto").join(F.broadcast(flows), ["shard", "to"])
        home = home.withColumn("moved", F.least(F.col("n"), F.col("served") - (F.col("upto") - F.col("n")))).filter("moved > 0").select("g", "shard", "to", "moved")
        for m in (shelf.put("moves", home), *moves):
            cells = cells.unionByName(m.select("g", "shard", (-F.col("moved")).alias("n"))).unionByName(m.select("g", F.col("to").alias("shard"), F.col("moved").alias("n")))
        cells = shelf.put("cells", cells.groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    shelf.drop("asked", "offers", "accepted", "moves")
    return cells


def fit(cells: DataFrame, quotas: DataFrame, shelf: Shelf) -> DataFrame:
    """cells without more rows in a shard than its quota: small groups leave first and are laid out in a line over the places that are free."""
    size = (F.lit(64) - F.floor(F.log2(F.col("n").cast("double")))) * PARTS + F.shiftright(F.xxhash64("g"), 54) + PARTS // 2
    upto = running_total(cells.withColumn("bucket", size.cast("int")), ["shard"], [F.col("g")], "bucket", F.col("n"), "upto").join(F.broadcast(quotas), "shard")
    stays = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - (F.col("upto") - F.col("n"))))
    parts = shelf.put("parts", upto.select("g", "shard", stays.alias("n"), (F.col("n") - stays).alias("extra")))
    extra = parts.filter("extra > 0").groupBy("g").agg(F.sum("extra").alias("extra")).withColumn("all", F.lit(0)).withColumn("bucket", F.shiftright(F.xxhash64("g"), 54))
    extra = running_total(extra, ["all"], [F.col("g")], "bucket", F.col("extra"), "upto").withColumn("first", F.col("upto") - F.col("extra"))
    free = _free(quotas, parts.groupBy("shard").agg(F.sum("n").alias("load")))
    moved = extra.join(F.broadcast(free), (F.col("first") < F.col("to")) & (F.col("upto") > F.col("from")))
    moved = moved.select("g", "shard", (F.least("upto", "to") - F.greatest("first", "from")).alias("n"))
    return shelf.put("cells", parts.select("g", "shard", "n").unionByName(moved).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))


def _free(quotas: DataFrame, loads: DataFrame) -> DataFrame:
    """shard, from, to: the places that loads(shard, load) leave free, one shard's after the other's."""
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # a row per shard
    free = quotas.join(loads, "shard", "left").withColumn("free", F.col("quota") - F.coalesce("load", F.lit(0)))
    return free.withColumn("to", F.sum("free").over(by_shard)).select("shard", (F.col("to") - F.col("free")).alias("from"), "to")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row per row of docs.

    docs needs doc_id and text; other columns are ignored. size is the text's UTF-8 bytes plus 1. Null text has no
    bytes and is a group of its own. A group larger than a shard is split over as few shards as have room. Null
    doc_id is allowed. Repeated rows count each; ties between shards go to the smaller number. Texts of any length count whole. With fewer rows than shards some shards stay empty. An empty
    table gives an empty result. The law is `rows`, so grown_shard is null.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "shards")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("g"))
    rows = shelf.put("rows", rows.withColumn("g", F.unhex(F.when(F.col("g") == "null", F.lit("00")).otherwise(F.col("g")))).withColumn("turn", F.xxhash64("doc_id", "g")))
    rows = rows.withColumn("part", F.shiftright("turn", 54) + 512)
    quotas = shelf.put("quotas", _quotas(rows, shards))
    groups = shelf.put("groups", rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    # labels to start from: the rows of one group after the other, dealt round, so that no shard has more than its quota
    at = groups.withColumn("all", F.lit(0)).withColumn("bucket", F.shiftright(F.xxhash64("g"), 54))
    at = running_total(at, ["all"], [F.col("g")], "bucket", F.col("rows"), "upto").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = lambda n: F.floor((n - 1 - F.col("shard")) / shards)
    start = at.select("g", "shard", (dealt(F.col("upto")) - dealt(F.col("upto") - F.col("rows"))).alias("n")).filter("n > 0")
    start = shelf.put("cells", start)
    cells = fit(propagate(start, quotas, shelf), quotas, shelf)
    spans = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    cells = shelf.put("spans", cells.withColumn("to", F.sum("n").over(spans)).withColumn("from", F.col("to") - F.col("n")))

    order = [F.col("turn"), F.col("doc_id"), F.col("size")]
    linked = running_total(rows.join(groups.select("g"), "g", "left_semi"), ["g"], order, "part", F.lit(1), "rank")
    spans = cells.select(F.col("g").alias("_g"), "shard", "from", "to")
    linked = linked.join(spans, (F.col("g") == F.col("_g")) & (F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("to"))).select("doc_id", "size", "text_crc32", "turn", "part", "shard")
    loads = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    free = _free(quotas, loads)
    single = rows.join(groups.select("g"), "g", "left_anti").withColumn("all", F.lit(0))
    single = running_total(single, ["all"], order, "part", F.lit(1), "rank")
    single = single.join(F.broadcast(free), (F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("to"))).select(*linked.columns)
    placed = shelf.put("placed", linked.unionByName(single))
    out = running_total(placed, ["shard"], [*order, F.col("text_crc32")], "part", F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return assign(table(spark, sf_dir, "documents"))
