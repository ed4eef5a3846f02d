"""Mixing sources to target weights by weighted fair queueing (operator 4, DataFrame functions only)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import WORD, Shelf, attach, running_total, table, with_keys

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words; no source and no document is taken more often than EPOCHS times.
BUDGET = Fraction(3, 2)
EPOCHS = 2
#: Documents of a source are dealt to so many parts of its shuffled order; finish times to so many per unit, at each level.
PARTS, SLOTS = 1024, 512


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, n_source: shares of the budget by weight, capped at epochs times the size (water-filling).

    The window functions here run over one row per source.
    """
    p, q = budget.numerator, budget.denominator
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("n_source", F.row_number().over(by_name).cast("long")).withColumn("w", w.cast("long"))
    out = out.withColumn("cap", F.lit(epochs) * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    by_ratio = Window.orderBy("ratio", "n_source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    out = out.withColumn("level", (F.lit(p) * F.sum("source_size").over(everything) - F.lit(q) * before("cap")).cast("double") / (F.lit(q) * (F.sum("w").over(everything) - before("w"))).cast("double"))
    water = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return out.withColumn("target", F.least(F.col("cap").cast("double"), water * F.col("w").cast("double"))).select("source", "source_size", "n_source", "target")


def mix(docs: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, epochs_taken.

    docs needs doc_id, text and source; other columns are ignored. Each source is shuffled by the md5 of
    doc_id; a document's k-th copy finishes at (words of its source up to it, k earlier passes included) /
    target. All copies are put in the order of finish times, range by range, and those within the budget
    are taken whole. Null text: size 0. Null source: a source of its own, last in order. Null doc_id: shuffled
    as the text 'null'. Repeated rows are separate documents. An empty table gives an empty result.
    """
    return _mixed(docs, weights, budget, epochs, Shelf(docs.sparkSession, "mix")).drop("_doc", "_th")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken.

    docs needs doc_id, source and text; all columns are kept, whatever they are called. Null source is a source of its own, null, empty and blank texts have no words and are not taken.
    Ties of virtual time go by doc_id and the text's hash; repeated rows are taken each. Empty docs: an empty result.
    """
    shelf = Shelf(docs.sparkSession, "mixed")
    taken = shelf.put("taken", _mixed(docs, weights, budget, epochs, shelf).filter("epochs_taken > 0").select("_doc", "_th", F.col("epochs_taken").alias("_epochs")))
    return attach(docs, taken, shelf).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_epochs")))).select("_row.*")


def _mixed(docs: DataFrame, weights, budget: Fraction, epochs: int, shelf: Shelf) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = shelf.put("sized", with_keys(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_doc", "_th", size.alias("size")))
    targets = shelf.put("targets", source_targets(sized, weights, budget, epochs))
    turn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = placed.withColumn("turn", turn).withColumn("part", (F.conv(F.substring("turn", 1, 5), 16, 10).cast("long") / F.lit(2**20 // PARTS)).cast("int"))
    order = [F.col("turn"), F.col("doc_id"), F.col("size")]
    placed = running_total(placed, ["n_source"], order, "part", F.col("size"), "upto")
    seq = Window.partitionBy("n_source", "part").orderBy(*order)
    placed = shelf.put("placed", placed.withColumn("seq", F.row_number().over(seq)).drop("turn"))

    if placed.isEmpty():
        return placed.select("doc_id", "source", "size", "source_size", "target", F.col("size").alias("taken"), F.lit(0).cast("long").alias("epochs_taken"), "_doc", "_th")

    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("finish", F.when(F.col("target") > 0, (F.col("upto") + F.col("epoch") * F.col("source_size")).cast("double") / F.col("target")).otherwise(F.lit(0.0)))
    limit, spent = placed.agg((F.coalesce(F.sum("size"), F.lit(0)) * budget.numerator).alias("limit")), F.lit(0).cast("long")
    state = shelf.put("state-0", limit.withColumn("spent", spent).withColumn("slot0", F.lit(0).cast("long")))
    q = budget.denominator
    for level in (1, 2):  # narrow the cut down to one slot, then to a slot of that slot
        slot = F.floor(F.col("finish") * F.lit(float(SLOTS**level))).cast("long")
        inside = copies.withColumn("slot", slot)
        if level == 2:
            inside = inside.filter(F.floor(F.col("finish") * F.lit(float(SLOTS))).cast("long") == F.lit(state.first()["slot"]))
        sums = inside.groupBy("slot").agg(F.sum("size").alias("words")).crossJoin(F.broadcast(state.select("limit", "spent")))
        run = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("all", F.col("spent") + F.sum("words").over(run)).withColumn("over", F.col("all") * q > F.col("limit"))
        cut = sums.groupBy("limit").agg(F.min(F.when(F.col("over"), F.col("slot"))).alias("slot"), F.max(F.struct("slot", "all")).alias("end"), F.min_by(F.col("all") - F.col("words"), F.when(F.col("over"), F.col("slot"))).alias("spent"))
        state = shelf.put(f"state-{level}", cut.select("limit", F.coalesce("slot", F.col("end.slot") + 1).alias("slot"), F.coalesce("spent", "end.all").alias("spent")))
    found = state.first()
    fine, spent, limit = (found["slot"], found["spent"], found["limit"]) if found else (0, 0, 0)
    slot = F.floor(F.col("finish") * F.lit(float(SLOTS**2))).cast("long")
    copies = copies.withColumn("slot", slot)
    key = ["n_source", "part", "seq", "epoch"]
    edge = copies.filter(F.col("slot") == fine).withColumn("all", F.sum("size").over(Window.orderBy("finish", *key).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent))
    taken = copies.filter(F.col("slot") < fine).select("n_source", "part", "seq").unionByName(edge.filter(F.col("all") * q <= F.lit(limit)).select("n_source", "part", "seq"))
    counts = taken.groupBy("n_source", "part", "seq").agg(F.count(F.lit(1)).alias("epochs_taken"))
    out = placed.join(counts, ["n_source", "part", "seq"], "left").withColumn("epochs_taken", F.coalesce("epochs_taken", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs_taken")).alias("taken"), "epochs_taken", "_doc", "_th")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with the production weights."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
named as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as n_source from sized group by source),
weighed as (
  select *, case (n_source - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 2 * source_size as cap from named),
rated as (select *, cast(cap as double) / cast(w as double) as ratio from weighed),
levelled as (
  select *, cast(3 * sum(source_size) over () - 2 * coalesce(sum(cap) over (order by ratio, n_source rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(2 * (sum(w) over () - coalesce(sum(w) over (order by ratio, n_source rows between unbounded preceding and 1 preceding), 0)) as double) as level from rated),
targets as (
  select source, source_size, n_source,
    least(cast(cap as double), max(case when level <= ratio then level end) over () * cast(w as double)) as target from levelled),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.n_source, md5(coalesce(cast(s.doc_id as varchar), 'null')) as turn,
    sum(s.size) over w as upto, row_number() over w as seq
  from sized s join targets t on s.source is not distinct from t.source
  window w as (partition by t.n_source order by md5(coalesce(cast(s.doc_id as varchar), 'null')), s.doc_id, s.size rows between unbounded preceding and current row)),
copies as (
  select *, case when target > 0 then cast(upto + epoch * source_size as double) / target else 0 end as finish
  from placed cross join (values (0), (1)) e(epoch)),
queue as (
  select *, sum(size) over (order by finish, n_source, seq, epoch rows between unbounded preceding and current row) as spent,
    (select 3 * coalesce(sum(size), 0) from sized) as budget2 from copies)
select doc_id, size, source_size, target, cast(sum(case when 2 * spent <= budget2 then size else 0 end) as bigint) as taken
from queue group by doc_id, size, source_size, target, n_source, seq
"""
