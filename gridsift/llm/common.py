"""What the corpus operators share: tables, shared storage between steps, ranks over many tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.operators.storage import Store as Shelf

#: A word: a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: One part in so many, by the CRC-32 of doc_id as text, is held out from learning.
FOLDS = 5
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows Python workers get BATCH_BYTES at a time, or one row if that is longer: they hold a batch in memory.

    Spark has only a setting of the session for it, which is read when a result is computed, so it stays lowered. Batches of short rows are as before.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(setting).rstrip("bB")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df


def bucketed(shelf: Shelf, name: str, df: DataFrame, key: str) -> DataFrame:
    """df written to the shelf in buckets by key, one for each shuffle partition: joins and groups by key do not deal out its rows again."""
    spark = df.sparkSession
    shelf.made += 1
    n, path, known = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shelf.root}/{name}-{shelf.made}", f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # its name; the files belong to the shelf
    shelf.paths[name] = path
    return out


def row_keys() -> list[Column]:
    """_doc and _th, which are never null and tell all rows apart but those with equal doc_id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th")]


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select("*", *row_keys())


def with_row(docs: DataFrame) -> DataFrame:
    """_row, a struct of all columns of docs, and the row's keys: whatever docs' columns are called, they clash with none added later."""
    return docs.select(F.struct("*").alias("_row"), *row_keys())


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of _row (see with_row), maps by their sorted entries."""
    whole = lambda f: F.array_sort(F.map_entries(F.col("_row").getField(f.name))) if f.dataType.typeName() == "map" else F.col("_row").getField(f.name)
    return F.xxhash64(*map(whole, docs.schema.fields))


def attach(docs: DataFrame, decided: DataFrame, shelf: Shelf) -> DataFrame:
    """_row (see with_row) and the columns of decided, which has _doc and _th and at most as many rows of each as docs has.

    Rows that are equal in both are paired one to one, in the order of a hash of all their columns, so that reruns
    agree; rows of docs without a partner go.
    """
    key = ["_doc", "_th"]
    keyed = with_row(docs)
    repeated = shelf.put("repeated", keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    if repeated.isEmpty():
        return keyed.join(decided, key).drop(*key)
    numbered = lambda df, order: df.join(repeated, key, "left_semi").withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    once = keyed.join(repeated, key, "left_anti").join(decided, key)
    others = [c for c in decided.columns if c not in key]
    again = numbered(keyed, [row_hash(docs)]).join(numbered(decided, others or [F.lit(1)]), [*key, "_turn"])
    return once.unionByName(again.drop("_turn")).drop(*key)


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: str, value: Column, name: str) -> DataFrame:
    """Add the running sum of value within keys, in the order (bucket, order), without one task per key.

    bucket is an integer column that must be monotone in the wanted order; each (keys, bucket) is summed
    by itself and what lies in earlier buckets is added from a table with a row per (keys, bucket).
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    on = [*keys, bucket]
    return df.withColumn("_in", F.sum(value).over(inner)).join(totals, on).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def held_out(doc_id: Column) -> Column:
    """Whether a row is outside the part that labels are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
