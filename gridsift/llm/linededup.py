"""Removal of repeated runs of lines by a suffix array over line numbers (operator 1, DataFrame functions only).

Lines get numbers, documents become sequences of them, and distributed prefix doubling ranks all suffixes by
their first 1, 2, 4 ... lines: the rank of twice as many lines is that of a pair of ranks. A rank is a place
in the suffix array: a pair's is that of its first half, plus the suffixes of that interval whose second half is less.
Suffixes with equal rank are an interval of the suffix array whose longest common prefix is at least that long. A run of m lines is
covered by two runs of 2**j <= m lines, so the pair of their ranks tells whether it repeats.

A line goes if it lies in a run of at least min_words words that has an earlier copy. For that it is enough to
test, at each line, the shortest such run that starts and the shortest that ends there: together they cover
every maximal repeated run. So no more doubling is needed than up to min_words lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm.common import WORD, Shelf, row_hash, running_total, table, with_row

MIN_WORDS = 50
BUCKETS = 1024
DOC = ["doc", "th"]


def _doc() -> Column:
    """doc_id as a key that is never null: null comes before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _ranked(groups: DataFrame, within: list[str], order: list[str], bucket: Column) -> DataFrame:
    """within, order and rank: how many rows of groups(within, order, n) with the same `within` come before, the buckets' ranges one after the other."""
    return running_total(groups.withColumn("bucket", bucket), within, [F.col(c) for c in order], "bucket", F.col("n"), "upto").withColumn("rank", F.col("upto") - F.col("n")).drop("n", "upto")


def _shared(rows: DataFrame, keys: list[str], shelf: Shelf, name: str) -> DataFrame:
    """keys and n: the values that n > 1 rows share."""
    return shelf.put(name, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc (see _doc), th (hash of the text), n (place among lines with a word), at (place among all lines), a, b (hashes of the line), words.

    One row per line with a word of each distinct (doc_id, text).
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(lines).alias("n", "x"))
    return out.select(*DOC, "n", F.col("x.at").alias("at"), F.xxhash64("x.line").alias("a"), F.hash("x.line").alias("b"), F.regexp_count("x.line", F.lit(WORD)).cast("long").alias("words"))


def repeated_ranges(docs: DataFrame, min_words: int, shelf: Shelf) -> DataFrame:
    """doc, th, start, end: the lines to delete, as ranges of places among all lines, for each distinct (doc_id, text)."""
    lines = shelf.put("lines", numbered_lines(docs.filter("text is not null")).dropDuplicates([*DOC, "n"]))
    names = _shared(lines, ["a", "b"], shelf, "names").withColumn("all", F.lit(0))
    ranks = _ranked(names, ["all"], ["a", "b"], F.shiftright("a", 54)).drop("all")
    kept = lines.join(ranks.hint("merge"), ["a", "b"]).withColumnRenamed("rank", "r0").drop("a", "b")
    by_doc = Window.partitionBy(*DOC).orderBy("n")
    kept = kept.withColumn("seg", F.col("n") - F.row_number().over(by_doc))
    seq = Window.partitionBy(*DOC, "seg").orderBy("n")
    kept = kept.withColumn("b0", F.sum("words").over(seq.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    total, span = F.sum("words").over(Window.partitionBy(*DOC, "seg")), Window.partitionBy(*DOC, "seg").orderBy("b0")
    end = F.col("b0") + F.col("words")
    back = Window.partitionBy(*DOC, "seg").orderBy("e0")
    kept = kept.withColumn("e0", end).withColumn("total", total)
    # lines of the shortest run that starts here, and of the shortest that ends here
    kept = kept.withColumn("ahead", F.when(F.col("total") - F.col("b0") >= min_words, F.count(F.lit(1)).over(span.rangeBetween(1, min_words - 1)) + 1))
    kept = kept.withColumn("behind", F.when(F.col("e0") >= min_words, F.count(F.lit(1)).over(back.rangeBetween(-(min_words - 1), -1)) + 1))
    kept = shelf.put("ranked", kept.select(*DOC, "seg", "n", "at", "ahead", "behind", "r0"))
    levels = max(0, min_words.bit_length() - 1)
    size = kept.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    for j in range(levels):
        twice = kept.withColumn("next", F.lead(f"r{j}", 1 << j).over(seq))
        twice = shelf.put("pairs", twice)
        # suffixes that share 2**j lines are an interval of the suffix array that starts at their rank; what follows orders them in it
        pairs = _shared(twice.filter(F.col(f"r{j}").isNotNull() & F.col("next").isNotNull()), [f"r{j}", "next"], shelf, "pair-ranks")
        pairs = _ranked(pairs, [f"r{j}"], ["next"], (F.col("next") * BUCKETS / F.lit(size + 1)).cast("int"))
        pairs = pairs.select(f"r{j}", "next", (F.col(f"r{j}") + F.col("rank")).alias(f"r{j + 1}"))
        kept = twice.join(pairs, [f"r{j}", "next"], "left").drop("next")
        kept = shelf.put("ranked", kept)
    if levels == 0:
        kept = shelf.put("ranked", kept)
    ranks_of = F.array(*(F.col(f"r{j}") for j in range(levels + 1)))
    at_level = lambda m, r: F.element_at(r, (F.floor(F.log2(m.cast("double"))) + 1).cast("int"))
    runs = kept.select(*DOC, F.col("n").alias("first"), F.col("ahead").alias("m")).filter("m is not null").unionByName(kept.select(*DOC, (F.col("n") - F.col("behind") + 1).alias("first"), F.col("behind").alias("m")).filter("m is not null")).distinct()
    where = kept.select(*DOC, "n", ranks_of.alias("ranks"))
    runs = runs.join(where.withColumnRenamed("n", "first"), [*DOC, "first"]).withColumn("x", at_level(F.col("m"), F.col("ranks"))).drop("ranks").filter("x is not null")
    half = F.pow(F.lit(2.0), F.floor(F.log2(F.col("m").cast("double")))).cast("int")
    runs = runs.withColumn("n", (F.col("first") + F.col("m") - half).cast("int")).join(where, [*DOC, "n"]).withColumn("y", at_level(F.col("m"), F.col("ranks"))).drop("ranks", "n").filter("y is not null")
    runs = shelf.put("runs", runs)
    origin = runs.groupBy("m", "x", "y").agg(F.min(F.struct(*DOC, "first")).alias("origin"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    origin = shelf.put("origin", origin)  # both sides of the next join are then read from exchanges, which can be split
    later = runs.join(origin.hint("merge"), ["m", "x", "y"]).filter(F.struct(*DOC, "first") > F.col("origin"))
    later = later.groupBy(*DOC, F.col("first").alias("n")).agg(F.max("m").alias("m"))
    reach = F.max(F.col("n") + F.col("m")).over(seq.rowsBetween(Window.unboundedPreceding, 0))
    dead = kept.select(*DOC, "seg", "n", "at").join(later, [*DOC, "n"], "left").withColumn("reach", reach).filter("reach > n")
    dead = dead.withColumn("island", F.col("n") - F.row_number().over(seq))
    out = dead.groupBy(*DOC, "seg", "island").agg(F.min("at").alias("start"), F.max("at").alias("end")).select(*DOC, "start", "end")
    out = shelf.put("ranges", out)
    shelf.drop("lines", "names", "pairs", "pair-ranks", "ranked", "runs", "origin")
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, spans: str | None = "removed_lines") -> DataFrame:
    """The columns of docs with repeated runs deleted from text, and spans: array<struct<start, end>> of deleted line numbers.

    docs needs doc_id and text; all columns are kept, but one with the name spans is replaced; without a name there is
    no such column. Documents are ordered
    by doc_id (an integer; null first), then by a hash of the text; the first copy of a run stays. Runs are compared line by
    line, without lines that have no word; such lines go if they lie within a deleted run. Null text stays null.
    Repeated rows (equal doc_id and text): the later ones are copies as a whole. A text whose lines all go becomes
    empty. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "lines")
    ranges = repeated_ranges(docs.select("doc_id", "text"), min_words, shelf)
    key = ["_doc", "_th"]
    per_doc = shelf.put("per-doc", ranges.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")))
    keyed, text = with_row(docs), F.col("_row.text")
    repeated = shelf.put("repeated", keyed.filter(text.isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    out = keyed.join(per_doc.hint("merge"), key, "left")  # never broadcast: it grows with the corpus
    if not repeated.isEmpty():
        again, once = out.join(repeated, key, "left_semi"), out.join(repeated, key, "left_anti")
        n = F.row_number().over(Window.partitionBy(*key).orderBy(row_hash(docs)))
        whole = F.array(F.struct(F.lit(0).alias("start"), (F.size(F.split(text, "\n")) - 1).alias("end")))
        again = again.withColumn("_n", n).withColumn("gone", F.when((F.col("_n") > 1) & (F.regexp_count(text, F.lit(WORD)) >= min_words), whole).otherwise(F.col("gone"))).drop("_n")
        out = once.unionByName(again)
    lines = F.split(text, "\n")
    # what stays: before the first range, between ranges, after the last
    edges = F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), F.col("gone"), F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("end"))))
    gaps = F.zip_with(F.slice(edges, F.lit(1), F.size("gone") + 1), F.slice(edges, F.lit(2), F.size("gone") + 1), lambda x, y: F.slice(F.col("_lines"), x["end"] + 2, y["start"] - x["end"] - 1))
    cut = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("text")
    out = out.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
    none = F.array().cast("array<struct<start:int,end:int>>")
    named = [F.coalesce("gone", none).alias(spans)] if spans else []
    return out.select(*(cut if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c != spans), *named)


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
