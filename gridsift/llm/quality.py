"""Quality rules judged at the level of hosts (operator 5).

Each document is measured and tested against rules. The failures of each rule are added up by host and their rates
are shrunk towards the mean of all documents with an empirical beta prior. The verdicts go back to the documents: a
host most of whose documents surely fail a rule loses all of them; at a host that surely fails a rule more often than
the mean, the documents that fail it go; at all others a failing document has the benefit of the doubt. The base rules need no verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.common import Shelf, in_small_batches, table

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: A rule counts at a host if the shrunk rate, less so many posterior deviations, is above the mean; if that is over halfway from the mean to 1, the host loses all its documents.
SURE = 2.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> SQL condition of failure over the measures and n_lines, the number of lines that hold a word.
RULES = {
    "too_short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}
BASE_RULES = ("too_short", "repeats")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)  # the place of the first equal word
    if n <= 1 << 12:
        keys = (ids[:-4] << 48) | (ids[1:-3] << 36) | (ids[2:-2] << 24) | (ids[3:-1] << 12) | ids[4:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        triples = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True)[1]
        keys = triples[:-2] * n + triples[2:]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(keys, again))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a whole text; None has no words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes.split takes exactly the six ASCII white-space characters as space
    dup, n_lines = 0, min(1, len(words))
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        dup, n_lines = len(lines) - len(set(lines)), len(lines)
    return len(words), len(text) - (len(raw) - len(raw.translate(None, SPACES))), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words), n_lines


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column("text")]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * (len(MEASURES) + 1))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], ["doc_id", "host", *MEASURES, "n_lines"])


def host_rates(measured: DataFrame, rules=RULES) -> DataFrame:
    """host, n, for each rule a shrunk rate and whether it counts, and host_kept: one row per host that is not null.

    The prior is Beta(m s, (1 - m) s): m is the mean rate over all documents and s follows from the variance
    of the hosts' rates, less what chance alone gives (at most 1e6, where hosts do not differ).
    """
    fails = {k: F.sum(F.expr(v).cast("long")) for k, v in rules.items()}
    hosts = measured.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(f.alias(f"f_{k}") for k, f in fails.items()))
    means = hosts.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("hosts"), *((F.sum(f"f_{k}") / F.sum("n")).alias(f"m_{k}") for k in rules))
    spread = hosts.crossJoin(F.broadcast(means)).groupBy("all_n", "hosts", *(f"m_{k}" for k in rules)).agg(*((F.sum(F.col("n") * F.pow(F.col(f"f_{k}") / F.col("n") - F.col(f"m_{k}"), F.lit(2))) / F.col("all_n")).alias(f"v_{k}") for k in rules))
    prior = spread.select(*(x for k in rules for m in [F.col(f"m_{k}")] for x in (m.alias(f"m_{k}"), (F.least(F.lit(1e6), m * (1 - m) / F.greatest(F.lit(1e-12), F.col(f"v_{k}") - m * (1 - m) * F.col("hosts") / F.col("all_n")))).alias(f"s_{k}"))))
    rated = hosts.crossJoin(F.broadcast(prior))
    out = []
    for k in rules:
        m, weight = F.col(f"m_{k}"), F.col("n") + F.col(f"s_{k}")
        rate = (F.col(f"f_{k}") + m * F.col(f"s_{k}")) / weight
        surely = rate - SURE * F.sqrt(rate * (1 - rate) / (weight + 1))
        out += [rate.alias(f"rate_{k}"), (surely > m).alias(f"counts_{k}"), (surely > (1 + m) / 2).alias(f"bad_{k}")]
    rated = rated.select("host", "n", *out)
    return rated.withColumn("host_kept", ~F.greatest(*(F.col(f"bad_{k}") for k in rules))).drop(*(f"bad_{k}" for k in rules))


def judge(docs: DataFrame, host: str = "source", rules=RULES, base=BASE_RULES) -> DataFrame:
    """doc_id, host, the measures, n_lines, base_failed, soft_failed (another rule, whatever the host), host_kept and kept, one row per row of docs.

    docs needs doc_id, text and the host column; others are ignored, whatever they are called. Null or empty text: no words, so it fails
    too_short. Null host: no host verdict, so only the base rules count. Repeated rows are measured and counted each. A rate that equals
    a bound is not above it. An empty table gives an empty result.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "quality")
    plain = in_small_batches(docs.select("doc_id", F.col(host).alias("host"), "text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, host {plain.schema['host'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in (*MEASURES, "n_lines"))
    measured = shelf.put("measured", plain.mapInArrow(_measured, schema))
    verdicts = shelf.put("verdicts", host_rates(measured, rules).select("host", "host_kept", *(f"counts_{k}" for k in rules)))
    failed = F.expr(" or ".join(f"({rules[k]})" for k in base))
    out = measured.join(verdicts, "host", "left").withColumn("host_kept", F.coalesce("host_kept", F.lit(True)))
    soft = [F.expr(f"({rules[k]})") & F.coalesce(f"counts_{k}", F.lit(False)) for k in rules if k not in base]
    fine = ~F.greatest(failed, failed, *soft)
    alone = [F.expr(f"({rules[k]})") for k in rules if k not in base]
    return out.withColumn("base_failed", failed).withColumn("soft_failed", F.greatest(F.lit(False), F.lit(False), *alone)).withColumn("kept", fine & F.col("host_kept")).drop(*(f"counts_{k}" for k in rules))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def _oracle() -> str:
    fails = ", ".join(f"sum(cast({v} as bigint)) as f_{k}" for k, v in RULES.items())
    means = ", ".join(f"sum(f_{k}) / cast(sum(n) as double) as m_{k}" for k in RULES)
    spread = ", ".join(f"sum(n * pow(f_{k} / cast(n as double) - m_{k}, 2)) / all_n as v_{k}" for k in RULES)
    strength = ", ".join(f"m_{k}, least(1e6, m_{k} * (1 - m_{k}) / greatest(1e-12, v_{k} - m_{k} * (1 - m_{k}) * hosts / all_n)) as s_{k}" for k in RULES)
    rates = ", ".join(f"m_{k}, n + s_{k} as w_{k}, (f_{k} + m_{k} * s_{k}) / (n + s_{k}) as r_{k}" for k in RULES)
    surely = {k: f"r_{k} - {SURE} * sqrt(r_{k} * (1 - r_{k}) / (w_{k} + 1))" for k in RULES}
    counts = ", ".join(f"{surely[k]} > m_{k} as counts_{k}" for k in RULES)
    bad = " or ".join(f"{surely[k]} > (1 + m_{k}) / 2" for k in RULES)
    soft = " or ".join(f"(({RULES[k]}) and coalesce(counts_{k}, false))" for k in RULES if k not in BASE_RULES)
    ms = ", ".join(f"m_{k}" for k in RULES)
    base = " or ".join(f"({RULES[k]})" for k in BASE_RULES)
    return rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
e as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (select rid, i, len(word) as chars, case when lead(word, 4) over o is not null then word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o end as gram
      from e window o as (partition by rid order by i)),
r as (select *, gram is not null and count(*) over (partition by rid, gram) > 1 as twice from g),
c as (select rid, chars, max(cast(twice as int)) over (partition by rid order by i rows between 4 preceding and current row) as covered from r),
per_word as (select rid, count(*) as n_words, sum(chars) as word_chars, sum(covered) as n_repeat_words from c group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from d),
per_line as (select rid, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (select d.doc_id, d.source as host, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
        cast(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
      from d left join per_word using (rid) left join per_line using (rid)),
hosts as (select host, count(*) as n, {fails} from m where host is not null group by host),
means as (select sum(n) as all_n, count(*) as hosts, {means} from hosts),
spread as (select all_n, hosts, {ms}, {spread} from hosts h cross join means group by all_n, hosts, {ms}),
prior as (select {strength} from spread),
rated as (select host, {rates} from hosts cross join prior),
verdicts as (select host, not ({bad}) as host_kept, {counts} from rated)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed,
  not ({base}) and coalesce(host_kept, true) and not ({soft}) as kept
from m left join verdicts using (host)
"""


ORACLE = _oracle()
