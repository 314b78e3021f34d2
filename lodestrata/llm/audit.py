"""Filter interaction audit: what each of five filters removes, alone and in every order.

A relational word pipeline: texts are exploded into words, (document, word) counts are
aggregated and then (document) for totals and distinct words.  Both aggregates follow the
one shuffle by document, as its rows already lie together.  The other flags (characters,
copies, labels) are joined to these figures, and one aggregate counts the documents of each
part for each of the 32 sets of failed filters.  Every order of the filters follows from
these 32 counts, so orders cost nothing.

Edge cases: a null text is empty; an empty text has no words, so it fails A and passes B; a null
language is the part ''; rows without an id are neither copies nor have any, and no label; a
repeated row counts as often as it is there, and is no copy of itself; a label that repeats counts
when any of its rows says 1; very long texts are worked on whole; an empty table has no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import stored

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What words and symbols are, and the bounds of the filters: fixed by the audit's definition.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): the id and a hash of the text together tell documents apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def word_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, words, distinct) for each different document.

    Every text gets a null as its last word: it stands for the document itself, so that
    documents without words stay and the sums of repeated rows can be divided.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    spread = keyed(docs, id_col, text_col).repartition("id", "h")
    each = spread.select("id", "h", F.explode(F.array_append(words, F.lit(None).cast("string"))).alias("word"))
    counted = each.groupBy("id", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    total = F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    return counted.groupBy("id", "h").agg(F.coalesce(total / rows, F.lit(0)).cast("long").alias("words"), F.count("word").alias("distinct"))


def other_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, h, part, digest, shouts, symbols) for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        (100 * capitals > MOST_CAPITALS * F.length(text)).alias("shouts"),
        text.rlike(SYMBOLS).alias("symbols"),
    )


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, words, distinct, fails, good, toxic) for each row; bit k of ``fails`` is set when filter k fails."""
    flags = other_flags(docs, id_col, text_col, part_col)
    # stored, so that the joins are with plain scans and adaptive execution can split a text or
    # a missing id that very many rows share
    firsts = stored(flags.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marks = stored(marks)
    totals = word_totals(docs, id_col, text_col).withColumnsRenamed({"id": "word_id", "h": "word_h"})
    joined = (
        flags.join(totals, flags.id.eqNullSafe(totals.word_id) & (flags.h == totals.word_h), "left")
        .join(firsts, "digest", "left")
        .join(marks, F.col("id") == F.col("label_id"), "left")
    )
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        F.col("shouts"),
        F.col("symbols"),
        F.coalesce(F.col("id") > F.col("first"), F.lit(False)),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return joined.select("id", "part", "words", "distinct", mask.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def set_counts(failed: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): arrays with a count for each of the 32 sets of failed filters."""
    each = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.count_if((F.col("fails") == m) & keep).alias(f"{name}_{m}") for name, keep in each.items() for m in range(SETS)]
    return failed.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{name}_{m}" for m in range(SETS))).alias(name) for name in each))


def audit(counts: DataFrame) -> DataFrame:
    """The report: a row for each part, each of the 120 orders and each of its five steps."""
    steps = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(text):
        return sum((F.when(F.contains(text, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))

    own, before = bits(F.expr("substring(filter_order, step, 1)")), bits(F.expr("substring(filter_order, 1, step - 1)"))
    steps = steps.withColumns({"own": own, "before": before})

    def total(counted: str, when: str, times: str = "1"):
        return F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (sum, m) -> sum + if({when}, {counted}[m] * {times}, 0L))")

    here = "m & own > 0 and m & before = 0"
    # of the orders, a share of one over the number of its failed filters has the filter first
    return steps.select(
        "part", "filter_order", "step",
        total("docs", "m & (own | before) = 0").alias("kept"),
        total("docs", here).alias("removed"),
        total("docs", "m & own > 0 and m & before > 0").alias("redundant"),
        total("docs", "m = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("docs", "m & own > 0", f"({len(ORDERS)} div greatest(bit_count(m), 1))").alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The whole report over ``docs``."""
    return audit(set_counts(failures(docs, labels, **columns)))


#: The same report in DuckDB's SQL.
SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
f as (
  select part,
    case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as m,
    exists (select 1 from labels l where l.doc_id = w.doc_id and quality = 1) as good,
    exists (select 1 from labels l where l.doc_id = w.doc_id and toxic = 1) as toxic
  from w
),
c as (select part, m, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as t from f group by part, m),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x
),
s as (
  select filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
    coalesce(list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) for i in range(1, step)]), 0)::int as before
  from o, (select unnest(range(1, 6)) as step)
)
select part, filter_order, cast(step as int) as step,
  cast(coalesce(sum(n) filter (where m & (own | before) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (where m & own > 0 and m & before = 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (where m & own > 0 and m & before > 0), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (where m = own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(g) filter (where m & own > 0 and m & before = 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(t) filter (where m & own > 0 and m & before = 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * 120 // greatest(bit_count(m), 1)) filter (where m & own > 0), 0) as bigint) as shapley
from c, s group by part, filter_order, step
"""
