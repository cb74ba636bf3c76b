"""How filters applied one after the other interact: every order of them, from one pass over the texts.

What a filter says of a document doesn't depend on the order, so a document is a mask of the filters it fails.
Documents are counted by part and mask (the cells), and the rest is worked out from the cells alone: each cell
folds over the array of all orders, as one struct for each order and step weighted by the cell's counts, and
the structs of a part's cells are summed elementwise.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import WORD, table

#: The filters, each a bit of the mask; E is told over the whole table.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """The mask of what a text fails by itself: A (under 100 words), B (less than 80 % of its words differ), C
    (more than 10 % capitals) and D (a symbol of markup). Null is an empty text, which fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    count = F.size(words)
    tests = (
        count < 100,
        100 * F.size(F.array_distinct(words)) < 80 * count,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for bit, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part (language, empty for null) and mask.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic, of which several for one id count once. A document
    fails E if a smaller id has the same text (null is empty); repeated ids don't fail it for each other, and
    null ids neither fail it nor make others fail. Texts are compared by their SHA-256. Texts leave their place
    as digests only, and copies of a text are counted before they meet.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), failures(text).alias("mask"))
    no = F.lit(False)
    rows = rows.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    kinds = ("same", "part", "mask", "good", "toxic")
    once = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    alike = once.groupBy(*kinds).agg(F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.sum("n").alias("n"))
    first = F.min("least").over(Window.partitionBy("same"))  # a few rows a text: its parts and labels
    fresh = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    alike = alike.withColumn("first", first).withColumn("fresh", fresh)
    both = F.array(F.struct("mask", F.col("fresh").alias("k")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("fresh")).alias("k")))
    each = alike.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", F.col("x.k").alias("n"), F.when(F.col("good"), F.col("x.k")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("x.k")).otherwise(0).alias("toxic"))
    return each.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def orders() -> Column:
    """All orders of the filters, as an array literal of strings that every task holds."""
    return F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))


def _steps(order: Column) -> Column:
    """What becomes of a cell (mask, n, good, toxic) under one order: a struct for each step."""
    bit = lambda letter: F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.instr(F.lit(FILTERS), letter))
    n, none = F.col("n"), F.lit(0).cast("long")
    shape = "array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def step(state: Column, at: Column) -> Column:
        letter = F.substr(order, at, F.lit(1))
        failed, alive = F.col("mask").bitwiseAND(bit(letter)) != 0, state["alive"]
        gone = alive & failed
        when = lambda test, value: F.when(test, value).otherwise(none)
        counts = (when(alive & ~failed, n), when(gone, n), when(~alive & failed, n), when(F.col("mask") == bit(letter), n), when(gone, F.col("good")), when(gone, F.col("toxic")))
        one = F.struct(order.alias("filter_order"), at.alias("step"), letter.alias("letter"), *(c.alias(name) for c, name in zip(counts, COUNTS, strict=True)))
        return F.struct((alive & ~failed).alias("alive"), F.concat(state["steps"], F.array(one).cast(shape)).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(shape).alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda s: s["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step: part, filter_order, step, COUNTS and shapley, the filter's
    removed summed over all orders. An empty table has no part and gives an empty result."""
    folded = cells(docs, labels).select("part", F.flatten(F.transform(orders(), _steps)).alias("steps"))
    added = lambda a, b: F.struct(a["filter_order"].alias("filter_order"), a["step"].alias("step"), a["letter"].alias("letter"), *((a[c] + b[c]).alias(c) for c in COUNTS))
    per_part = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # a list for each mask: 32 at most
    merged = per_part.select("part", F.aggregate(F.slice("cells", 2, 1 << len(FILTERS)), F.element_at("cells", 1), lambda a, b: F.zip_with(a, b, added)).alias("steps"))
    share = lambda letter: F.aggregate(F.filter("steps", lambda s: s["letter"] == letter), F.lit(0).cast("long"), lambda a, s: a + s["removed"])
    shared = merged.withColumn("shares", F.array(*(share(c) for c in FILTERS)))
    each = shared.select("part", "shares", F.explode("steps").alias("s"))
    return each.select("part", "s.filter_order", "s.step", *(f"s.{c}" for c in COUNTS), F.element_at("shares", F.instr(F.lit(FILTERS), F.col("s.letter"))).alias("shapley"))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Query: the audit of all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))

OP13_SQL = rf"""
with texts as (
  select d.doc_id, coalesce(d.lang, '') as part, coalesce(d.text, '') as text,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as words,
    exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as good,
    exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) as toxic
  from documents d
), fails as (
  select part, good, toxic, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by text), false) as e
  from texts
), cells as (
  select part, a, b, c, d, e, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fails group by all
), steps as (
  select o.filter_order, s.step::int as step, substr(o.filter_order, s.step::int, 1) as letter, substr(o.filter_order, 1, s.step::int - 1) as earlier
  from (values {_ORDERS}) o(filter_order), range(1, 6) s(step)
), judged as (
  select c.*, s.filter_order, s.step, s.letter,
    case s.letter when 'A' then a when 'B' then b when 'C' then c.c when 'D' then d else e end as failed,
    (a and contains(s.earlier, 'A')) or (b and contains(s.earlier, 'B')) or (c.c and contains(s.earlier, 'C')) or (d and contains(s.earlier, 'D')) or (e and contains(s.earlier, 'E')) as gone,
    a::int + b::int + c.c::int + d::int + e::int as failures
  from cells c, steps s
), counted as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (not gone and not failed), 0)::bigint as kept, coalesce(sum(n) filter (failed and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (failed and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failed and failures = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (failed and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (failed and not gone), 0)::bigint as toxic_lost
  from judged group by part, filter_order, step, letter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from counted
"""
