"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; the targets share the total by weight, but no source repeats more than
``max_repeats`` times: what is above is reshared by weight. A document of a source with repetition rate
r is taken floor(r) times, and once more if a hash of seed and doc_id falls below the fraction of r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import WORD, stored, table

SEED = "mix-1"
#: Weights of the sources in code-point order (null last), repeating.
CYCLE = (5, 2, 1)


def word_count(text: Column | str = "text") -> Column:
    """Words in a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    # a word starts where a non-space follows the start or a space
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and doc_id alone: 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds ``weight`` to rows of distinct sources, by rank in code-point order, null last.

    One row per source goes through one window; sources are few against documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int")).cast("double"))


def targets(weighted: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    Resharing ends at the level L where target = min(max_repeats * source_size, L * weight) adds up to
    all words. In order of the ratio at which a source is full, the first k are full, and L is what is
    left by the weight that is left, for the first k whose next source is not full at that level.
    A source of zero words has target 0.
    """
    full = F.lit(float(max_repeats)) * F.col("source_size")
    order = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everywhere = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = (
        weighted.withColumn("cap", full)
        .withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("weights", F.sum("weight").over(everywhere))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    place = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), F.col("source"))
    level = F.coalesce(F.min_by("level", F.when(F.col("fits"), place)).over(everywhere), F.lit(float("inf")))
    return steps.withColumn("final", level).select("source", "source_size", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def repeats(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = 3, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies.

    Null text has size 0; null sources are one source, null ids share one draw; repeated rows each count
    and draw alike. An empty table gives an empty result. Columns other than the three are dropped here.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    sizes = stored(sizes)
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goals = targets(cycle_weights(by_source, cycle), max_repeats).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + (draw("doc_id", seed) < rate - whole).cast("long")).cast("long")
    joined = sizes.join(goals, sizes.source.eqNullSafe(goals.goal_source))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns stay.

    The copies are a function of doc_id and source, so they are joined by source alone. Null texts have no
    words but are taken as others of their source; null sources are one source, null ids share one draw;
    repeated rows are each taken as often; columns of any name stay; an empty table gives an empty result.
    """
    cycle, most, seed = options.get("cycle", CYCLE), options.get("max_repeats", 3), options.get("seed", SEED)
    by_source = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(word_count()).cast("long").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    goals = stored(targets(cycle_weights(by_source, cycle), most).select(F.col("source").alias("goal"), rate.alias("rate")))
    whole = F.floor("rate")
    copies = (whole + (draw("doc_id", seed) < F.col("rate") - whole).cast("long")).cast("int")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"))
    taken = rows.join(goals, F.col("source").eqNullSafe(F.col("goal"))).select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: the mix of all documents at the contract's weights, without the repeated texts."""
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sizes group by source
), weighted as (
  select source, source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from by_source
), steps as (
  select source, source_size, weight, 3.0::double * source_size as cap,
    sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
    coalesce(sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_before
  from weighted
), levels as (
  select *, (total - cap_before) / (weights - weight_before) as level from steps
), final_level as (
  select level as lvl from levels where level * weight <= cap order by cap / weight, source nulls last limit 1
), goals as (
  select source, source_size, least(cap, coalesce((select lvl from final_level), 'inf'::double) * weight) as target from levels
), rates as (
  select s.doc_id, s.size, g.source_size, g.target,
    case when g.source_size > 0 then least(g.target / g.source_size, 3.0::double) else 0.0::double end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as u
  from sizes s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken
from rates
"""
