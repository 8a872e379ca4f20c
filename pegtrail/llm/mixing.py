"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, but at most `limit` times its own size; what is above goes to the
others by weight, until none is above. A source's target is met by whole passes over it (complete epochs); what is left
is drawn without replacement: every document gets the exponential key -ln(u) / quality, u being a hash of its id, and
the documents are taken in key order while their running size stays within what is left (the last one only if that
brings the sum nearer).

The running sums are made in two levels: within key ranges of each source, and over the ranges' totals, so that a
source that holds a third of all rows is no single task.

Defined cases: a null text has size 0 and is never counted; a null source is a source of its own, last in order; a null
id hashes as the empty text; a source of size 0 has target 0; a quality that is null or not positive counts as
`floor`; repeated rows are rows of their own (equal keys go by id, then size); an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegtrail.llm.batches import shared_dir

#: Key ranges of a source, at least, and rows of all sources for each further one: the more, the fewer rows of one source meet in a task.
RANGES, RANGE_ROWS = 2048, 1_000_000
#: Up to so many sources their table is broadcast (some 100 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from 48 bits of the md5 of seed and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in code point order.

    Sources are met in the order of limit * size / weight. One is full if what the sources before it leave gives it
    its limit; the rest share what is left by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    everything = W.partitionBy()
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit))
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    full = left.withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("left_weight")))).over(everything)["col2"]
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, floor: float = 0.1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) from (doc_id, source, size, quality)."""
    shared_dir(docs.sparkSession)
    quality = F.greatest(F.coalesce(F.col("quality"), F.lit(floor)), F.lit(floor))
    key = -F.log(uniform(F.col("doc_id"))) / quality
    keyed = docs.select("doc_id", "source", "size", key.alias("key")).checkpoint()
    ranges = max(RANGES, keyed.count() // RANGE_ROWS)
    keyed = keyed.withColumn("part", F.floor(F.col("key") / (1 + F.col("key")) * ranges))  # spreads keys of all qualities: half a percent of a quality's rows at most in one of 2048
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, limit).checkpoint()
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    spread = (lambda x: F.broadcast(x)) if small else (lambda x: x)

    earlier = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), earlier.alias("offset"))
    in_part = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = keyed.withColumn("upto", F.sum("size").over(in_part))
    placed = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left").withColumn("upto", F.col("upto") + F.col("offset")).drop("s", "p", "offset", "part")
    joined = placed.join(spread(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    over, under = F.col("upto") - rest, rest - (F.col("upto") - F.col("size"))
    drawn = (over <= 0) | ((under > 0) & (over < under))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (epochs + F.when((epochs < limit) & drawn, 1).otherwise(0))).cast("long").alias("taken"))


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with `quality`: the mean label of the id, where it has none the mean of all labels."""
    by_id = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("label"))
    mean = labels.agg(F.coalesce(F.avg("quality"), F.lit(1.0)).alias("mean"))
    return docs.join(by_id, F.col("doc_id") == F.col("labelled"), "left").join(F.broadcast(mean)).withColumn("quality", F.coalesce("label", "mean")).drop("labelled", "label", "mean")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
labelled as (select doc_id, avg(quality) as label from labels where quality is not null group by doc_id),
mean as (select coalesce(avg(quality), 1.0) as mean from labels),
keyed as (
  select s.doc_id, s.source, s.size,
    -ln((cast(('0x' || substr(md5('mix:' || coalesce(cast(s.doc_id as varchar), '')), 1, 12)) as bigint) + 0.5) / 281474976710656.0)
      / greatest(coalesce(l.label, m.mean), 0.1) as k
  from sized s left join labelled l on s.doc_id = l.doc_id cross join mean m),
totals as (select source, sum(size) as source_size from sized group by source),
ranked as (
  select source, source_size, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight,
    source_size * 3.0::double as cap from totals),
filled as (
  select *, sum(source_size) over () - coalesce(sum(cap) over w, 0) as rest, sum(weight) over () - coalesce(sum(weight) over w, 0) as rest_weight
  from ranked window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select rest / rest_weight as v from filled where cap * rest_weight > rest * weight order by cap / weight, source nulls last limit 1),
targets as (
  select source, source_size, case when cap * rest_weight <= rest * weight then cap else (select v from level) * weight end as target from filled),
summed as (select *, sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and current row) as upto from keyed),
parts as (
  select s.doc_id, s.size, t.source_size, t.target, s.upto,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs
  from summed s join targets t on s.source is not distinct from t.source),
drawn as (select *, target - epochs * source_size as rest from parts)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(size * (epochs + case when epochs < 3 and (upto - rest <= 0 or (rest - (upto - size) > 0 and upto - rest < rest - (upto - size))) then 1 else 0 end) as bigint) as taken
from drawn
"""
