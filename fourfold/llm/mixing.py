"""Mixing sources to target weights.

Words are counted for each source; targets are set by weight and held to a multiple of what a source has; each
document is then taken floor(rate) times and once more with a probability equal to the fraction of the rate, decided
by a hash of the seed and the document's id. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, n_words, unit_hash

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MOST = 3
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources stand in order of code points, null last, and take the weights in turn. A source's target is
    min(most * its size, level * its weight), with the one level at which the targets sum up to all sizes: handing
    round what is above a source's limit by weight, again and again, ends there. One row for each source is gathered;
    documents are not.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    # Sources reach their limits in order of limit / weight; what the first k leave is shared by the others' weights.
    ratio = F.col("limit") / F.col("weight")
    before = W.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weights_left).withColumn("ratio", ratio)
    per = per.withColumn("turn", F.row_number().over(W.orderBy(ratio, F.col("source").asc_nulls_last())))
    # The level is that of the first source which doesn't reach its limit.
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("turn"))).over(everything)
    per = per.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight")))
    return per.select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row, 0 to `most`).

    A null text has size 0; a null source is a source; a null key counts as a value of its own; repeated rows are
    decided alike; an empty table gives an empty table. Columns of docs that have these names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumn("size", n_words(F.col(text)))
    targets = source_targets(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")), weights, most)
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    # One row for each source: sent to every task if that is few, else joined by the engine's own choice.
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (unit_hash(seed, F.col(key)) < rate - whole).cast("long")
    return joined.withColumn("copies", whole + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs as they are, each as often as it is taken. options: those of with_copies."""
    named = {n: options.pop(n, n if n != "key" else "doc_id") for n in ("text", "source", "key")}
    packed = docs.select(F.struct(*docs.columns).alias("row"), *[F.col(c).alias(n) for n, c in named.items()])
    taken = with_copies(packed, key="key", **options).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = with_copies(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int as weight, source_size * 3 as lim from p),
r as (
  select *, lim / weight as ratio,
    (sum(source_size) over () - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level,
    row_number() over (order by lim / weight, source nulls last) as turn
  from w),
t as (
  select source, source_size,
    coalesce(least(lim::double, arg_min(level, case when level <= ratio then turn end) over () * weight), 0.0) as target
  from r),
c as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from c
"""
