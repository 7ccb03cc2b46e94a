"""Mixing sources to target weights by hash-threshold histograms (native).

Sizes are words.  Every source gets a target; a target is whole passes over
the source plus a part of one more.  The part is the set of documents whose
60-bit hash lies below the source's threshold.  Thresholds come from
histograms of size by (source, hash bucket): a cumulative sum finds the bucket
in which the budget runs out, and only that boundary bucket is split again, on
the next ``BITS`` bits, until a bucket is a single hash value.  That last value
is taken when this brings the source nearer to its target.  Nothing is sorted:
each level is one pass over a narrow (source, hash, size) table that aggregates
only what lies in the boundary buckets, and the texts are read once.

The thresholds are nested: a larger budget takes a superset.  Reruns agree,
for the hash depends on the document id alone.

Targets: the sources, by code point and null last, weigh 1, 2, 3, repeating.
They share ``budget`` (1.0: all words) in proportion, none above ``max_epochs``
times its size; the excess goes to the others by weight.

Cases: a null text has size 0; a very long text is one document, taken or not as
a whole; a null source is a source; rows that repeat a document id, or have none,
share its hash and are taken alike; ties of sources cannot occur;
an empty table, or one without words, has targets of 0 and takes nothing;
extra columns are carried, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

BITS, LEVELS = 15, 4
SEED = "mix"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of a seeded hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame, budget: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Water filling in closed form: in ascending order of cap per weight, the
    saturated sources are those whose cap lies below the level that the rest of
    the budget would reach.  One window over as many rows as there are sources.
    """
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    d = by_source.withColumn("w", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.sum("source_size").over(everything) * budget - before) / after)
    # The level rises past each saturated source and falls past each open one.
    return d.withColumn("open", F.max("level").over(everything)).select("source", "source_size", F.least("cap", F.col("w") * F.coalesce("open", F.lit(float("inf")))).alias("target"))


def _cut(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each source in which the remaining budget ends, and what is left for it.

    hist: source, keys (of earlier levels), b, s, rest.  A source has at most 2**BITS rows.
    """
    w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("s").over(w)
    return hist.withColumn("end", end).where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("s") <= F.col("rest"))).select("source", *keys, "b", "s", (F.col("rest") - (F.col("end") - F.col("s"))).alias("rest"))


def thresholds(sized: DataFrame, budget: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, size, h) to one row per source: source_size, target, passes, below.

    A document is taken ``passes`` times, and once more if its hash is less than ``below``.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-plan")
    part = lambda level: F.shiftright("h", 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)

    cut, keys = plan.select(F.col("source").alias("of"), "rest"), []
    for level in range(LEVELS):
        # Only the rows of the boundary bucket reach the aggregation; cuts have a row per source.
        on = reduce(lambda a, x: a & x, [part(i) == F.col(f"b{i}_") for i in range(level)], F.col("source").eqNullSafe(F.col("of")))
        rows = sized.join(cut, on).select("source", "size", "rest", part(level).alias("b"), *[F.col(f"{k}_").alias(k) for k in keys])
        rows = rows.groupBy("source", *keys, "b").agg(F.sum("size").alias("s"), F.max("rest").alias("rest")).where("s > 0")
        found = materialize(_cut(rows, keys).withColumnsRenamed({"b": f"b{level}"}), f"mix-cut{level}")
        keys = [*keys, f"b{level}"]
        cut = found.select(F.col("source").alias("of"), *[F.col(k).alias(f"{k}_") for k in keys], "s", "rest")
        if level < LEVELS - 1:
            cut = cut.drop("s")
    value = sum((F.shiftleft(F.col(f"b{i}_"), 60 - BITS * (i + 1)) for i in range(1, LEVELS)), F.shiftleft(F.col("b0_"), 60 - BITS))
    nearer = (F.col("s") - F.col("rest") < F.col("rest")).cast("long")
    last = cut.select("of", (value + nearer).alias("below"))
    # No boundary: the rest is 0 and nothing has size, or all is taken by whole passes.
    return materialize(plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).cast("long").alias("below")), "mix-thresholds")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    rows = materialize(sized(docs), "mix-sizes")
    t = thresholds(rows).withColumnRenamed("source", "of")
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("long")
    return rows.join(t, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns they came with."""
    t = thresholds(materialize(sized(docs), "mix-sizes"))
    t = t.select(*[F.col(c).alias(f"_mix_{c}") for c in t.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    copies = F.col("_mix_passes") + (id_hash(F.col("row.doc_id")) < F.col("_mix_below")).cast("long")
    rows = rows.join(t, F.col("row.source").eqNullSafe(F.col("_mix_source")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
             CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, max(level) OVER () AS open FROM l),
t AS (SELECT source, source_size, least(cap, w * coalesce(open, CAST('inf' AS DOUBLE))) AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d GROUP BY source, h),
c AS (SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h) AS e FROM g),
k AS (SELECT c.source, c.h, c.e, c.e - c.g AS b, p.target - p.passes * p.source_size AS rest
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(p.source_size AS BIGINT) AS source_size, p.target,
       CAST(d.size * (p.passes + CASE WHEN p.source_size > 0 AND (k.e <= k.rest OR (k.b <= k.rest AND k.e - k.rest < k.rest - k.b)) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(p.passes + CASE WHEN p.source_size > 0 AND (k.e <= k.rest OR (k.b <= k.rest AND k.e - k.rest < k.rest - k.b)) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
