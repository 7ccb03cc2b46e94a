"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()[:]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs to (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes, about the
    logarithm of the longest path.  A node's neighbours are never gathered: both
    steps are a pre-aggregated minimum and a join.  Loops and repeated edges are
    allowed; a node whose only edges are loops is left out.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        joined = large.join(low, F.col("u") == F.col("x"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return materialize(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
