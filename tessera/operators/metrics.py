"""Ranking quality.  ranking: qid, pid, rank; qrels: qid, pid, grade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def success_at_k(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of all judged queries with a relevant passage among the first k."""
    hit = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "pid"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1.0))
    return qrels.select("qid").distinct().join(hit, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("success"))


def recall_at_k(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Mean share of relevant passages found, over ranked queries with any."""
    relevant = qrels.where("grade > 0").groupBy("qid").agg(F.count_distinct("pid").alias("n"))
    found = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "pid"], "left_semi").groupBy("qid").agg(F.count_distinct("pid").alias("f"))
    both = ranking.select("qid").distinct().join(relevant, "qid").join(found, "qid", "left")
    return both.agg(F.avg(F.coalesce("f", F.lit(0)) / F.col("n")).alias("recall"))


def ndcg_at_k(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Mean of DCG over ideal DCG with linear gains."""
    gain = F.sum(F.col("grade") / F.log2(F.col("rank") + 1))
    dcg = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "pid"]).groupBy("qid").agg(gain.alias("dcg"))
    best = qrels.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "pid"))).where(F.col("rank") <= k).groupBy("qid").agg(gain.alias("ideal"))
    both = ranking.select("qid").distinct().join(qrels.select("qid").distinct(), "qid").join(best, "qid", "left").join(dcg, "qid", "left")
    return both.agg(F.round(F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))), 5).alias("ndcg"))


def map_at_k(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Mean average precision, cut at k, over all relevant passages."""
    hits = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "pid"], "left_semi")
    hits = hits.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).groupBy("qid").agg(F.sum(F.col("i") / F.col("rank")).alias("s"))
    relevant = qrels.where("grade > 0").groupBy("qid").agg(F.count_distinct("pid").alias("n"))
    both = ranking.select("qid").distinct().join(qrels.select("qid").distinct(), "qid").join(relevant, "qid", "left").join(hits, "qid", "left")
    return both.agg(F.round(F.avg(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0))), 5).alias("map"))


def metric_table(ranking: DataFrame, qrels: DataFrame, graded: bool, ks: tuple[int, ...] | None = None) -> DataFrame:
    """(metric, k, value) of all metrics of a kind of judgement, in one plan."""
    ks = ks or ((5, 10, 50, 100) if graded else (5, 10, 100, 1000))
    parts = {"nDCG": ndcg_at_k, "MAP": map_at_k, "Recall": recall_at_k} if graded else {"Success": success_at_k, "Recall": recall_at_k}
    rows = [f(ranking, qrels, k).toDF("value").select(F.lit(name).alias("metric"), F.lit(k).alias("k"), "value") for name, f in parts.items() for k in ks]
    return reduce(DataFrame.unionAll, rows)


def evaluate(ranking: DataFrame, qrels: DataFrame, graded: bool, ks: tuple[int, ...] | None = None) -> dict[str, float]:
    """The same by name and cut-off."""
    return {f"{r['metric']}@{r['k']}": r["value"] for r in metric_table(ranking, qrels, graded, ks).collect()}
