"""Exact MaxSim, and the staged search that prunes candidates before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import staged_defaults
from ..functions import vectors as V
from ..plans.build import Index, decompress, ivf
from .search import Filter, centroid_scores, probe, real_tokens, restrict, top_k


def token_similarities(query_tokens: DataFrame, doc_tokens: DataFrame, pairs: DataFrame | None = None, similarity: str = "dot") -> DataFrame:
    """(qid, t, pid, mx): per query token the best similarity in a passage, for all passages or the given (qid, pid)."""
    q = real_tokens(query_tokens).select("qid", "t", F.col("emb").alias("q_emb"))
    d = doc_tokens.select("pid", "emb")
    rows = q.join(pairs, "qid").join(d, "pid") if pairs is not None else q.crossJoin(d)
    s = V.dot("q_emb", "emb") if similarity == "dot" else -V.total(F.transform(V.sub("q_emb", "emb"), lambda x: x * x))
    return rows.groupBy("qid", "t", "pid").agg(F.max(s).alias("mx"))


def maxsim(similarities: DataFrame, relu: bool = False, normalize: bool = False) -> DataFrame:
    """(qid, pid, score): the sum of token maxima, clamped at 0 with relu, by token count with normalize."""
    mx = F.greatest(F.col("mx"), F.lit(0.0)) if relu else F.col("mx")
    score = F.sum(mx) / F.count(F.lit(1)) if normalize else F.sum(mx)
    return similarities.groupBy("qid", "pid").agg(score.alias("score"))


def flipr(similarities: DataFrame, first: int = 64, top: int = 32, rest: int = 8) -> DataFrame:
    """The best ``top`` maxima of the first tokens plus the best ``rest`` of the others."""
    best = lambda c, n: V.total(F.slice(F.sort_array(F.collect_list(c), asc=False), 1, n))
    return similarities.groupBy("qid", "pid").agg((best(F.when(F.col("t") < first, F.col("mx")), top) + best(F.when(F.col("t") >= first, F.col("mx")), rest)).alias("score"))


def candidates(scores: DataFrame, inverted: DataFrame, ncells: int) -> DataFrame:
    """(qid, pid) in any of a token's best cells."""
    cells = probe(scores, ncells).select("qid", "cid").distinct()
    return cells.join(inverted, "cid").select("qid", "pid").distinct()


def kept_cells(scores: DataFrame, threshold: float) -> DataFrame:
    """(qid, cid) of cells that some token scores at least ``threshold``."""
    return scores.groupBy("qid", "cid").agg(F.max("score").alias("best")).where(F.col("best") >= threshold).select("qid", "cid")


def approximate(pairs: DataFrame, scores: DataFrame, inverted: DataFrame, n: int, only: DataFrame | None = None, floor: float = -9999.0) -> DataFrame:
    """The best n passages by centroid scores alone: (qid, pid, approx); the larger pid wins ties.

    A token none of whose passage's cells is kept counts ``floor``.
    """
    cells = pairs.join(inverted, "pid")
    cells = cells.join(only, ["qid", "cid"], "left_semi") if only is not None else cells
    tokens = scores.select("qid", "t").distinct()
    mx = cells.join(scores, ["qid", "cid"]).groupBy("qid", "pid", "t").agg(F.max("score").alias("mx")).groupBy("qid", "pid").agg(F.sum("mx").alias("hit"), F.count(F.lit(1)).alias("n_hit"))
    n_tokens = tokens.groupBy("qid").agg(F.count(F.lit(1)).alias("n_tokens"))
    total = F.coalesce("hit", F.lit(0.0)) + (F.col("n_tokens") - F.coalesce("n_hit", F.lit(0))) * floor
    rated = pairs.join(mx, ["qid", "pid"], "left").join(n_tokens, "qid").select("qid", "pid", total.alias("approx"))
    w = Window.partitionBy("qid").orderBy(F.round("approx", 10).desc(), F.col("pid").desc())
    return rated.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def staged_search(index: Index, query_tokens: DataFrame, k: int = 10, ncells: int | None = None, threshold: float | None = None, ndocs: int | None = None, relu: bool = True, normalize: bool = False, pids: DataFrame | None = None, filter_fn: Filter = None) -> DataFrame:
    """Candidates by cell, two rounds of pruning by centroid scores, then exact scores of decompressed tokens."""
    d = staged_defaults(k)
    ncells, threshold, ndocs = ncells or d["ncells"], d["threshold"] if threshold is None else threshold, ndocs or d["ndocs"]
    scores = centroid_scores(query_tokens, index.centroids)
    inverted = ivf(index.index)
    pairs = restrict(candidates(scores, inverted, ncells), pids, filter_fn)
    one = approximate(pairs, scores, inverted, ndocs, kept_cells(scores, threshold)).select("qid", "pid")
    two = approximate(one, scores, inverted, ndocs // 4).select("qid", "pid")
    tokens = decompress(index.index.join(two.select("pid").distinct(), "pid", "left_semi"), index.centroids, index.codec)
    return top_k(maxsim(token_similarities(query_tokens, tokens, two), relu, normalize), k)
