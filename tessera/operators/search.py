"""Search: probe cells, score compressed tokens, impute what a token missed, rank.

One plan answers all queries.  For a query token t, m_t is the score of the
cell at which the cells, best first, hold ``t_prime`` tokens.  A passage's score
is the sum over tokens of its best token score, or m_t where no probed cell
held it; that is sum(m_t) plus the sum of (best - m_t) over the tokens that
hit, so no outer join is needed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.build import SCORE_CELLS, Index, _array, _matrix, codec_values, matrix_blocks

#: Of searches with one token on either side: queries and tokens that meet in a task, and scores that it holds at once.
NEAREST_QUERIES, NEAREST_TOKENS, NEAREST_SCORES = 2048, 131_072, 2 << 20


def real_tokens(query_tokens: DataFrame) -> DataFrame:
    """Without padding."""
    return query_tokens.where(~V.is_padding("emb"))


def centroid_scores(query_tokens: DataFrame, centroids: DataFrame, bound: int | None = None) -> DataFrame:
    """(qid, t, cid, score) of every cell, or of the best ``bound`` cells of each block, by matrix products."""
    out = None
    q = real_tokens(query_tokens).select("qid", "t", "emb")
    for ids, m in matrix_blocks(centroids):
        shared = q.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, m = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    b = whole.slice(at, 64)
                    s = _matrix(b.column("emb")) @ m.T
                    n = min(bound or len(ids), len(ids))
                    top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :n]
                    rows = pa.array(np.repeat(np.arange(len(s)), n))
                    yield pa.RecordBatch.from_arrays([b.column("qid").take(rows), b.column("t").take(rows), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["qid", "t", "cid", "score"])

        kinds = {x.name: x.dataType.simpleString() for x in q.schema}
        part = q.mapInArrow(run, f"qid {kinds['qid']}, t {kinds['t']}, cid long, score double")
        out = part if out is None else out.unionAll(part)
    return out


def centroid_scores_sql(query_tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same for a small centroid table, in built-in expressions."""
    c = centroids.select("cid", F.col("emb").alias("c_emb"))
    return real_tokens(query_tokens).crossJoin(c).select("qid", "t", "cid", V.dot("emb", "c_emb").alias("score"))


def _best_first() -> Window:
    return Window.partitionBy("qid", "t").orderBy(F.round("score", 12).desc(), "cid")


def probe(scores: DataFrame, nprobe: int) -> DataFrame:
    """The best cells of each token: (qid, t, cid, score, rank)."""
    return scores.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= nprobe)


def missing(scores: DataFrame, cells: DataFrame, t_prime: int, bound: int) -> DataFrame:
    """(qid, t, m): the score of the cell that brings the running size to ``t_prime``, or of the last within bound."""
    ranked = scores.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= bound).join(cells, "cid")
    w = Window.partitionBy("qid", "t").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("cum", F.sum("n").over(w))
    reached = F.min_by(F.when(F.col("cum") >= t_prime, F.col("score")), F.when(F.col("cum") >= t_prime, F.col("rank")))
    return run.groupBy("qid", "t").agg(F.coalesce(reached, F.max_by("score", "rank")).alias("m"))


def token_scores_sql(probes: DataFrame, query_tokens: DataFrame, index: DataFrame, weights: list[float]) -> DataFrame:
    """(qid, t, cid, pid, s): centroid score plus the residual's share, the vector never rebuilt."""
    p = probes.select("qid", "t", "cid", "score").join(query_tokens.select("qid", "t", "emb"), ["qid", "t"])
    return p.join(index.select("cid", "pid", "codes"), "cid").select("qid", "t", "cid", "pid", (F.col("score") + V.total(F.zip_with(V._d("emb"), F.col("codes"), lambda x, i: x * F.get(_array(weights), i)))).alias("s"))


def token_scores(probes: DataFrame, query_tokens: DataFrame, index: DataFrame, weights: list[float]) -> DataFrame:
    """The same with the arithmetic on Arrow batches."""
    w = np.array(weights, np.float64)
    p = probes.select("qid", "t", "cid", "score").join(query_tokens.select("qid", "t", "emb"), ["qid", "t"])
    rows = p.join(index.select("cid", "pid", "codes"), "cid").select("qid", "t", "cid", "pid", "score", "emb", "codes")
    kinds = {x.name: x.dataType.simpleString() for x in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column("score").to_numpy() + (_matrix(b.column("emb")) * w[_matrix(b.column("codes")).astype(np.int64)]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("t"), b.column("cid"), b.column("pid"), pa.array(s)], ["qid", "t", "cid", "pid", "s"])

    return rows.mapInArrow(run, f"qid {kinds['qid']}, t {kinds['t']}, cid long, pid {kinds['pid']}, s double")


def repeated_token_max(probes: DataFrame, query_tokens: DataFrame, index: DataFrame, weights: list[float]) -> DataFrame:
    """token_max of token_scores where tokens repeat, as words do: each distinct
    query vector meets each distinct code of a cell once, whatever holds them."""
    key = F.xxhash64("emb")
    asked = query_tokens.select("qid", "t", key.alias("v"))
    vectors = query_tokens.select(F.lit(0).alias("qid"), key.alias("t"), "emb").dropDuplicates(["t"])
    cells = probes.join(asked, ["qid", "t"]).select(F.lit(0).alias("qid"), F.col("v").alias("t"), "cid", "score").dropDuplicates(["t", "cid"])
    held = index.select("cid", "pid", F.xxhash64("codes").alias("code"), "codes")
    codes = held.select("cid", F.col("code").alias("pid"), "codes").dropDuplicates(["cid", "pid"])
    scored = token_scores(cells, vectors, codes, weights).select(F.col("t").alias("v"), "cid", F.col("pid").alias("code"), "s")
    best = scored.join(held.select("cid", "code", "pid").distinct(), ["cid", "code"]).groupBy("v", "pid").agg(F.max("s").alias("mx"))
    return asked.join(best, "v").select("qid", "t", "pid", "mx")


def token_max(scores: DataFrame) -> DataFrame:
    """(qid, t, pid, mx): the best score of a passage for a token."""
    return scores.groupBy("qid", "t", "pid").agg(F.max("s").alias("mx"))


def passage_scores(maxima: DataFrame, missed: DataFrame) -> DataFrame:
    base = missed.groupBy("qid").agg(F.sum("m").alias("base"))
    gain = maxima.join(missed, ["qid", "t"]).groupBy("qid", "pid").agg(F.sum(F.col("mx") - F.col("m")).alias("gain"))
    return gain.join(base, "qid").select("qid", "pid", (F.col("base") + F.col("gain")).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 10) -> DataFrame:
    """(qid, pid, score, rank): score descending, pid ascending."""
    w = Window.partitionBy("qid").orderBy(F.round("score", digits).desc(), "pid")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


Filter = Column | Callable[[DataFrame], DataFrame] | None


def restrict(scores: DataFrame, pids: DataFrame | None = None, filter_fn: Filter = None) -> DataFrame:
    """Only the given passages: (qid, pid) or (pid) rows, and a predicate or a function of a frame with pid."""
    if pids is not None:
        scores = scores.join(pids, [c for c in ("qid", "pid") if c in pids.columns], "left_semi")
    if filter_fn is None:
        return scores
    return scores.where(filter_fn) if isinstance(filter_fn, Column) else filter_fn(scores)


def search(index: Index, query_tokens: DataFrame, k: int = 10, nprobe: int = 16, t_prime: int | None = None, bound: int = 128, engine: str = "arrow", pids: DataFrame | None = None, filter_fn: Filter = None) -> DataFrame:
    """The ranking (qid, pid, score, rank) of all queries."""
    if nprobe > bound:
        raise ValueError("nprobe must not exceed bound")
    _, _, weights = codec_values(index.codec)
    q = real_tokens(query_tokens)
    scores = centroid_scores_sql(q, index.centroids) if engine == "sql" else centroid_scores(q, index.centroids, bound)
    missed = missing(scores, index.cells, index.t_prime(k, t_prime), bound)
    rows = restrict(index.index, pids if pids is not None and "qid" not in pids.columns else None, filter_fn)
    if engine == "repeats":
        maxima = repeated_token_max(probe(scores, nprobe), q, rows, weights)
    else:
        rate = token_scores_sql if engine == "sql" else token_scores
        maxima = token_max(rate(probe(scores, nprobe), q, rows, weights))
    if pids is not None and "qid" in pids.columns:
        maxima = restrict(maxima, pids)
    return top_k(passage_scores(maxima, missed), k)


def nearest(index: Index, asked: DataFrame, k: int = 10, nprobe: int = 16) -> DataFrame:
    """search where queries and passages have one token each, so that nothing is added up: a passage scores as its token.

    Blocks of queries meet blocks of tokens, and only the best k passages of a block leave it by query; what is
    multiplied grows with both, but what is held in a task doesn't, and what is shuffled is little more than the rows.
    """
    found = list(itertools.islice(matrix_blocks(index.centroids), 2))
    if len(found) != 1:
        return search(index, asked, k, nprobe, None, max(nprobe, index.cells.count()))
    asked = real_tokens(asked).select("qid", "emb")
    shared = asked.sparkSession.sparkContext.broadcast((*found[0], np.array(codec_values(index.codec)[2], np.float64)))
    kinds = {"qid": asked.schema["qid"].dataType.simpleString(), "pid": index.index.schema["pid"].dataType.simpleString()}

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, _ = shared.value
        rows = max(1, SCORE_CELLS // len(ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                best = np.argsort(-np.round(_matrix(b.column("emb")) @ m.T, 12), axis=1, kind="stable")[:, :nprobe]
                bits = np.zeros((b.num_rows, len(ids)), bool)
                np.put_along_axis(bits, best, True, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("emb"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["qid", "emb", "cells"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, m, weights = shared.value
        out = pa.table({"qid": left.column("qid").slice(0, 0), "pid": right.column("pid").slice(0, 0), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return out
        q = _matrix(left.column("emb").combine_chunks())
        bits = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(len(q), -1)
        cell = np.searchsorted(ids, right.column("cid").to_numpy())
        x = weights[right.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cell), -1)]
        for lo in range(0, len(x), 8192):
            x[lo : lo + 8192] += m[cell[lo : lo + 8192]]
        rank = np.empty(len(x), np.int64)
        rank[np.argsort(right.column("pid").to_numpy(), kind="stable")] = np.arange(len(x))
        own, passages, scores = [], [], []
        step = max(1, NEAREST_SCORES // len(x))
        for lo in range(0, len(q), step):
            here = np.unpackbits(bits[lo : lo + step], axis=1, count=len(ids)).astype(bool)[:, cell]
            s = np.where(here, q[lo : lo + step] @ x.T, -np.inf)
            last = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(s), -np.inf)
            row, at = np.nonzero(here & (s >= last[:, None] - 1e-9))
            order = np.lexsort((rank[at], -np.round(s[row, at], 10), row))
            row, at = row[order], at[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            own.append(row[keep] + lo)
            passages.append(at[keep])
            scores.append(s[row[keep], at[keep]])
        return pa.table({"qid": left.column("qid").take(pa.array(np.concatenate(own))), "pid": right.column("pid").take(pa.array(np.concatenate(passages))), "score": pa.array(np.concatenate(scores))})

    parts = lambda n, block: max(1, -(-n // block))
    groups, blocks = parts(asked.count(), NEAREST_QUERIES), parts(index.meta["num_embeddings"], NEAREST_TOKENS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.mapInArrow(probed, f"qid {kinds['qid']}, emb array<double>, cells binary").select(named("qid", groups).alias("a"), every(blocks).alias("b"), "qid", "emb", "cells")
    right = index.index.select(every(groups).alias("c"), named("pid", blocks).alias("d"), "pid", "cid", "codes")
    best = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(run, f"qid {kinds['qid']}, pid {kinds['pid']}, score double")
    return top_k(best, k)


def search_text(index: Index, queries: DataFrame, encoder, k: int = 10, max_tokens: int | None = 32, **options) -> DataFrame:  # noqa: ANN001
    """Queries as (qid, text), encoded by an encoder of the registry."""
    q = encoder(queries.select(F.col("qid").alias("id"), "text"), max_tokens).select(F.col("id").alias("qid"), F.col("pos").alias("t"), "emb")
    return search(index, q, k, **options)


def map_ids(ranking: DataFrame, collection_map: DataFrame) -> DataFrame:
    """pid replaced by doc_id."""
    return ranking.join(collection_map, "pid").drop("pid")


def grouped(ranking: DataFrame) -> DataFrame:
    """One row per query, its results in rank order."""
    return ranking.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pid", "score"))), lambda x: F.struct(x["pid"].alias("pid"), x["score"].alias("score"))).alias("results"))


def flat(grouped: DataFrame) -> DataFrame:
    """The rows of a grouped ranking, with their ranks."""
    return grouped.select("qid", F.posexplode("results").alias("rank", "x")).select("qid", "x.pid", "x.score", (F.col("rank") + 1).alias("rank"))
