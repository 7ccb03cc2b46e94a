"""Registered queries of the retrieval engine, with the SQL that says the same.

The driver's ``embeddings`` play encoded tokens: vectors 0 to 31 are eight
queries of four tokens, the others passages of four; vectors 32 to 47 are the
centroids of the fixed index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, number_of_cells, sample_size
from .functions import vectors as V
from .functions.encode import get_encoder
from .operators import metrics, search, staged
from .operators.words import WordIndex
from .plans import build
from .plans.build import Index
from .plans.experiment import grid_frame, missing_configs
from .sources.text import escape, unescape

CELLS, T_PRIME, NPROBE, K = 16, 40, 4, 10


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return _emb(spark, d).where(i < 32).select(F.floor(i / 4).alias("qid"), (i % 4).alias("t"), F.col("embedding").cast("array<double>").alias("emb"))


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id") - 32
    return _emb(spark, d).where(i >= 0).select(F.floor(i / 4).alias("pid"), (i % 4).alias("pos"), F.col("embedding").cast("array<double>").alias("emb"), "label")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id") - 32
    return _emb(spark, d).where(i.between(0, CELLS - 1)).select(i.alias("cid"), F.col("embedding").cast("array<double>").alias("emb"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    q = _emb(spark, d).where((i < 32) & (i % 4 == 0)).select(F.floor(i / 4).alias("qid"), "label")
    return doc_tokens(spark, d).select("pid", "label").distinct().join(q, "label").select("qid", "pid", F.lit(1).alias("grade")).distinct()


def fixed_index(spark: SparkSession, d: str, nbits: int) -> Index:
    return Index.build(doc_tokens(spark, d).drop("label"), nbits, centroids(spark, d))


def _r(c: str, digits: int = 4) -> F.Column:
    return F.round(c, digits).alias(c)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "pid", _r("score"), F.col("rank").cast("long"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return build.assign(doc_tokens(spark, d).drop("label"), centroids(spark, d))


def _res(spark: SparkSession, d: str) -> DataFrame:
    return build.residuals(_assigned(spark, d), centroids(spark, d))


def _codes(spark: SparkSession, d: str, nbits: int) -> DataFrame:
    res = _res(spark, d)
    return build.compress(res, build.train_codec(res, nbits))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return search.centroid_scores(query_tokens(spark, d), centroids(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    q, t = query_tokens(spark, d), doc_tokens(spark, d)
    return q.where("t = 0").select("qid", F.col("emb").alias("a")).join(t.where("pos = 0").select("pid", F.col("emb").alias("b")), F.col("pid") % 8 == F.col("qid"))


def topk(spark: SparkSession, d: str, nbits: int = 4, engine: str = "arrow", **options) -> DataFrame:
    return search.search(fixed_index(spark, d, nbits), query_tokens(spark, d), K, NPROBE, T_PRIME, CELLS, engine, **options)


def _sims(spark: SparkSession, d: str, similarity: str = "dot") -> DataFrame:
    return staged.token_similarities(query_tokens(spark, d), doc_tokens(spark, d), None, similarity)


def exact(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(staged.maxsim(_sims(spark, d)), K)


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scores, inverted = _scores(spark, d), build.ivf(_assigned(spark, d))
    return scores, inverted, staged.candidates(scores, inverted, 2)


def _stage1(spark: SparkSession, d: str) -> DataFrame:
    scores, inverted, pairs = _candidates(spark, d)
    return staged.approximate(pairs, scores, inverted, 64, staged.kept_cells(scores, 0.1))


def _stage2(spark: SparkSession, d: str) -> DataFrame:
    scores, inverted, _ = _candidates(spark, d)
    return staged.approximate(_stage1(spark, d).select("qid", "pid"), scores, inverted, 16)


def _metric(f: Callable, name: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r, q = exact(spark, d), qrels(spark, d)
        parts = [f(r, q, k).select(F.lit(k).alias("k"), F.round(name, 5).alias(name)) for k in (5, 10)]
        return parts[0].unionAll(parts[1])

    return run


def _index_plan(spark: SparkSession, d: str) -> DataFrame:
    n, total = doc_tokens(spark, d).agg(F.count_distinct("pid"), F.count(F.lit(1))).first()
    return spark.createDataFrame([(n, total, sample_size(n), number_of_cells(n, total / n))], "passages long, tokens long, sample long, cells long")


def _hash_search(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), "text")
    enc = get_encoder("hash")
    # Whole texts and whole queries: a document is one passage, however long.
    c = Config()
    index = WordIndex.build(docs, enc, c.nbits, iterations=c.kmeans_iters)
    # All cells within the bound are probed, and a word that misses a document counts as the last of them:
    # the default of t_prime, 1 in a small index, would count it as the best, above what was found.
    return _ranked(index.search(bench.select(F.col("qid").alias("id"), "text"), K, c.bound, index.num_tokens))


def _nearest(spark: SparkSession, d: str, nbits: int = 4) -> DataFrame:
    """The nearest rows of every 50th one, over all rows: a quarter of the cells probed, 10 K candidates scored again exactly."""
    emb = _emb(spark, d).select(F.col("vec_id").alias("pid"), F.lit(0).cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("emb"))
    asked = emb.where("pid % 50 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("t"), "emb")
    index = Index.build(emb, nbits)
    cells = index.cells.count()
    found = search.nearest(index, asked, 10 * K, max(1, cells // 4)).select("qid", "pid")
    return _ranked(search.top_k(staged.maxsim(staged.token_similarities(asked, emb, found)), K))


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every query token with every passage token."""
    q, t = query_tokens(spark, d), doc_tokens(spark, d)
    return t.select("pid", "pos", F.col("emb").alias("b")).crossJoin(F.broadcast(q.select("qid", "t", F.col("emb").alias("a"))))


def _kmeans(spark: SparkSession, d: str) -> DataFrame:
    return build.kmeans(doc_tokens(spark, d).drop("label"), CELLS).select("cid", F.transform("emb", lambda x: F.round(x, 6)).alias("emb"))


def _doc_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = doc_tokens(spark, d).select("pid").distinct().select("pid", F.concat(F.lit("D"), F.col("pid").cast("string")).alias("doc_id"))
    return search.map_ids(exact(spark, d), ids).select("qid", "doc_id", _r("score"), F.col("rank").cast("long"))


def _collection(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(escape("text")).alias("escaped"), (unescape(escape(F.col("text"))) == F.col("text")).alias("same"))


def _titled(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(F.concat(F.col("source"), F.lit(" | "), F.col("text"))).alias("passage"))


def _configs(spark: SparkSession, d: str) -> DataFrame:
    grid = grid_frame(spark, nbits=[2, 4], nprobe=[4, 8, 16]).select(F.col("nbits").cast("int"), F.col("nprobe").cast("int"))
    return missing_configs(grid, grid.where("nbits = 2 AND nprobe < 16"), ["nbits", "nprobe"])


def _restricted(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(topk(spark, d, pids=doc_tokens(spark, d).where("pid % 3 = 0").select("pid").distinct()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topk_4bit": lambda s, d: _ranked(topk(s, d, 4)),
    "topk_2bit": lambda s, d: _ranked(topk(s, d, 2)),
    "topk_4bit_sql": lambda s, d: _ranked(topk(s, d, 4, "sql")),
    "vec_dot": lambda s, d: _pairs(s, d).select("qid", "pid", F.round(V.dot("a", "b"), 4).alias("x")),
    "topk_nearest_4bit": lambda s, d: _nearest(s, d, 4),
    "topk_nearest_2bit": lambda s, d: _nearest(s, d, 2),
    "vec_dot_all": lambda s, d: _all_pairs(s, d).select("qid", "t", "pid", "pos", (F.round(V.dot("a", "b"), 4) + 0.0).alias("x")),
    "vec_l2_dist_all": lambda s, d: _all_pairs(s, d).select("qid", "t", "pid", "pos", F.round(V.l2_distance("a", "b"), 4).alias("x")),
    "vec_l2norm": lambda s, d: doc_tokens(s, d).select("pid", "pos", F.round(V.l2_norm("emb"), 4).alias("x")),
    "vec_l2_dist": lambda s, d: _pairs(s, d).select("qid", "pid", F.round(V.l2_distance("a", "b"), 4).alias("x")),
    "centroid_scores": lambda s, d: _scores(s, d).select("qid", "t", "cid", _r("score")),
    "assign_codes": lambda s, d: _assigned(s, d).select("pid", "pos", "cid"),
    "assign_codes_sql": lambda s, d: build.assign_sql(doc_tokens(s, d).drop("label"), centroids(s, d)).select("pid", "pos", "cid"),
    "cell_sizes": lambda s, d: build.cell_sizes(_assigned(s, d), centroids(s, d)),
    "codec_quantiles": lambda s, d: build.train_codec(_res(s, d), 2).select(F.explode(F.concat("cutoffs", "weights", F.array("avg_residual"))).alias("x")).select(F.round("x", 6).alias("x")),
    "bucketize_residuals": lambda s, d: _codes(s, d, 2).select("pid", "pos", F.array_join(F.col("codes").cast("array<string>"), "").alias("codes")),
    "pack_residuals": lambda s, d: _codes(s, d, 2).select("pid", "pos", V.pack_hex("codes", 2).alias("hex")),
    "decompress_normalized": lambda s, d: (lambda i: build.decompress(i.index, i.centroids, i.codec).select("pid", "pos", F.round(V.l2_norm("emb"), 4).alias("norm"), (F.round(F.get("emb", F.lit(0)), 4) + 0.0).alias("x0"), (F.round(F.get("emb", F.lit(63)), 4) + 0.0).alias("x63")))(fixed_index(s, d, 4)),
    "ivf_pids": lambda s, d: build.ivf(_assigned(s, d)),
    "probe_topn": lambda s, d: search.probe(_scores(s, d), NPROBE).select("qid", "t", "cid", _r("score"), F.col("rank").cast("long")),
    "missing_estimate": lambda s, d: search.missing(_scores(s, d), build.cell_sizes(_assigned(s, d), centroids(s, d)), T_PRIME, CELLS).select("qid", "t", _r("m")),
    "token_max": lambda s, d: (lambda i: search.token_max(search.token_scores(search.probe(_scores(s, d), NPROBE), query_tokens(s, d), i.index, build.codec_values(i.codec)[2])).select("qid", "t", "pid", _r("mx")))(fixed_index(s, d, 4)),
    "maxsim_exact_topk": lambda s, d: _ranked(exact(s, d)),
    "maxsim_relu_topk": lambda s, d: _ranked(search.top_k(staged.maxsim(_sims(s, d), relu=True), K)),
    "maxsim_normalized": lambda s, d: _ranked(search.top_k(staged.maxsim(_sims(s, d), normalize=True), K)),
    "maxsim_flipr": lambda s, d: staged.flipr(_sims(s, d), 2, 1, 1).select("qid", "pid", _r("score")),
    "maxsim_l2": lambda s, d: _ranked(search.top_k(staged.maxsim(_sims(s, d, "l2")), K)),
    "staged_candidates": lambda s, d: _candidates(s, d)[2],
    "staged_round1": lambda s, d: _stage1(s, d).select("qid", "pid", _r("approx")),
    "staged_round2": lambda s, d: _stage2(s, d).select("qid", "pid", _r("approx")),
    "staged_topk": lambda s, d: _ranked(staged.staged_search(fixed_index(s, d, 4), query_tokens(s, d), K, 2, 0.1, 64)),
    "search_restricted": _restricted,
    "search_filter_fn": lambda s, d: _ranked(topk(s, d, filter_fn=F.col("pid") % 2 == 1)),
    "ranking_mapped": _doc_ids,
    "success_at_k": _metric(metrics.success_at_k, "success"),
    "recall_at_k": _metric(metrics.recall_at_k, "recall"),
    "ndcg_at_k": _metric(metrics.ndcg_at_k, "ndcg"),
    "map_at_k": _metric(metrics.map_at_k, "map"),
    "collection_escape": _collection,
    "collection_title_concat": _titled,
    "doc_lengths": lambda s, d: build.doc_lengths(doc_tokens(s, d)),
    "chunk_plan": lambda s, d: build.chunk_plan(build.doc_lengths(doc_tokens(s, d)), 25),
    "index_plan": _index_plan,
    "index_statistics": lambda s, d: build.statistics(build.cell_sizes(_assigned(s, d), centroids(s, d))),
    "missing_configs": _configs,
    "kmeans_fit": _kmeans,
    "hash_encode_search": _hash_search,
}

_Q = "q AS (SELECT vec_id // 4 AS qid, vec_id % 4 AS t, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 32)"
_D = "d AS (SELECT (vec_id - 32) // 4 AS pid, (vec_id - 32) % 4 AS pos, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id >= 32)"
_C = f"c AS (SELECT vec_id - 32 AS cid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id BETWEEN 32 AND {31 + CELLS})"
_DOT = "list_inner_product({0}, {1})"
_CS = "cs AS (SELECT qid, t, cid, list_inner_product(q.e, c.e) AS score FROM q, c)"
_RK = "rk AS (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY round(score, 12) DESC, cid) AS rank FROM cs)"
_AS = "a AS (SELECT pid, pos, e, cid, ce FROM (SELECT d.pid, d.pos, d.e, c.cid, c.e AS ce, row_number() OVER (PARTITION BY d.pid, d.pos ORDER BY round(list_inner_product(d.e, c.e), 12) DESC, c.cid) AS r FROM d, c) WHERE r = 1)"
_N = "n AS (SELECT c.cid, count(a.pid) AS n FROM c LEFT JOIN a ON a.cid = c.cid GROUP BY c.cid)"
_R = "r AS (SELECT pid, pos, cid, i, e[i] - ce[i] AS x FROM (SELECT pid, pos, cid, e, ce, unnest(range(1, len(e) + 1)) AS i FROM a))"


def _codec(nbits: int) -> str:
    n = 2**nbits
    cut, mid = ", ".join(str(i / n) for i in range(1, n)), ", ".join(str((i + 0.5) / n) for i in range(n))
    return f"cw AS (SELECT quantile_cont(x, [{cut}]) AS cut, quantile_cont(x, [{mid}]) AS w, avg(abs(x)) AS av FROM r), k AS (SELECT pid, pos, cid, i, len(list_filter(cut, lambda v: v < x)) AS code, w FROM r, cw)"


_M = f"m AS (SELECT qid, t, coalesce(min_by(score, rank) FILTER (WHERE cum >= {T_PRIME}), max_by(score, rank)) AS m FROM (SELECT rk.*, sum(n) OVER (PARTITION BY qid, t ORDER BY rank) AS cum FROM rk JOIN n USING (cid)) GROUP BY qid, t)"


def _ts(where: str = "true") -> str:
    return f"ts AS (SELECT rk.qid, rk.t, k.pid, rk.cid, any_value(rk.score) + sum(q.e[k.i] * k.w[k.code + 1]) AS s FROM rk JOIN k ON k.cid = rk.cid JOIN q ON q.qid = rk.qid AND q.t = rk.t WHERE rk.rank <= {NPROBE} AND {where} GROUP BY rk.qid, rk.t, k.pid, k.pos, rk.cid), tm AS (SELECT qid, t, pid, max(s) AS mx FROM ts GROUP BY qid, t, pid)"


_PS = "ps AS (SELECT tm.qid, pid, any_value(b) + sum(mx - m.m) AS score FROM tm JOIN m USING (qid, t) JOIN (SELECT qid, sum(m) AS b FROM m GROUP BY qid) USING (qid) GROUP BY tm.qid, pid)"


def _top(source: str, k: int = K, columns: str = "qid, pid") -> str:
    return f"SELECT {columns}, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, pid) AS rank FROM {source}) WHERE rank <= {k}"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _search_sql(nbits: int, where: str = "true") -> str:
    return _with(_Q, _D, _C, _CS, _RK, _AS, _N, _R, _codec(nbits), _M, _ts(where), _PS) + _top("ps")


_SIM = "s AS (SELECT q.qid, q.t, d.pid, max(list_inner_product(q.e, d.e)) AS mx FROM q, d GROUP BY q.qid, q.t, d.pid)"
_EX = "x AS (SELECT qid, pid, sum(mx) AS score FROM s GROUP BY qid, pid)"
_RANK = f"rg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, pid) AS rank FROM x) WHERE rank <= {K})"
_REL = "rel AS (SELECT DISTINCT l.qid, d.pid FROM (SELECT vec_id // 4 AS qid, label FROM embeddings WHERE vec_id < 32 AND vec_id % 4 = 0) l JOIN d ON d.label = l.label)"
_EVAL = _with(_Q, _D, _SIM, _EX, _RANK, _REL, "ks AS (SELECT unnest([5, 10]) AS k)", "nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid)", "h AS (SELECT k, rg.qid, rank, row_number() OVER (PARTITION BY k, rg.qid ORDER BY rank) AS i FROM ks, rg JOIN rel ON rel.qid = rg.qid AND rel.pid = rg.pid WHERE rank <= k)")
_BOTH = "(SELECT DISTINCT k, rg.qid, n FROM ks, rg JOIN nr ON nr.qid = rg.qid) z"
_PAIR = "p AS (SELECT q.qid, d.pid, q.e AS a, d.e AS b FROM q JOIN d ON d.pid % 8 = q.qid WHERE q.t = 0 AND d.pos = 0)"
_IVF = "iv AS (SELECT DISTINCT cid, pid FROM a)"
_CAND = "cd AS (SELECT DISTINCT qid, pid FROM rk JOIN iv USING (cid) WHERE rank <= 2)"


def _round_sql(name: str, pairs: str, only: str, n: int) -> str:
    return f"{name}h AS (SELECT qid, pid, sum(mx) AS hit, count(*) AS nh FROM (SELECT p.qid, p.pid, cs.t, max(cs.score) AS mx FROM {pairs} p JOIN iv ON iv.pid = p.pid JOIN cs ON cs.qid = p.qid AND cs.cid = iv.cid {only} GROUP BY p.qid, p.pid, cs.t) GROUP BY qid, pid), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(approx, 10) DESC, pid DESC) AS rank FROM (SELECT p.qid, p.pid, coalesce(hit, 0) + (4 - coalesce(nh, 0)) * -9999 AS approx FROM {pairs} p LEFT JOIN {name}h h ON h.qid = p.qid AND h.pid = p.pid)) WHERE rank <= {n})"


_KEEP = "kc AS (SELECT qid, cid FROM cs GROUP BY qid, cid HAVING max(score) >= 0.1)"
_S1 = _round_sql("s1", "cd", "JOIN kc ON kc.qid = cs.qid AND kc.cid = cs.cid", 64)
_S2 = _round_sql("s2", "s1", "", 16)
_DEC = "de AS (SELECT pid, pos, list(v / nrm ORDER BY i) AS e FROM (SELECT k.pid, k.pos, k.i, c.e[k.i] + k.w[k.code + 1] AS v, sqrt(sum(power(c.e[k.i] + k.w[k.code + 1], 2)) OVER (PARTITION BY k.pid, k.pos)) AS nrm FROM k JOIN c ON c.cid = k.cid) GROUP BY pid, pos)"

ORACLES: dict[str, str] = {
    "topk_4bit": _search_sql(4),
    "topk_2bit": _search_sql(2),
    "topk_4bit_sql": _search_sql(4),
    "vec_dot": _with(_Q, _D, _PAIR) + "SELECT qid, pid, round(list_inner_product(a, b), 4) AS x FROM p",
    "vec_dot_all": _with(_Q, _D) + "SELECT qid, t, pid, pos, round(list_inner_product(q.e, d.e), 4) + 0.0 AS x FROM q, d",
    "vec_l2_dist_all": _with(_Q, _D) + "SELECT qid, t, pid, pos, round(list_distance(q.e, d.e), 4) AS x FROM q, d",
    "vec_l2norm": _with(_D) + "SELECT pid, pos, round(sqrt(list_inner_product(e, e)), 4) AS x FROM d",
    "vec_l2_dist": _with(_Q, _D, _PAIR) + "SELECT qid, pid, round(list_distance(a, b), 4) AS x FROM p",
    "centroid_scores": _with(_Q, _C, _CS) + "SELECT qid, t, cid, round(score, 4) AS score FROM cs",
    "assign_codes": _with(_D, _C, _AS) + "SELECT pid, pos, cid FROM a",
    "assign_codes_sql": _with(_D, _C, _AS) + "SELECT pid, pos, cid FROM a",
    "cell_sizes": _with(_D, _C, _AS, _N) + "SELECT cid, n FROM n",
    "codec_quantiles": _with(_D, _C, _AS, _R, _codec(2)) + "SELECT round(unnest(list_concat(list_concat(cut, w), [av])), 6) AS x FROM cw",
    "bucketize_residuals": _with(_D, _C, _AS, _R, _codec(2)) + "SELECT pid, pos, string_agg(CAST(code AS VARCHAR), '' ORDER BY i) AS codes FROM k GROUP BY pid, pos",
    "pack_residuals": _with(_D, _C, _AS, _R, _codec(2)) + "SELECT pid, pos, string_agg(substr('0123456789ABCDEF', CAST(v AS INTEGER) + 1, 1), '' ORDER BY j) AS hex FROM (SELECT pid, pos, (i - 1) // 2 AS j, sum(CASE WHEN i % 2 = 1 THEN 4 * code ELSE code END) AS v FROM k GROUP BY pid, pos, (i - 1) // 2) GROUP BY pid, pos",
    "decompress_normalized": _with(_D, _C, _AS, _R, _codec(4), _DEC) + "SELECT pid, pos, round(sqrt(list_inner_product(e, e)), 4) AS norm, round(e[1], 4) + 0.0 AS x0, round(e[64], 4) + 0.0 AS x63 FROM de",
    "ivf_pids": _with(_D, _C, _AS, _IVF) + "SELECT cid, pid FROM iv",
    "probe_topn": _with(_Q, _C, _CS, _RK) + f"SELECT qid, t, cid, round(score, 4) AS score, rank FROM rk WHERE rank <= {NPROBE}",
    "missing_estimate": _with(_Q, _D, _C, _CS, _RK, _AS, _N, _M) + "SELECT qid, t, round(m, 4) AS m FROM m",
    "token_max": _with(_Q, _D, _C, _CS, _RK, _AS, _R, _codec(4), _ts()) + "SELECT qid, t, pid, round(mx, 4) AS mx FROM tm",
    "maxsim_exact_topk": _with(_Q, _D, _SIM, _EX) + _top("x"),
    "maxsim_relu_topk": _with(_Q, _D, _SIM, "x AS (SELECT qid, pid, sum(greatest(0, mx)) AS score FROM s GROUP BY qid, pid)") + _top("x"),
    "maxsim_normalized": _with(_Q, _D, _SIM, "x AS (SELECT qid, pid, sum(mx) / 4 AS score FROM s GROUP BY qid, pid)") + _top("x"),
    "maxsim_flipr": _with(_Q, _D, _SIM) + "SELECT qid, pid, round(max(mx) FILTER (WHERE t < 2) + max(mx) FILTER (WHERE t >= 2), 4) AS score FROM s GROUP BY qid, pid",
    "maxsim_l2": _with(_Q, _D, "s AS (SELECT q.qid, q.t, d.pid, max(-power(list_distance(q.e, d.e), 2)) AS mx FROM q, d GROUP BY q.qid, q.t, d.pid)", _EX) + _top("x"),
    "staged_candidates": _with(_Q, _D, _C, _CS, _RK, _AS, _IVF, _CAND) + "SELECT qid, pid FROM cd",
    "staged_round1": _with(_Q, _D, _C, _CS, _RK, _AS, _IVF, _CAND, _KEEP, _S1) + "SELECT qid, pid, round(approx, 4) AS approx FROM s1",
    "staged_round2": _with(_Q, _D, _C, _CS, _RK, _AS, _IVF, _CAND, _KEEP, _S1, _S2) + "SELECT qid, pid, round(approx, 4) AS approx FROM s2",
    "staged_topk": _with(_Q, _D, _C, _CS, _RK, _AS, _IVF, _CAND, _KEEP, _S1, _S2, _R, _codec(4), _DEC, "s AS (SELECT q.qid, q.t, de.pid, max(list_inner_product(q.e, de.e)) AS mx FROM s2 JOIN q ON q.qid = s2.qid JOIN de ON de.pid = s2.pid GROUP BY q.qid, q.t, de.pid)", "x AS (SELECT qid, pid, sum(greatest(0, mx)) AS score FROM s GROUP BY qid, pid)") + _top("x"),
    "search_restricted": _search_sql(4, "k.pid % 3 = 0"),
    "search_filter_fn": _search_sql(4, "k.pid % 2 = 1"),
    "ranking_mapped": _with(_Q, _D, _SIM, _EX) + _top("x", K, "qid, 'D' || CAST(pid AS VARCHAR) AS doc_id"),
    "success_at_k": _EVAL + "SELECT k, round(avg(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.k = z.k AND h.qid = z.qid) THEN 1.0 ELSE 0.0 END), 5) AS success FROM (SELECT k, qid FROM ks, nr) z GROUP BY k",
    "recall_at_k": _EVAL + f"SELECT z.k, round(avg(coalesce(f, 0) / CAST(n AS DOUBLE)), 5) AS recall FROM {_BOTH} LEFT JOIN (SELECT k, qid, count(*) AS f FROM h GROUP BY k, qid) y ON y.k = z.k AND y.qid = z.qid GROUP BY z.k",
    "ndcg_at_k": _EVAL + f"SELECT z.k, round(avg(coalesce(dcg, 0) / (SELECT sum(1 / log2(j + 1)) FROM (SELECT unnest(range(1, 11)) AS j) WHERE j <= least(z.k, z.n))), 5) AS ndcg FROM {_BOTH} LEFT JOIN (SELECT k, qid, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY k, qid) y ON y.k = z.k AND y.qid = z.qid GROUP BY z.k",
    "map_at_k": _EVAL + f"SELECT z.k, round(avg(coalesce(s, 0) / n), 5) AS map FROM {_BOTH} LEFT JOIN (SELECT k, qid, sum(i / CAST(rank AS DOUBLE)) AS s FROM h GROUP BY k, qid) y ON y.k = z.k AND y.qid = z.qid GROUP BY z.k",
    "collection_escape": "SELECT doc_id, md5(replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped, true AS same FROM documents",
    "collection_title_concat": "SELECT doc_id, md5(source || ' | ' || text) AS passage FROM documents",
    "doc_lengths": _with(_D) + "SELECT pid, count(*) AS length FROM d GROUP BY pid",
    "chunk_plan": _with(_D) + "SELECT chunk, passage_offset, passages, tokens, CAST(sum(tokens) OVER (ORDER BY chunk) - tokens AS BIGINT) AS token_offset FROM (SELECT pid // 25 AS chunk, min(pid) AS passage_offset, count(*) AS passages, CAST(sum(length) AS BIGINT) AS tokens FROM (SELECT pid, count(*) AS length FROM d GROUP BY pid) GROUP BY pid // 25)",
    "index_plan": _with(_D) + "SELECT n AS passages, m AS tokens, least(1 + CAST(floor(16 * sqrt(120 * n)) AS BIGINT), n) AS sample, CAST(power(2, floor(log2(16 * sqrt(m)))) AS BIGINT) AS cells FROM (SELECT count(DISTINCT pid) AS n, count(*) AS m FROM d)",
    "index_statistics": _with(_D, _C, _AS, _N) + "SELECT count(*) AS centroids, CAST(sum(n) AS BIGINT) AS embeddings, quantile_disc(n, 0.5) AS median_size FROM n",
    "missing_configs": "SELECT * FROM (VALUES (2, 16), (4, 4), (4, 8), (4, 16)) v(nbits, nprobe)",
}
