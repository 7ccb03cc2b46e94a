"""Registered queries of sources, sinks and index files, with the SQL that says the same.

Each writes the driver's tables to the shared folder in a format of the library
and reads them back; whatever the files lose or change shows in the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import encode
from .functions import vectors as V
from .operators import metrics, search, staged
from .plans import build, experiment
from .shared import materialize, new_path
from .sources import text as io
from .streaming.append import append_stream


def _documents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """(qid, text) of the benchmark, on one line each."""
    bench = s.read.parquet(f"{d}/benchmark.parquet")
    return bench.select(F.col("item_id").cast("string").alias("qid"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).alias("text"))


def _digest(c: str) -> F.Column:
    return F.md5(c).alias(c)


def collection(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "collection")
    passages, _ = io.from_documents(_documents(s, d))
    io.write_tsv(passages, path, "pid", "text")
    return io.read_collection(s, path, dense=True).select("pid", _digest("text"))


def titled_collection(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "collection")
    rows = io.numbered(_documents(s, d).select("doc_id", "source", "text"), "doc_id")
    io.write_tsv(rows.select("pid", io.escape(F.coalesce("text", F.lit(""))).alias("text"), "source"), path, "pid", "text", "source")
    return io.read_collection(s, path).select("pid", _digest("text"))


def questions(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "queries")
    io.write_tsv(_questions(s, d), path, "qid", "text")
    return io.read_queries(s, path)


def questions_json(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "queries") + ".jsonl"
    io.write_questions(_questions(s, d), path)
    return io.read_queries(s, path).select("qid", "text")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Lists of answers with each passage twice, as JSON lines with their questions."""
    path = new_path(s, "answers")
    lists = Q.qrels(s, d).groupBy("qid").agg(F.collect_list("pid").alias("p")).select("qid", F.concat("p", "p").alias("answer_pids"), F.lit("?").alias("text"))
    io.write_questions(lists, path)
    return io.read_answers(s, path)


def _beir(s: SparkSession, d: str) -> str:
    path = new_path(s, "beir")
    docs = _documents(s, d)
    docs.select(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("_id"), F.col("source").alias("title"), "text").write.json(f"{path}/corpus.jsonl")
    _questions(s, d).select(F.col("qid").alias("_id"), "text").write.json(f"{path}/queries.jsonl")
    judged = _questions(s, d).select("qid", F.concat(F.lit("D"), F.lpad(F.length("text").cast("string"), 12, "0")).alias("doc_id"), F.lit(2).alias("grade")).where("length(text) % 2 = 0")
    judged.coalesce(1).write.csv(f"{path}/qrels/test.tsv", sep="\t", header=True)
    return path


def beir_corpus(s: SparkSession, d: str) -> DataFrame:
    return io.read_beir(s, _beir(s, d))[0].select("doc_id", "title", _digest("text"))


def beir_queries(s: SparkSession, d: str) -> DataFrame:
    _, asked, judged = io.read_beir(s, _beir(s, d))
    return asked.join(judged, "qid").select("qid", "doc_id", "grade", _digest("text"))


def extracted(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "extracted")
    io.extract_beir(s, _beir(s, d), path)
    ids = s.read.csv(f"{path}/collection_map.tsv", sep="\t", schema="pid long, doc_id string")
    return io.read_collection(s, f"{path}/collection.tsv").join(ids, "pid").select("pid", "doc_id", _digest("text"))


def judgements(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "qrels")
    q = Q.qrels(s, d).select("qid", F.lit(0).alias("zero"), "pid", "grade")
    io.write_tsv(q.unionAll(q), path, "qid", "zero", "pid", "grade")
    return io.read_qrels(s, path)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    scored = Q.exact(s, d).join(Q.qrels(s, d).select("qid", "pid", F.lit(1).alias("label")), ["qid", "pid"], "left")
    return scored.select("qid", "pid", "rank", F.coalesce("label", F.lit(0)).alias("label"))


def _lists(df: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return df.select("qid", joined("pids"), joined("positives"))


def candidates_labelled(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "candidates")
    io.write_tsv(_candidates(s, d), path, "qid", "pid", "rank", "label")
    return _lists(io.read_candidates(s, path))


def candidates_judged(s: SparkSession, d: str) -> DataFrame:
    """With ranks, 1 among them, but no labels: the judgements say what is positive."""
    path = new_path(s, "candidates")
    io.write_tsv(_candidates(s, d), path, "qid", "pid", "rank")
    judged = Q.qrels(s, d).withColumn("qid", F.col("qid").cast("string"))
    return _lists(io.read_candidates(s, path, judged))


def candidate_texts(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "candidates")
    io.write_tsv(_candidates(s, d).select("qid", "pid", F.concat(F.lit("q"), "qid").alias("query"), F.concat(F.lit("p"), "pid").alias("passage")), path, "qid", "pid", "query", "passage")
    return io.read_candidate_texts(s, path)


def ranking(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "ranking")
    io.write_ranking(Q.exact(s, d), path, {"query": "exact"})
    return io.read_ranking(s, path).select("qid", "pid", F.round("score", 4).alias("score"), F.col("rank").cast("long"))


def ranking_columns(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "ranking")
    io.save_ranking(Q.exact(s, d), path)
    return Q._ranked(io.saved_ranking(s, path))


def ranking_regrouped(s: SparkSession, d: str) -> DataFrame:
    return Q._ranked(search.flat(search.grouped(Q.exact(s, d))))


def backgrounds(s: SparkSession, d: str) -> DataFrame:
    """Each question with the two documents whose ids are the length of its text, and one more."""
    q = _questions(s, d)
    ids = q.select("qid", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.length("text").cast("long").alias("pid")), F.struct(F.lit(1).alias("i"), (F.length("text").cast("long") + 1).alias("pid")))).alias("x")).select("qid", "x.i", "x.pid")
    docs = _documents(s, d).select(F.col("doc_id").alias("pid"), "text")
    return io.with_backgrounds(q, ids, docs).select("qid", _digest("background"))


def index_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Build, write, read, search."""
    index = Q.fixed_index(s, d, 4).write(new_path(s, "index"))
    return Q._ranked(search.search(index, Q.query_tokens(s, d), Q.K, Q.NPROBE, Q.T_PRIME, Q.CELLS))


def index_resumed(s: SparkSession, d: str) -> DataFrame:
    """A build that broke off after its centroids, taken up, and once more reused."""
    path, tokens = new_path(s, "index"), Q.doc_tokens(s, d).drop("label")
    Q.centroids(s, d).write.parquet(f"{path}/centroids")
    build.build_index(tokens, path, "resume", nbits=2)
    index = build.build_index(tokens, path, "reuse", nbits=2)
    return Q._ranked(search.search(index, Q.query_tokens(s, d), Q.K, Q.NPROBE, Q.T_PRIME, Q.CELLS))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """An index of the even passages, to which a stream adds the odd ones; then a search of both."""
    path, tokens = new_path(s, "index"), Q.doc_tokens(s, d).drop("label")
    build.Index.build(tokens.where("pid % 2 = 0"), 4, Q.centroids(s, d)).write(path)
    index, odd = build.Index.read(s, path), tokens.where("pid % 2 = 1")
    odd.repartition(3).write.parquet(f"{path}/arriving")
    arriving = s.readStream.schema(odd.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arriving")
    append_stream(arriving, index, f"{path}/appended", f"{path}/checkpoint").awaitTermination()
    index = index.extended(s.read.parquet(f"{path}/appended"))
    return Q._ranked(search.search(index, Q.query_tokens(s, d), Q.K, Q.NPROBE, Q.T_PRIME, Q.CELLS))


def decompressed(s: SparkSession, d: str) -> DataFrame:
    """Every component of every token, rebuilt from 2 bits."""
    index = Q.fixed_index(s, d, 2)
    rows = build.decompress(index.index, index.centroids, index.codec)
    return rows.select("pid", "pos", F.posexplode("emb").alias("i", "x")).select("pid", "pos", "i", (F.round("x", 4) + 0.0).alias("x"))


def packed(s: SparkSession, d: str) -> DataFrame:
    return Q._codes(s, d, 4).select("pid", "pos", V.pack_hex("codes", 4).alias("hex"))


def cell_tokens(s: SparkSession, d: str) -> DataFrame:
    return build.ivf_tokens(Q._assigned(s, d), build.doc_lengths(Q.doc_tokens(s, d)))


def mean_length(s: SparkSession, d: str) -> DataFrame:
    return build.mean_length(build.doc_lengths(Q.doc_tokens(s, d)))


def padded_search(s: SparkSession, d: str) -> DataFrame:
    """Queries with two tokens of padding: the same ranking as without."""
    q = Q.query_tokens(s, d).select("qid", F.col("t").cast("int").alias("t"), "emb")
    zero = F.array_repeat(F.lit(0.0), 64)
    pads = q.select("qid").distinct().select("qid", F.explode(F.array(F.lit(4), F.lit(5))).alias("t"), zero.alias("emb"))
    return Q._ranked(search.search(Q.fixed_index(s, d, 4), q.unionAll(pads), Q.K, Q.NPROBE, Q.T_PRIME, Q.CELLS))


BOUND, FAR = 6, 10**9


def bounded_search(s: SparkSession, d: str) -> DataFrame:
    """Of each token only the best cells are looked at, and they hold fewer tokens than t_prime: the last of them is what a token missed."""
    return Q._ranked(search.search(Q.fixed_index(s, d, 4), Q.query_tokens(s, d), Q.K, Q.NPROBE, FAR, BOUND))


def exact_metrics(s: SparkSession, d: str) -> DataFrame:
    table = metrics.metric_table(Q.exact(s, d), Q.qrels(s, d), False, (5, 10))
    return table.select("metric", "k", F.round("value", 5).alias("value"))


def restricted_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each query may find only passages of its own parity."""
    pairs = Q.query_tokens(s, d).select("qid").distinct().crossJoin(Q.doc_tokens(s, d).select("pid").distinct()).where("qid % 2 = pid % 2")
    return Q._ranked(Q.topk(s, d, pids=pairs))


def tied_rounds(s: SparkSession, d: str) -> DataFrame:
    """Every passage twice, under its number and one larger by a million: equal scores, of which the larger number wins."""
    scores, inverted = Q._scores(s, d), build.ivf(Q._assigned(s, d))
    inverted = materialize(inverted.unionAll(inverted.withColumn("pid", F.col("pid") + 1_000_000)), "ivf")
    return staged.approximate(staged.candidates(scores, inverted, 2), scores, inverted, 5).select("qid", "pid", F.round("approx", 4).alias("approx"))


def _words(s: SparkSession, d: str, tokens: F.Column) -> DataFrame:
    # The parsers of the other engine and this one agree on lower case and white space of ASCII.
    q = _questions(s, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return q.select("qid", F.transform(tokens, lambda x: F.concat_ws(":", x["pos"].cast("string"), x["word"])).alias("w")).select("qid", F.array_join("w", " ").alias("tokens"))


def trained(s: SparkSession, d: str) -> DataFrame:
    """What runs of an experiment report: each configuration once, though it is asked for twice and in two calls."""
    path = new_path(s, "results")
    configs = experiment.expand({"nbits": [2, 4], "nprobe": [2, 4]})
    tokens = Q.doc_tokens(s, d).drop("label")

    def run(c: dict) -> dict:
        index = build.Index.build(tokens, c["nbits"], Q.centroids(s, d))
        top = search.search(index, Q.query_tokens(s, d), 1, c["nprobe"], Q.T_PRIME, Q.CELLS)
        return {"score": round(top.agg(F.sum("score")).first()[0], 3)}

    experiment.execute(s, configs[:2], run, path)
    done = experiment.execute(s, [*configs, {"nprobe": 2, "nbits": 2}], run, path)
    get = lambda c, k, t: F.get_json_object(c, f"$.{k}").cast(t).alias(k)
    return done.select(get("config", "nbits", "int"), get("config", "nprobe", "int"), get("result", "score", "double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_collection": collection,
    "source_titled_collection": titled_collection,
    "source_queries": questions,
    "source_queries_json": questions_json,
    "source_answers": answers,
    "source_beir_corpus": beir_corpus,
    "source_beir_queries": beir_queries,
    "source_beir_extract": extracted,
    "source_qrels": judgements,
    "source_candidates_labelled": candidates_labelled,
    "source_candidates_judged": candidates_judged,
    "source_candidate_texts": candidate_texts,
    "source_ranking": ranking,
    "source_ranking_columns": ranking_columns,
    "ranking_regrouped": ranking_regrouped,
    "query_backgrounds": backgrounds,
    "index_round_trip": index_round_trip,
    "index_resumed": index_resumed,
    "index_streamed": streamed,
    "decompress_all": decompressed,
    "pack_residuals_4bit": packed,
    "cell_tokens": cell_tokens,
    "mean_length": mean_length,
    "search_padded": padded_search,
    "search_bounded": bounded_search,
    "search_restricted_pairs": restricted_pairs,
    "staged_ties": tied_rounds,
    "metric_table": exact_metrics,
    "tokens_padded": lambda s, d: _words(s, d, encode.padded_tokens("text", 16)),
    "tokens_query": lambda s, d: _words(s, d, encode.query_tokens("text", 16)),
    "tokens_query_full": lambda s, d: _words(s, d, encode.query_tokens("text", None, "qid")),
    "tokens_document": lambda s, d: _words(s, d, encode.document_tokens("text")),
    "experiment_results": trained,
}

_B = r"b AS (SELECT CAST(item_id AS VARCHAR) AS qid, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM benchmark)"
#: What a text is after it was written on one line and read again: trailing spaces go, and what looks like an escape is one.
_LINE = r"replace(replace(replace(rtrim(replace(replace(replace({0}, chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), ' '), '\n', chr(10)), '\r', chr(13)), '\t', chr(9))"
_SIM, _EX, _Q, _D, _REL = Q._SIM, Q._EX, Q._Q, Q._D, Q._REL
_CANDS = Q._with(_Q, _D, _SIM, _EX, Q._RANK, _REL)
_LABELLED = _CANDS + "SELECT CAST(rg.qid AS VARCHAR) AS qid, string_agg(CAST(rg.pid AS VARCHAR), ',' ORDER BY rg.pid) AS pids, coalesce(string_agg(CAST(rel.pid AS VARCHAR), ',' ORDER BY rel.pid), '') AS positives FROM rg LEFT JOIN rel ON rel.qid = rg.qid AND rel.pid = rg.pid GROUP BY rg.qid"
_JUDGED = _CANDS + "SELECT CAST(rg.qid AS VARCHAR) AS qid, string_agg(CAST(rg.pid AS VARCHAR), ',' ORDER BY rg.pid) AS pids, coalesce((SELECT string_agg(CAST(rel.pid AS VARCHAR), ',' ORDER BY rel.pid) FROM rel WHERE rel.qid = rg.qid), '') AS positives FROM rg GROUP BY rg.qid"
_W = r"w AS (SELECT qid, list_filter(string_split(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), ' '), lambda x: x <> '') AS w FROM b)"
_TOK = "SELECT qid, array_to_string(list_transform(range(0, len(w)), lambda i: CAST(i AS VARCHAR) || ':' || w[i + 1]), ' ') AS tokens FROM "


def _bounded_sql() -> str:
    missed = f"m AS (SELECT qid, t, max_by(score, rank) AS m FROM rk WHERE rank <= {BOUND} GROUP BY qid, t)"
    return Q._with(_Q, _D, Q._C, Q._CS, Q._RK, Q._AS, Q._R, Q._codec(4), missed, Q._ts(), Q._PS) + Q._top("ps")


def _experiment_sql() -> str:
    """The best score of each query, over 2 and 4 bits and 2 and 4 cells probed."""
    parts = []
    for nbits in (2, 4):
        for nprobe in (2, 4):
            ts = Q._ts().replace(f"rk.rank <= {Q.NPROBE}", f"rk.rank <= {nprobe}")
            parts.append(f"SELECT CAST({nbits} AS INTEGER) AS nbits, CAST({nprobe} AS INTEGER) AS nprobe, round(sum(score), 3) AS score FROM ({Q._with(_Q, _D, Q._C, Q._CS, Q._RK, Q._AS, Q._N, Q._R, Q._codec(nbits), Q._M, ts, Q._PS)} SELECT qid, max(score) AS score FROM ps GROUP BY qid)")
    return " UNION ALL ".join(parts)


def _pairs_sql() -> str:
    return Q._search_sql(4, "k.pid % 2 = q.qid % 2")


ORACLES: dict[str, str] = {
    "source_collection": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pid, md5({_LINE.format("coalesce(text, '')")}) AS text FROM documents",
    "source_titled_collection": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pid, md5(source || ' | ' || {_LINE.replace('rtrim(', '(').replace(", ' '), '", "), '").format("coalesce(text, '')")}) AS text FROM documents",
    "source_queries": Q._with(_B) + "SELECT qid, text FROM b",
    "source_queries_json": Q._with(_B) + "SELECT qid, text FROM b",
    "source_answers": Q._with(_D, _REL) + "SELECT CAST(qid AS VARCHAR) AS qid, pid, CAST(1 AS INTEGER) AS grade FROM rel",
    "source_beir_corpus": "SELECT 'D' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, source AS title, md5(text) AS text FROM documents",
    "source_beir_queries": Q._with(_B) + "SELECT qid, 'D' || lpad(CAST(length(text) AS VARCHAR), 12, '0') AS doc_id, CAST(2 AS INTEGER) AS grade, md5(text) AS text FROM b WHERE length(text) % 2 = 0",
    "source_beir_extract": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pid, 'D' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, md5({_LINE.format("coalesce(source, '') || ' ' || coalesce(text, '')")}) AS text FROM documents",
    "source_qrels": Q._with(_D, _REL) + "SELECT CAST(qid AS VARCHAR) AS qid, pid, CAST(1 AS INTEGER) AS grade FROM rel",
    "source_candidates_labelled": _LABELLED,
    "source_candidates_judged": _JUDGED,
    "source_candidate_texts": Q._with(_Q, _D, _SIM, _EX, Q._RANK) + "SELECT CAST(qid AS VARCHAR) AS qid, pid, 'q' || CAST(qid AS VARCHAR) AS query, 'p' || CAST(pid AS VARCHAR) AS passage FROM rg",
    "source_ranking": Q._with(_Q, _D, _SIM, _EX) + f"SELECT CAST(qid AS VARCHAR) AS qid, pid, score, rank FROM ({Q._top('x')})",
    "source_ranking_columns": Q._with(_Q, _D, _SIM, _EX) + Q._top("x"),
    "ranking_regrouped": Q._with(_Q, _D, _SIM, _EX) + Q._top("x"),
    "query_backgrounds": Q._with(_B, "p AS (SELECT qid, text, unnest([0, 1]) AS i FROM b)", "n AS (SELECT p.qid, string_agg(d.text, ' [SEP] ' ORDER BY i) AS background FROM p JOIN documents d ON d.doc_id = length(p.text) + i GROUP BY p.qid)") + "SELECT b.qid, md5(background) AS background FROM b LEFT JOIN n ON n.qid = b.qid",
    "index_round_trip": Q._search_sql(4),
    "index_resumed": Q._search_sql(2),
    "index_streamed": Q._search_sql(4).replace("FROM r), k AS", "FROM r WHERE pid % 2 = 0), k AS"),
    "decompress_all": Q._with(_D, Q._C, Q._AS, Q._R, Q._codec(2), Q._DEC) + "SELECT pid, pos, CAST(i - 1 AS INTEGER) AS i, round(e[i], 4) + 0.0 AS x FROM (SELECT pid, pos, e, unnest(range(1, len(e) + 1)) AS i FROM de)",
    "pack_residuals_4bit": Q._with(_D, Q._C, Q._AS, Q._R, Q._codec(4)) + "SELECT pid, pos, string_agg(substr('0123456789ABCDEF', CAST(code AS INTEGER) + 1, 1), '' ORDER BY i) AS hex FROM k GROUP BY pid, pos",
    "cell_tokens": Q._with(_D, Q._C, Q._AS, "l AS (SELECT pid, sum(n) OVER (ORDER BY pid) - n AS o FROM (SELECT pid, count(*) AS n FROM d GROUP BY pid))") + "SELECT cid, CAST(o + pos AS BIGINT) AS eid FROM a JOIN l USING (pid)",
    "mean_length": Q._with(_D) + "SELECT count(*) AS passages, CAST(sum(n) AS BIGINT) AS tokens, avg(n) AS mean FROM (SELECT pid, count(*) AS n FROM d GROUP BY pid)",
    "search_padded": Q._search_sql(4),
    "search_bounded": _bounded_sql(),
    "search_restricted_pairs": _pairs_sql(),
    "staged_ties": Q._with(_Q, _D, Q._C, Q._CS, Q._RK, Q._AS, "iv AS (SELECT DISTINCT cid, pid + 1000000 * z AS pid FROM a, (SELECT unnest([0, 1]) AS z))", Q._CAND, Q._round_sql("s1", "cd", "", 5)) + "SELECT qid, pid, round(approx, 4) AS approx FROM s1",
    "metric_table": f"SELECT 'Success' AS metric, CAST(k AS INTEGER) AS k, success AS value FROM ({Q.ORACLES['success_at_k']}) UNION ALL SELECT 'Recall', CAST(k AS INTEGER), recall FROM ({Q.ORACLES['recall_at_k']})",
    "tokens_padded": Q._with(_B, _W, "x AS (SELECT qid, list_concat(w, list_transform(range(0, 16), lambda i: '[PAD]'))[:16] AS w FROM w)") + _TOK + "x",
    "tokens_query": Q._with(_B, _W, "x AS (SELECT qid, list_concat(list_concat(['[Q]'], w[:15]), list_transform(range(0, 16), lambda i: '[MASK]'))[:16] AS w FROM w)") + _TOK + "x",
    "tokens_query_full": Q._with(_B, _W, "x AS (SELECT qid, list_concat(list_concat(['[Q]'], w[:499]), ['[SEP]', lower(qid)]) AS w FROM w)") + _TOK + "x",
    "tokens_document": Q._with(_B, _W, "x AS (SELECT qid, list_concat(['[D]'], w) AS w FROM w)") + r"SELECT qid, array_to_string(list_filter(list_transform(range(0, len(w)), lambda i: CAST(i AS VARCHAR) || ':' || w[i + 1]), lambda y: regexp_matches(y, '^[0-9]+:.*[^!-/:-@\[-`{-~]')), ' ') AS tokens FROM x",
    "experiment_results": _experiment_sql(),
}
