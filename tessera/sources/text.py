"""Readers and writers of collections, queries, relevance judgements and rankings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialize


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.rtrim(F.col("value"), F.lit("\n\r ")), "\t", -1).alias("f"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def checked(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, failing at run time on a row for which ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def unique(df: DataFrame, key: str, message: str) -> DataFrame:
    return checked(df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))), F.col("_n") > 1, message).drop("_n")


def as_frame(spark: SparkSession, source, reader) -> DataFrame:  # noqa: ANN001
    """A path, rows or a DataFrame as a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return reader(spark, source)
    items = source.items() if isinstance(source, dict) else enumerate(source)
    return spark.createDataFrame([(int(i), str(t)) if not isinstance(source, dict) else (str(i), str(t)) for i, t in items], "pid long, text string" if not isinstance(source, dict) else "qid string, text string")


def read_collection(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """(pid, text) from id, passage and perhaps title; a header row is left out; ``dense`` refuses ids with gaps or repeats."""
    f = _fields(spark, path).where(F.get("f", F.lit(0)) != "id")
    title = F.get("f", F.lit(2))
    body = unescape(F.get("f", F.lit(1)))
    out = f.select(F.get("f", F.lit(0)).cast("long").alias("pid"), F.when(title.isNotNull(), F.concat(unescape(title), F.lit(" | "), body)).otherwise(body).alias("text"))
    if dense and not check_dense(out):
        raise ValueError("passage ids do not run from 0 without gaps")
    return out


def check_dense(collection: DataFrame) -> bool:
    """Whether pids run from 0 without gaps."""
    n, lo, hi, d = collection.agg(F.count(F.lit(1)), F.min("pid"), F.max("pid"), F.count_distinct("pid")).first()
    return n == 0 or (lo == 0 and hi == n - 1 and d == n)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        q = spark.read.json(path)
        return unique(q.withColumn("qid", F.col("qid").cast("string")).withColumnRenamed("question", "text"), "qid", "a query id repeats")
    q = _fields(spark, path).select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(1)).alias("text"))
    return unique(q, "qid", "a query id repeats")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, grade 1) from JSON lines with answer_pids."""
    return spark.read.json(path).select(F.col("qid").cast("string").alias("qid"), F.explode(F.array_distinct("answer_pids")).alias("pid"), F.lit(1).alias("grade"))


def read_graded(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, grade) from a header row and query, document and grade."""
    q = spark.read.csv(path, sep="\t", header=True, schema="qid string, doc_id string, grade int")
    return q.select("qid", "doc_id", "grade")


def read_beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, title, text), queries (qid, text) that are judged, and judgements (qid, doc_id, grade) of a data set in JSON lines and TSV."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").withColumnRenamed("_id", "qid")
    judged = read_graded(spark, f"{path}/qrels/{split}.tsv")
    return corpus, queries.join(judged.select("qid"), "qid", "left_semi"), judged


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path)
    f = checked(f, (F.get("f", F.lit(1)) != "0") | (F.get("f", F.lit(3)) != "1"), "a judgement is not of the form qid 0 pid 1")
    return f.select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).cast("long").alias("pid"), F.lit(1).alias("grade")).dropDuplicates(["qid", "pid"])


def read_candidates(spark: SparkSession, path: str, qrels: DataFrame | None = None) -> DataFrame:
    """(qid, pids, positives) from qid, pid, and what follows; where two or more columns follow, the last is a label, 0 or 1."""
    f = _fields(spark, path)
    label = F.when(F.size("f") >= 4, F.element_at("f", -1))
    f = checked(f, ~F.coalesce(label.isin("0", "1"), F.lit(True)), "a label is neither 0 nor 1")
    rows = f.select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(1)).cast("long").alias("pid"), label.alias("label"))
    pids = rows.groupBy("qid").agg(F.collect_list("pid").alias("pids"), F.collect_list(F.when(F.col("label") == "1", F.col("pid"))).alias("labelled"), F.count("label").alias("n"))
    pids = checked(pids, F.size("pids") != F.size(F.array_distinct("pids")), "a passage repeats for a query")
    if qrels is None:
        return pids.select("qid", "pids", F.col("labelled").alias("positives"))
    pids = checked(pids, F.col("n") > 0, "both labels and judgements are given")
    judged = qrels.groupBy("qid").agg(F.collect_set("pid").alias("positives"))
    return pids.join(judged, "qid", "left").select("qid", "pids", F.coalesce("positives", F.array().cast("array<bigint>")).alias("positives"))


def read_candidate_texts(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, query, passage), a passage once for a query."""
    f = _fields(spark, path)
    out = f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("qid", "pid", "query", "passage"))]).withColumn("pid", F.col("pid").cast("long"))
    w = Window.partitionBy("qid", "pid")
    return checked(out.withColumn("_n", F.count(F.lit(1)).over(w)), F.col("_n") > 1, "a passage repeats for a query").drop("_n")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="qid string, pid long, rank int, score double")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``pid``, dense from 0 by ascending key: places in sorted range partitions, which are written, and the sizes of those before."""
    own = rows.repartitionByRange(key).sortWithinPartitions(key)
    # The number of a row within its partition is in the low 33 bits.
    n = F.monotonically_increasing_id()
    own = materialize(own.select("*", F.shiftright(n, 33).alias("_part"), n.bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return own.join(before, "_part").select((F.col("_before") + F.col("_at")).alias("pid"), *rows.columns)


def from_documents(docs: DataFrame, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Collection (pid, text) and map (pid, doc_id), pids dense by ascending doc_id."""
    rows = numbered(docs.select("doc_id", *([title] if title else []), "text"), "doc_id")
    body = F.coalesce("text", F.lit(""))
    text = escape(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), body) if title else body)
    return rows.select("pid", text.alias("text")), rows.select("pid", "doc_id")


def extract_beir(spark: SparkSession, path: str, out: str, split: str = "test") -> None:
    """Write a data set as collection, map, questions and judgements (by pid) in TSV; refuses to overwrite."""
    corpus, queries, judged = read_beir(spark, path, split)
    collection, ids = from_documents(corpus, "title")
    ids = materialize(ids, "collection-map")
    write_tsv(collection, f"{out}/collection.tsv", "pid", "text")
    write_tsv(ids, f"{out}/collection_map.tsv", "pid", "doc_id")
    write_tsv(queries.withColumn("text", escape(F.col("text"))), f"{out}/questions.tsv", "qid", "text")
    write_tsv(judged.join(ids, "doc_id"), f"{out}/qrels.tsv", "qid", "pid", "grade")


def write_tsv(df: DataFrame, path: str, *columns: str) -> None:
    """Refuses to overwrite."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.when(F.lit(t == "boolean"), F.col(c).cast("int").cast("string")).otherwise(F.col(c).cast("string")), F.lit("")) for c, t in df.select(*columns).dtypes]).alias("value")).write.mode("errorifexists").text(path)


def write_ranking(ranking: DataFrame, path: str, provenance: dict | None = None) -> None:
    """TSV, and what it comes from beside it."""
    write_tsv(ranking, path, "qid", "pid", "rank", "score")
    ranking.sparkSession.createDataFrame([(json.dumps(provenance or {}),)], "value string").coalesce(1).write.mode("errorifexists").text(path + ".meta")


def write_questions(queries: DataFrame, path: str) -> None:
    """JSON lines of qid, question and all other columns; refuses to overwrite."""
    queries.withColumnRenamed("text", "question").write.mode("errorifexists").json(path)


def save_ranking(ranking: DataFrame, path: str) -> None:
    """The columns of a ranking as they are; refuses to overwrite."""
    ranking.write.mode("errorifexists").parquet(path)


def saved_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_backgrounds(queries: DataFrame, backgrounds: DataFrame, collection: DataFrame) -> DataFrame:
    """(qid, text) to (qid, text, background): the passages that (qid, i, pid) names, in order of i, joined by a separator; null where there are none."""
    named = backgrounds.join(collection.select("pid", F.col("text").alias("passage")), "pid")
    joined = named.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "passage"))), lambda x: x["passage"]), " [SEP] ").alias("background"))
    return queries.join(joined, "qid", "left").select("qid", "text", "background")
