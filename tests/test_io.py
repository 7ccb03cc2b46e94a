"""Sources, sinks and index files: against SQL, and where they must refuse."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import io_queries as Q
from tessera.functions import encode
from tessera.operators import metrics, search
from tessera.plans import build, experiment
from tessera.sources import text as io


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(frame):
    plain = lambda v: round(float(v), 4) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", Q.QUERIES)
def test_equals_sql(spark, data, duck, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got) > 0


def test_sources_refuse(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="gaps"):
        io.read_collection(spark, file("c.tsv", "0\ta\n2\tb\n"), dense=True)
    with pytest.raises(Exception, match="neither 0 nor 1"):
        io.read_candidates(spark, file("l.tsv", "q\t1\t1\t2\n")).collect()
    with pytest.raises(Exception, match="both labels and judgements"):
        io.read_candidates(spark, file("b.tsv", "q\t1\t1\t0\n"), spark.createDataFrame([("q", 1)], "qid string, pid long")).collect()
    with pytest.raises(Exception, match="repeats"):
        io.read_candidate_texts(spark, file("t.tsv", "q\t1\ta\tb\nq\t1\ta\tb\n")).collect()
    assert io.read_candidates(spark, file("r.tsv", "q\t5\t1\nq\t6\t0\n")).first().positives == []
    with pytest.raises(Exception, match="(?i)exists"):
        io.save_ranking(spark.range(1), str(tmp_path / "c.tsv"))


def test_escapes_are_read_as_such(spark):
    """A literal backslash and n, written as they are, come back as a line end."""
    r = spark.createDataFrame([("a\\nb",), ("a\nb",)], "t string").select(io.unescape(io.escape(F.col("t"))).alias("t")).collect()
    assert [x.t for x in r] == ["a\nb", "a\nb"]


def test_numbering_is_dense_and_sorted(spark):
    got = io.numbered(spark.createDataFrame([(f"d{i * 7 % 100:03d}",) for i in range(100)], "k string").repartition(7), "k").orderBy("pid").collect()
    assert [(r.pid, r.k) for r in got] == [(i, f"d{i:03d}") for i in range(100)]


def test_build_modes(spark, tmp_path):
    r = np.random.default_rng(1)
    tokens = spark.createDataFrame([(i // 3, i % 3, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(r.normal(size=(60, 8)))], "pid long, pos int, emb array<double>")
    path = str(tmp_path / "ix")
    first = build.build_index(tokens, path, cells=4)
    with pytest.raises(FileExistsError):
        build.build_index(tokens, path, cells=4)
    assert build.build_index(tokens.limit(0), path, "reuse").meta == first.meta
    half = build.build_index(tokens.where("pid < 10"), path, True, cells=4)
    assert half.meta["num_embeddings"] == 30
    with pytest.raises(ValueError, match="cells"):
        build.verified(build.Index(half.centroids, half.codec, half.index, half.cells.limit(1), half.meta))


def test_kmeans_equals_numpy(spark):
    """Lloyd's steps on the sphere from the same start."""
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tokens = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "pid long, pos int, emb array<double>")
    order = [r.pid for r in tokens.orderBy(F.xxhash64("pid", "pos", F.lit(123)), "pid", "pos").collect()]
    m = x[order[:5]]
    for _ in range(4):
        cell = np.round(x @ m.T, 12).argmax(1)
        m = np.array([x[cell == c].mean(0) if (cell == c).any() else m[c] for c in range(5)])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = np.array([r.emb for r in build.kmeans(tokens, 5).orderBy("cid").collect()])
    assert np.allclose(got, m)


def test_heldout_share(spark):
    got = build.split_heldout(spark.range(40_000).select(F.col("id").alias("pid"), F.lit(0).alias("pos")))
    n = got.where("heldout").count()
    assert 1800 < n < 2200 and got.where("heldout").count() == n


def test_graded_metrics(spark):
    ranking = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3)], "qid string, pid long, rank int")
    qrels = spark.createDataFrame([("a", 2, 3), ("a", 3, 1), ("a", 9, 2)], "qid string, pid long, grade int")
    want = (3 / np.log2(3) + 1 / 2) / (3 + 2 / np.log2(3) + 1 / 2)
    assert metrics.ndcg_at_k(ranking, qrels, 3).first()[0] == pytest.approx(want, abs=1e-5)
    assert set(metrics.evaluate(ranking, qrels, True)) == {f"{m}@{k}" for m in ("nDCG", "MAP", "Recall") for k in (5, 10, 50, 100)}


def test_executor_takes_up_where_it_ended(spark, tmp_path):
    ran = []

    def run(c):
        if c["x"] == 2 and len(ran) < 2:
            ran.append("broke")
            raise RuntimeError
        ran.append(c["x"])
        return {"y": c["x"] * 10}

    configs = experiment.expand({"x": [1, 2, 3]})
    with pytest.raises(RuntimeError):
        experiment.execute(spark, configs, run, str(tmp_path / "r"))
    got = experiment.execute(spark, configs, run, str(tmp_path / "r")).collect()
    assert sorted(json.loads(r.result)["y"] for r in got) == [10, 20, 30] and ran == [1, "broke", 2, 3]


def test_skip_list_and_policies(spark):
    d = spark.createDataFrame([(1, "Some words , and more !")], "id long, text string")
    kept = encode.get_encoder("hash-document")(d, None).orderBy("pos").collect()
    assert [(r.pos, r.word) for r in kept] == [(0, "[D]"), (1, "some"), (2, "words"), (4, "and"), (5, "more")]
    skipped = encode.drop_skipped(encode.get_encoder("hash")(d, None), spark.createDataFrame([(",",), ("!",)], "word string"))
    assert sorted(r.word for r in skipped.collect()) == ["and", "more", "some", "words"]
    assert encode.get_encoder("hash-query")(d, 32).count() == 32


def test_command_line(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("".join(f"{i}\tpassage number{i} about thing{i % 3}\n" for i in range(12)))
    (tmp_path / "q.tsv").write_text("a\tnumber7 thing1\n")
    at = lambda x: str(tmp_path / x)
    cli.main(["index", "-c", at("c.tsv"), "-o", at("ix"), "-n", "4"])
    cli.main(["search", "-i", at("ix"), "-q", at("q.tsv"), "-o", at("out"), "-k", "3"])
    assert io.read_ranking(spark, at("out")).where("rank = 1").first().pid == 7


def test_flat_is_the_inverse_of_grouped(spark):
    r = spark.createDataFrame([("a", 4, 0.5, 1), ("a", 9, 0.25, 2), ("b", 4, 0.1, 1)], "qid string, pid long, score double, rank int")
    assert sorted(search.flat(search.grouped(r)).collect()) == sorted(r.collect())
