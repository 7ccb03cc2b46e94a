"""The retrieval engine against SQL, against a numpy model, and on hand-made cases."""

import duckdb
import numpy as np
import pytest

from tessera import queries as Q
from tessera.config import Config, number_of_cells, staged_defaults, t_prime_for
from tessera.functions import vectors as V
from tessera.operators import metrics, search, staged
from tessera.plans import build, experiment
from tessera.sources import text as io
from tessera.streaming.append import append_stream


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(round(float(v), 4) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["topk_4bit", "topk_2bit", "staged_topk", "maxsim_exact_topk", "missing_estimate", "pack_residuals", "ndcg_at_k", "recall_at_k", "chunk_plan", "missing_configs", "index_plan"])
def test_equals_sql(spark, data, duck, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def tokens(spark, rows_, names="pid long, pos int, emb array<double>"):
    return spark.createDataFrame(rows_, names)


@pytest.fixture(scope="module")
def toy(spark):
    r = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(n, 8)))
    docs, cents, q = unit(60), unit(8), unit(6)
    d = tokens(spark, [(i // 3, i % 3, v.tolist()) for i, v in enumerate(docs)])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cents)], "cid long, emb array<double>")
    qt = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(q)], "qid long, t int, emb array<double>")
    return docs, cents, q, build.Index.build(d, 4, c), qt


def model(docs, cents, q, nprobe, t_prime, k):
    cell = (docs @ cents.T).argmax(1)
    res = docs - cents[cell]
    cut, w = np.quantile(res, np.arange(1, 16) / 16), np.quantile(res, (np.arange(16) + 0.5) / 16)
    code = np.searchsorted(cut, res, "left")
    approx = cents[cell] + w[code]
    size = np.bincount(cell, minlength=len(cents))
    out = {}
    for qid in range(2):
        best, base = {}, 0.0
        for t in range(3):
            v = q[qid * 3 + t]
            order = np.lexsort((np.arange(len(cents)), -(cents @ v)))
            m = (cents @ v)[order[min(np.searchsorted(np.cumsum(size[order]), t_prime), len(cents) - 1)]]
            base += m
            hit = {}
            for i in np.flatnonzero(np.isin(cell, order[:nprobe])):
                hit[i // 3] = max(hit.get(i // 3, -9), float(approx[i] @ v))
            for p, s in hit.items():
                best[p] = best.get(p, 0) + s - m
        out[qid] = [(p, base + s) for p, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize("nprobe", [1, 3, 8])
def test_search_equals_model(toy, engine, nprobe):
    docs, cents, q, index, qt = toy
    got = search.search(index, qt, 5, nprobe, 10, 8, engine).orderBy("qid", "rank").collect()
    want = model(docs, cents, q, nprobe, 10, 5)
    for qid in range(2):
        own = [(r.pid, r.score) for r in got if r.qid == qid]
        assert [p for p, _ in own] == [p for p, _ in want[qid]]
        assert np.allclose([s for _, s in own], [s for _, s in want[qid]])


def test_padding_is_ignored(spark, toy):
    _, _, _, index, qt = toy
    padded = qt.unionAll(spark.createDataFrame([(0, 3, [0.0] * 8)], qt.schema))
    a, b = (search.search(index, x, 5, 3, 10, 8).collect() for x in (qt, padded))
    assert sorted(a) == sorted(b)


def test_index_round_trip_and_stream(spark, toy, tmp_path):
    _, _, _, index, qt = toy
    read = index.write(str(tmp_path / "ix"))
    assert sorted(read.index.collect()) == sorted(index.index.select("cid", "pid", "pos", "codes").collect())
    more = tokens(spark, [(900, 0, [1.0] + [0.0] * 7)])
    more.write.parquet(str(tmp_path / "in"))
    append_stream(spark.readStream.schema(more.schema).parquet(str(tmp_path / "in")), read, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("pid").first()[0] == 900


def test_buckets_and_packing(spark):
    r = spark.createDataFrame([([0.1, 0.2, 0.3, 0.05],)], "x array<double>").select(V.bucketize("x", build._array([0.1, 0.2, 0.25])).alias("c")).withColumn("h2", V.pack_hex("c", 2)).withColumn("h4", V.pack_hex("c", 4)).first()
    assert list(r.c) == [0, 1, 3, 0] and r.h2 == "1C" and r.h4 == "0130"


@pytest.mark.parametrize("name", ["vec_dot_all", "vec_l2_dist_all"])
def test_all_products(spark, data, duck, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert len(got) == 32 * Q.doc_tokens(spark, data).count()
    a, b = (x.sort_values(["qid", "t", "pid", "pos"])["x"].to_numpy() for x in (got, want))
    assert np.abs(a - b).max() < 2e-4


@pytest.mark.parametrize("name", ["topk_nearest_4bit", "topk_nearest_2bit"])
def test_nearest_recall(spark, data, name):
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    m, ids = np.array(e.embedding.tolist(), np.float64), e.vec_id.to_numpy()
    want = {(q, p) for q, v in zip(ids, m, strict=True) if q % 50 == 0 for p in ids[np.lexsort((ids, -np.round(m @ v, 10)))[: Q.K]]}
    got = {(r.qid, r.pid) for r in Q.QUERIES[name](spark, data).collect()}
    print(name, "recall", len(got & want) / len(want))
    assert {q for q, _ in got} == {q for q, _ in want} and len(got & want) >= 0.9 * len(want)


def test_hash_search_reads_whole_texts(spark, tmp_path):
    """Each item's own document is told only by words far behind, in the document and in the item."""
    r = np.random.default_rng(2)
    common = [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(r.choice(common, n))
    docs = [(i, prose(700) + f" rare{i} last{i}") for i in range(20)]
    items = [(i, prose(60) + f" last{i} rare{i}") for i in range(0, 20, 3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Q.QUERIES["hash_encode_search"](spark, str(tmp_path)).where("rank = 1").collect()
    assert {(int(x.qid), x.pid) for x in got} == {(i, i) for i, _ in items}


def test_repeated_tokens_score_alike(toy):
    _, _, _, index, qt = toy
    a, b = (sorted((x.qid, x.rank, x.pid, round(x.score, 9)) for x in search.search(index, qt.unionAll(qt.selectExpr("qid", "t + 3 AS t", "emb")), 5, 3, 10, 8, e).collect()) for e in ("arrow", "repeats"))
    assert a == b


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "qid string, pid long, rank int")
    qrels = spark.createDataFrame([("a", 2, 1), ("a", 9, 1), ("b", 4, 1), ("c", 5, 1)], "qid string, pid long, grade int")
    assert metrics.success_at_k(ranking, qrels, 5).first()[0] == pytest.approx(1 / 3)
    assert metrics.recall_at_k(ranking, qrels, 5).first()[0] == pytest.approx(0.25)
    assert metrics.map_at_k(ranking, qrels, 5).first()[0] == pytest.approx(0.125)
    assert metrics.ndcg_at_k(ranking, qrels, 5).first()[0] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)) / 2, abs=1e-5)


def test_relu_and_l2(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0])], "qid long, t int, emb array<double>")
    d = tokens(spark, [(7, 0, [-1.0, 0.0])])
    s = staged.token_similarities(q, d)
    assert staged.maxsim(s).first().score == -1 and staged.maxsim(s, relu=True).first().score == 0
    assert staged.maxsim(staged.token_similarities(q, d, None, "l2")).first().score == -4


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tpassage\n0\tone\\ttwo\n1\tbody\ttitle\n")
    c = io.read_collection(spark, str(tmp_path / "c.tsv"))
    assert sorted(map(tuple, c.collect())) == [(0, "one\ttwo"), (1, "title | body")] and io.check_dense(c)
    (tmp_path / "q.tsv").write_text("x\tfirst\nx\tagain\n")
    with pytest.raises(Exception, match="repeats"):
        io.read_queries(spark, str(tmp_path / "q.tsv")).collect()
    (tmp_path / "r.tsv").write_text("a\t0\t3\t1\na\t0\t3\t1\n")
    assert io.read_qrels(spark, str(tmp_path / "r.tsv")).count() == 1


def test_settings():
    assert Config.merged({"nbits": 2}, {"k": 5, "other": 1}).k == 5
    assert number_of_cells(117, 4.0) == 256 and t_prime_for(100, 16, 10) == 1 and t_prime_for(10**9, 2**17, 100) == 50_000
    assert staged_defaults(10)["ndocs"] == 256 and staged_defaults(2000)["ndocs"] == 8000
    assert len(experiment.expand({"a": [1, 2], "b": 3, "c": [4, 5]})) == 4
    t = experiment.Tracker(["x"])
    with t.iteration(), t.step("x"):
        pass
    assert set(t.summary()) == {"x"}
