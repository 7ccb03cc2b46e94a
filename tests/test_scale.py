"""Steps that grow with the tables: counted, blocked and multiplied in parts, with the results of the plain way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.encode import get_encoder
from tessera.operators import search, words
from tessera.plans import build


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(3)
    some = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(r.choice(some, r.integers(1, 60)))) for i in range(70)] + [(70, None), (71, "  "), (72, "W1 w1\tw2")]
    asked = [(f"q{i}", " ".join(r.choice(some + ["unseen", "other"], 12))) for i in range(9)]
    return spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "id string, text string")


def unpacked(rows):
    return [(r.cid, r.pid, r.pos, [x for b in bytes(r.codes) for x in (b >> 4, b & 15)]) for r in rows]


def test_words_rank_as_tokens(spark, texts, monkeypatch):
    """An index of different words, searched by blocks, against one of all tokens with the same cells and codes."""
    docs, asked = texts
    enc = get_encoder("hash")
    own = words.WordIndex.build(docs, enc)
    tokens = enc(docs, None).join(own.words, "word").select("cid", F.col("id").alias("pid"), "pos", "codes").collect()
    assert own.num_tokens == len(tokens) and len(own.words.collect()) == 90
    rows = spark.createDataFrame(unpacked(tokens), "cid long, pid long, pos int, codes array<tinyint>")
    codec = spark.createDataFrame([(4, [0.0], own.weights)], "nbits int, cutoffs array<double>, weights array<double>")
    cells = spark.createDataFrame([(i, int(n)) for i, n in enumerate(own.cells)], "cid long, n long")
    plain = build.Index(own.centroids, codec, rows, cells, {"num_embeddings": len(tokens)})
    q = enc(asked, None).select(F.col("id").alias("qid"), F.col("pos").alias("t"), "emb")
    of = lambda df: sorted((r.qid, r["rank"], r.pid, round(r.score, 8)) for r in df.collect())
    for bound, t_prime in ((12, 10**9), (12, 40), (len(own.cells), len(tokens))):
        want = of(search.search(plain, q, 5, bound, t_prime, bound))
        assert of(own.search(asked, 5, bound, t_prime)) == want
    monkeypatch.setattr(words, "QUERY_TOKENS", 30)
    assert of(own.search(asked, 5, len(own.cells), len(tokens))) == want


def test_blocks_in_small_parts(spark, texts, monkeypatch):
    """However few scores a task holds at once, a block's best passages are the same."""
    own = words.WordIndex.build(texts[0], get_encoder("hash"))
    left = own.blocks.toArrow().slice(0, 1)
    right = own.blocks.where(F.col("block") == left["block"][0].as_py()).select(F.posexplode("words").alias("at", "word")).join(own.words, "word").toArrow()
    r = np.random.default_rng(1)
    m, n = r.normal(size=(11, 64)), len(own.cells)
    probed = np.array([r.permutation(n)[:7] for _ in m])
    word, query = np.r_[np.arange(11), [3, 3]], np.r_[np.arange(11) % 4, [0, 1]]
    asked = (m, probed, r.normal(size=probed.shape), r.normal(size=11), word, query, pa.array(list("abcd")), np.array(own.weights))

    def of(t):  # a part of a block gives its own best passages
        found = sorted((q, -round(s, 9), p) for q, p, s in zip(*(t[c].to_pylist() for c in ("qid", "pid", "score")), strict=True))
        return [x for q in "abcd" for x in [y for y in found if y[0] == q][:3]]

    want = of(words.best_of_block(left, right, asked, 3))
    assert len(want) == 12
    for name, x in (("SCORES", 40), ("QUERY_WORDS", 2), ("GIVEN", 3)):
        monkeypatch.setattr(words, name, x)
    assert of(words.best_of_block(left, right, asked, 3)) == want


def test_no_texts(spark):
    none = spark.createDataFrame([(1, None)], "id long, text string")
    asked = spark.createDataFrame([("a", "x y")], "id string, text string")
    assert words.WordIndex.build(none, get_encoder("hash")).search(asked, 5, 8, 1).collect() == []


def test_best_cells_on_ties():
    """Single precision finds what double precision would, the first of equal cells too."""
    r = np.random.default_rng(4)
    m = r.normal(size=(50, 16))
    m[[9, 30]] = m[7]
    m[20] = m[3] * (1 + 1e-9)
    x = np.concatenate([r.normal(size=(300, 16)), m, np.zeros((2, 16)), m[:4] * 1e30])
    assert build.best_cells(x, m, m.astype(np.float32)).tolist() == np.round(x @ m.T, 12).argmax(1).tolist()


@pytest.mark.parametrize("few", [4, 1 << 18])
def test_quantiles_are_counted(spark, monkeypatch, few):
    """Exact quantiles from counts, whether values are refined to the last bit or few are left early; repeats, both zeros and signs among them."""
    monkeypatch.setattr(build, "FEW_VALUES", few)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=700), r.normal(size=200) * 1e-6, np.full(150, 0.25), np.zeros(30), -np.zeros(20), [-1e300, 1e300, 5e-324, -5e-324]]).reshape(-1, 4)
    res = spark.createDataFrame([(v.tolist(),) for v in r.permutation(x)], "res array<double>").repartition(3)
    got = build.train_codec(res, 4).first()
    for found, shares in ((got.cutoffs, np.arange(1, 16) / 16), (got.weights, (np.arange(16) + 0.5) / 16)):
        at = shares * (x.size - 1)
        low, high = np.sort(x.ravel())[np.floor(at).astype(int)], np.sort(x.ravel())[np.ceil(at).astype(int)]
        assert np.allclose(found, low + (high - low) * (at % 1), rtol=1e-12, atol=0)
    assert got.avg_residual == pytest.approx(np.abs(x).mean())
    none = build.train_codec(res.limit(0), 2).first()
    assert none.cutoffs is None and none.weights is None


def test_no_task_gathers_the_components(spark, monkeypatch):
    """Passes over the components return counts: far fewer rows than components, even where all are different."""
    seen, counts = [], build._counts
    monkeypatch.setattr(build, "_counts", lambda *x: seen.append(len((y := counts(*x))[0])) or y)
    monkeypatch.setattr(build, "FEW_VALUES", 256)
    res = spark.range(2000).select(F.array([F.rand(i) - 0.5 for i in range(16)]).alias("res"))
    build.train_codec(res, 4)
    assert 2 < len(seen) and max(seen) < 25_000 and seen[-1] <= 62 * 256 < 32_000


@pytest.mark.parametrize("k", [3, 40, 500])
def test_nearest_in_blocks(spark, monkeypatch, k):
    """One token on either side: blocks of both find what the search of all finds, and no pair of a query and a token is shuffled."""
    monkeypatch.setattr(search, "NEAREST_QUERIES", 7)
    monkeypatch.setattr(search, "NEAREST_TOKENS", 60)
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 16))
    x[200:] = x[:100]
    tokens = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "pid long, pos long, emb array<double>")
    index = build.Index.build(tokens, 4, cells=24)
    asked = tokens.where("pid % 9 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("t"), "emb")
    of = lambda df: sorted((r.qid, r["rank"], r.pid, round(r.score, 8)) for r in df.collect())
    got = of(search.nearest(index, asked, k, 6))
    assert got == of(search.search(index, asked, k, 6, None, 24)) and len(got) > 34
