"""The pipeline's stages take effect, one on the other's rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
from test_operators import WS, brute_kept, brute_similar, brute_windows
from tokenizers import Tokenizer
from tessera.llm import decontaminate, jaccard, quality, tokens
from tessera.llm.shared import documents, materialize


def test_stages(spark, data):
    docs = documents(spark, data)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    good = materialize(P.good_documents(spark, docs, data), "s1")
    assert good.columns == docs.columns
    assert ids(good) == {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    one = materialize(P.one_of_similar(spark, good, data), "s2")
    assert ids(one) == {r.component_id for r in jaccard.similar(good).collect()}
    clean = materialize(P.without_benchmark(spark, one, data), "s3")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert ids(clean) == {r.doc_id for r in decontaminate.contamination(one, bench).where("NOT contaminated").collect()}
    mixed = materialize(P.mixed_sources(spark, clean, data), "s4")
    assert mixed.columns == docs.columns and ids(mixed) <= ids(clean)
    last = P.token_records(spark, mixed, data)
    assert last.count() == mixed.count()
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def brute_mix(rows):
    """Copies of each (id, text, source)."""
    size = {i: len(re.findall(WS, t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * total[s]}
        target |= {s: 3 * total[s] for s in full} if full else {s: weight[s] * level for s in free}
        left, free = left - sum(3 * total[s] for s in full), free - full if full else set()
    copies = {}
    for s in order:
        passes = int(target[s] // total[s])
        rest, own, end = target[s] - passes * total[s], defaultdict(list), 0
        for i in size:
            if source[i] == s:
                own[int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16)].append(i)
        for h in sorted(own):
            g = sum(size[i] for i in own[h])
            taken = end + g <= rest or (end <= rest and end + g - rest < rest - end)
            end += g
            copies |= {i: passes + taken for i in own[h]}
    return copies


def test_run_equals_a_chain_of_its_own(spark, data):
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in documents(spark, data).collect()]
    kept = brute_kept([r[:3] for r in rows])
    rows = [r for r in rows if kept[r[0]]]
    first = brute_similar({r[0]: r[1] for r in rows})
    rows = [r for r in rows if first[r[0]][2] == r[0]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hit = brute_windows({r[0]: r[1] for r in rows}, bench)
    rows = [r for r in rows if not hit[r[0]][4]]
    copies = brute_mix([(i, t, s) for i, t, _, s in rows])
    tk, want, start = Tokenizer.from_file(tokens.default_tokenizer()), [], 0
    for i, t, _, _ in sorted(rows):
        ids = np.array(tk.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, data).collect())
    assert got == want and len(want) > 50
