"""Removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if it lies in a ``LENGTH``-byte string of its document that also
starts earlier: in a smaller document, or earlier in the same one.

The transform of a whole corpus would be one sorted object, so the corpus is
first split into parts that cannot share a string of ``LENGTH`` bytes:

1. In each window of ``LENGTH`` bytes the gram of ``GRAM`` bytes with the
   smallest hash (leftmost on ties) is its seed; equal windows have equal seeds
   at equal offsets.  The windows of a seed cover a chunk.  Of equal chunks all
   but the first are repeats as a whole; grams with one chunk have no others.
2. The remaining chunks, those whose gram has several different ones, are cut in
   two: every window reaches far enough beyond its gram on the left or on the
   right to hold a longer core there.  Parts with one core are compared, all
   others cannot share a window.
3. The parts of a task are joined to one text, its Burrows-Wheeler transform is
   built, and the intervals of common prefixes are extended backwards, breadth
   first.  The intervals of strings of length k + 1 that end where no boundary is
   known yet bound suffixes with a common prefix of k bytes, so the lengths of
   common prefixes come out in increasing order.  The expansion stops at
   ``LENGTH``: suffixes not told apart by then share a window.

A core that so many different parts share that they exceed ``BATCH`` bytes is
not worked on in one piece: its parts are cut in two again, around a longer core,
in another round, until cores are whole windows.  Repeats within a task are
settled there, so a string that a third of all documents share sends one
occurrence per task, not one per document; and of a gram with more than ``MANY``
different chunks in a task only two go where the gram is decided upon.

Equal chunks and cores are told by 64-bit hashes; windows by their bytes.

Cases: null texts are empty; texts under ``LENGTH`` bytes are kept whole; very
long texts need memory in proportion to one text; a null id is the smallest; rows
that share an id are documents of their own, in the order of a hash of their
texts, but rows equal in id and text are one document to the search and each is
cut alike; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .shared import materialize

LENGTH, GRAM = 100, 32
NO_ID = -(2**63)
FLUSH, FLUSH_BYTES = 500_000, 8 << 20
#: Bytes of text, and of parts, that a bucket is meant to hold the seeds or the bytes of.
BUCKET_BYTES = 8 << 20
#: Bytes of parts that are transformed at once; below 2**21, for a position has 21 bits.
BATCH = 1 << 18
MANY = 64
SEP = 0xFF

_SEED = np.dtype([("g", "<u8"), ("q", "<u8"), ("doc", "<i8"), ("sub", "<i4"), ("lo", "<i4"), ("len", "<i4"), ("core", "<i4")])
#: core: the place of the core in the text, or -1 where the span is known to repeat.
_SPAN = np.dtype([("doc", "<i8"), ("sub", "<i4"), ("lo", "<i4"), ("len", "<i4"), ("core", "<i4")])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def seeds(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """The seeds of a buffer of documents, with the chunk that each owns."""
    n, wide = len(buf), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, _SEED)
    p, down = bk._prefix(bk._BYTE[buf], 0)
    m = n - GRAM + 1
    gram = bk.mix((p[GRAM:] - p[:m]) * down[:m])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (wide - step)], key[wide - step :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that stay within one document.
    valid = np.zeros(len(at), bool)
    edge = np.zeros(len(at) + 1, np.int64)
    long_ = np.diff(offs) >= LENGTH
    np.add.at(edge, offs[:-1][long_], 1)
    np.add.at(edge, offs[1:][long_] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    s = np.flatnonzero(valid)
    if not len(s):
        return np.zeros(0, _SEED)
    new = np.flatnonzero(np.r_[True, (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)])
    lo, hi, seed = s[new], s[np.r_[new[1:], len(s)] - 1] + LENGTH, at[s[new]]
    out = np.empty(len(lo), _SEED)
    owner = np.searchsorted(offs, lo, "right") - 1
    out["g"] = gram[seed]
    out["q"] = bk.mix((p[hi] - p[lo]) * down[lo] + ((hi - lo) * 1024 + (seed - lo)).astype(np.uint64))
    out["doc"], out["sub"], out["lo"], out["len"], out["core"] = doc[owner], sub[owner], lo - offs[owner], hi - lo, seed - offs[owner]
    return out


def _settle(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first occurrence of each chunk, by gram, and which the other occurrences."""
    order = np.lexsort((a["lo"], a["sub"], a["doc"], a["q"], a["g"]))
    b = a[order]
    once = _starts(b["g"], b["q"], b["doc"], b["sub"], b["lo"])
    order, b = order[once], b[once]
    first = _starts(b["g"], b["q"])
    return order[first], order[~first]


def _sizes(g: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each row of sorted ``g`` the number of rows, or the weight, of its like."""
    group = np.cumsum(_starts(g)) - 1
    return np.bincount(group, weight)[group] if len(g) else np.zeros(0, np.int64)


def _spans(a: np.ndarray, known: bool) -> np.ndarray:
    out = np.empty(len(a), _SPAN)
    for c in _SPAN.names:
        out[c] = a[c]
    if known:
        out["core"] = -1
    return out


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = bk.flat(part.column("text"))
    doc = part.column("doc").to_numpy(zero_copy_only=False)
    return buf, offs, doc, part.column("sub").to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.hash("text").alias("sub"), F.coalesce("text", F.lit("")).alias("text"))


def _buckets(spark, size: int) -> int:  # noqa: ANN001
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of some spans, one after the other."""
    length = length.astype(np.int64)
    return buf[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())]


def _send(a: np.ndarray, n: int, done: np.ndarray, texts: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows by bucket of ``g``, with the bytes from (buffer, starts) that belong to them; and spans, wherever."""
    bucket = (a["g"] >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    a, bucket = a[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    share = np.linspace(0, len(done), n + 1).astype(int)
    rows = []
    for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(share) > 0)).tolist():
        own = a[cuts[b] : cuts[b + 1]]
        text = b"" if texts is None else _gather(texts[0], texts[1][order[cuts[b] : cuts[b + 1]]], own["len"]).tobytes()
        rows.append((b, bk.pack_columns(own), text, bk.pack_columns(done[share[b] : share[b + 1]])))
        if len(rows) == 16:
            yield _sent(rows)
            rows = []
    if rows:
        yield _sent(rows)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "data", "text", "done"])


SENT = "bucket int, data binary, text binary, done binary"
FOUND = "doc long, sub int, lo int, len int, core int"


def _found(*spans: np.ndarray) -> pa.Table:
    a = np.concatenate(spans)
    return pa.table({c: pa.array(np.ascontiguousarray(a[c])) for c in _SPAN.names})


# ---- the transform --------------------------------------------------------


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings that each end in ``SEP``.

    Separators differ from each other, in the order of their places.  Prefixes
    are doubled; a sort is one of whole numbers that hold two ranks and a place.
    """
    n = len(text)
    at, low, bits = np.arange(n, dtype=np.uint64), np.uint64((1 << 21) - 1), np.uint64(21)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    padded = np.append(text, np.full(5, SEP, np.uint8))
    for i in range(5):
        c = padded[i : i + n]
        key = (key << np.uint64(8)) | np.where(open_, c, 0)
        open_ &= c != SEP
    reach, ended = 5, ~open_
    packed = np.sort((key << bits) | at)
    order, top = packed & low, packed >> bits
    new = np.ones(n, bool)
    new[1:] = (top[1:] != top[:-1]) | ended[order[1:].astype(np.int64)]
    while True:
        rank = np.empty(n, np.uint64)
        rank[order.astype(np.int64)] = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        if new.all():
            break
        after = np.zeros(n, np.uint64)
        after[: max(0, n - reach)] = rank[reach:]
        packed = np.sort((rank << np.uint64(42)) | (after << bits) | at)
        order, top = packed & low, packed >> bits
        new[1:] = top[1:] != top[:-1]
        reach *= 2
    sa = order.astype(np.int64)
    return sa, text[sa - 1]


def common_prefixes(bwt: np.ndarray, stop: int) -> np.ndarray:
    """For each suffix, in order, the common prefix with the one before it, or ``stop`` if it is no shorter; -1 for the first."""
    n = len(bwt)
    out = np.full(n + 1, stop, np.int32)
    out[0] = out[n] = -1
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n)
    run = np.zeros(n, np.int64)
    run[1:] = np.cumsum(bwt[1:] != bwt[:-1])
    begin = np.append(np.flatnonzero(_starts(run)), n)
    # Strings of one symbol; every separator is a symbol of its own, and the largest.
    edge = np.cumsum(np.bincount(bwt, minlength=256))
    symbols = np.flatnonzero(np.diff(edge, prepend=0)[:SEP])
    apart = np.arange(edge[SEP - 1], n)
    lb = np.concatenate([edge[symbols] - np.bincount(bwt, minlength=256)[symbols], apart])
    rb = np.concatenate([edge[symbols] - 1, apart])
    out[rb[rb < n - 1] + 1] = 0
    for length in range(1, stop):
        few = run[lb] == run[rb]
        if not few.all():
            # Intervals before which several symbols stand: the first and the last place of each.
            l, r = lb[~few], rb[~few]  # noqa: E741
            count = run[r] - run[l] + 1
            of = np.repeat(np.arange(len(l)), count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + run[l][of]
            first, last = np.maximum(begin[at], l[of]), np.minimum(begin[at + 1] - 1, r[of])
            key = of * 256 + bwt[first]
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(_starts(key[by]))
            lb, rb = np.concatenate([lb[few], first[by[new]]]), np.concatenate([rb[few], last[by[np.append(new[1:], len(by)) - 1]]])
        inside = bwt[lb] != SEP
        lb, rb = step[lb[inside]], step[rb[inside]]
        fresh = out[rb + 1] == stop
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        out[rb + 1] = length
    return out[:n]


def repeated_windows(parts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Spans of the windows that stand earlier, in parts ordered by document and place; ``text`` holds the parts, each followed by ``SEP``."""
    sa, bwt = transform(text)
    size = parts["len"].astype(np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    whole = np.zeros(len(text) + 1, np.int64)
    np.add.at(whole, start, 1)
    np.add.at(whole, start + size - LENGTH + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    group = np.cumsum(common_prefixes(bwt, LENGTH) < LENGTH)
    kept = whole[sa]
    at, group = sa[kept], group[kept]
    new = np.flatnonzero(_starts(group))
    least = np.minimum.reduceat(at, new) if len(new) else at
    again = np.sort(at[at != np.repeat(least, np.diff(np.append(new, len(at))))])
    of = np.searchsorted(start, again, "right") - 1
    begin = _starts(of)
    begin[1:] |= again[1:] > again[:-1] + LENGTH
    begin = np.flatnonzero(begin)
    out = np.empty(len(begin), _SPAN)
    if len(begin):
        own = of[begin]
        out["doc"], out["sub"], out["core"] = parts["doc"][own], parts["sub"][own], -1
        out["lo"] = parts["lo"][own] + again[begin] - start[own]
        out["len"] = again[np.append(begin[1:], len(again)) - 1] + LENGTH - again[begin]
    return out


def _compare(parts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats among the parts of a bucket, ``g`` being their cores; and the parts left for another round."""
    start = np.cumsum(parts["len"].astype(np.int64)) - parts["len"]
    first, again = _settle(parts)
    done = [_spans(parts[again], True)]
    g = parts["g"][first]
    first = first[_sizes(g) > 1]
    size = _sizes(parts["g"][first], parts["len"][first] + 1.0)
    later = _spans(parts[first[size > BATCH]], False)
    first, size = first[size <= BATCH], size[size <= BATCH]
    group = np.flatnonzero(_starts(parts["g"][first]))
    total = np.append(np.cumsum(parts["len"][first] + 1)[group] - parts["len"][first][group] - 1, (parts["len"][first] + 1).sum())
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, total[at] + BATCH, "right")) - 1)
        rows = first[group[at] : group[to] if to < len(group) else len(first)]
        rows = rows[np.lexsort((parts["lo"][rows], parts["sub"][rows], parts["doc"][rows]))]
        own = parts[rows]
        whole = np.full(int(own["len"].sum()) + len(own), SEP, np.uint8)
        inner = np.ones(len(whole), bool)
        inner[np.cumsum(own["len"].astype(np.int64) + 1) - 1] = False
        whole[inner] = _gather(text, start[rows], own["len"])
        done.append(repeated_windows(own, whole))
        at = to
    return np.concatenate(done), later


def _halves(buf: np.ndarray, base: np.ndarray, spans: np.ndarray, core: int) -> np.ndarray:
    """Each span as at most two parts with a longer core, to its left and to its right; ``base``: where their texts begin."""
    more = -(-(LENGTH - core) // 2)
    out = []
    last = spans["lo"] + spans["len"] - LENGTH
    by_core, by_text = bk.SpanHash(buf, 0), bk.SpanHash(buf, 1)
    for lo, hi, at in ((spans["lo"], np.minimum(last, spans["core"] - more), spans["core"] - more), (np.maximum(spans["lo"], spans["core"] - more + 1), last, spans["core"])):
        some = np.flatnonzero(lo <= hi)
        part = np.empty(len(some), _SEED)
        lo, hi, at, own = lo[some], hi[some] + LENGTH, at[some], base[some]
        for c in ("doc", "sub"):
            part[c] = spans[c][some]
        part["lo"], part["len"], part["core"] = lo, hi - lo, at
        part["g"] = by_core(own + at, own + at + core + more)
        part["q"] = bk.mix(by_text(own + lo, own + hi) + ((hi - lo) * 1024 + (at - lo)).astype(np.uint64))
        out.append((part, own + lo))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _round(docs: DataFrame, opened: DataFrame, core: int) -> DataFrame:
    """Compare the windows of open spans whose cores have ``core`` bytes; what is left open has longer ones."""
    size = opened.agg(F.coalesce(F.sum(2 * F.col("len").cast("long")), F.lit(0))).first()[0]
    n = _buckets(docs.sparkSession, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in bk.slices(batch):
                buf, offs, doc, sub = _keys(part)
                at = part.column("at")
                of = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                spans = np.empty(len(of), _SPAN)
                for i, c in enumerate(("lo", "len", "core")):
                    spans[c] = at.flatten().field(i).to_numpy()
                spans["doc"], spans["sub"] = doc[of], sub[of]
                own, begin = _halves(buf, offs[of], spans, core)
                held.append((own, _gather(buf, begin, own["len"])))
                size += len(held[-1][1])
                if size > FLUSH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own, text = (np.concatenate(x) for x in zip(*held, strict=True))
        start = np.cumsum(own["len"].astype(np.int64)) - own["len"]
        first, again = _settle(own)
        yield from _send(own[first], n, _spans(own[again], True), (text, start[first]))

    def compare(table: pa.Table) -> pa.Table:
        parts = bk.unpack_columns(table.column("data").to_pylist(), _SEED)
        text = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
        done, later = _compare(parts, text)
        return _found(done, later, bk.unpack_columns(table.column("done").to_pylist(), _SPAN))

    at = opened.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "len", "core")).alias("at"))
    parts = _keyed(docs).join(at, ["doc", "sub"]).mapInArrow(cut, SENT)
    return materialize(parts.groupBy("bucket").applyInArrow(lambda t: compare(t), FOUND), "repeat-windows")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, sub, lo, len): byte spans that start earlier elsewhere; they may overlap."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = _buckets(docs.sparkSession, size)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in bk.slices(batch):
                held.append(seeds(*_keys(part)))
                size += len(held[-1])
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(held)
        first, again = _settle(a)
        first, again = a[first], _spans(a[again], True)
        # Two different chunks open a gram for all; the others of many need not travel to find out.
        begin = _starts(first["g"])
        many = (_sizes(first["g"]) > MANY) & ~begin
        many[1:] &= ~begin[:-1]
        yield from _send(first[~many], n, np.concatenate([again, _spans(first[many], False)]))

    def meet(table: pa.Table) -> pa.Table:
        a = bk.unpack_columns(table.column("data").to_pylist(), _SEED)
        first, again = _settle(a)
        # A gram whose chunks differ is looked at more closely.
        first = a[first]
        return _found(_spans(a[again], True), bk.unpack_columns(table.column("done").to_pylist(), _SPAN), _spans(first[_sizes(first["g"]) > 1], False))

    found = materialize(_keyed(docs).mapInArrow(seek, SENT).groupBy("bucket").applyInArrow(lambda t: meet(t), FOUND), "repeat-chunks")
    out, core = found.where("core < 0"), GRAM
    while core < LENGTH and not found.where("core >= 0").isEmpty():
        found = _round(docs, found.where("core >= 0"), core)
        out, core = out.unionAll(found.where("core < 0")), core - (core - LENGTH) // 2
    return out.drop("core")


def _merged(lo: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent runs that cover the same bytes."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order].astype(np.int64), (lo + length)[order].astype(np.int64)
    top = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.r_[True, lo[1:] > top[:-1]])
    return list(zip(lo[new].tolist(), top[np.r_[new[1:], len(lo)] - 1].tolist(), strict=True))


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = repeats(docs).groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "len")).alias("at"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bk.slices(batch):
                out = []
                at = part.column("at")
                lo, length = (at.flatten().field(i).to_numpy() for i in (0, 1))
                cuts = np.concatenate([[0], np.cumsum(np.where(at.is_null().to_numpy(zero_copy_only=False), 0, at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))]).tolist()
                for i, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    data, runs = text.encode(), []
                    if cuts[i + 1] > cuts[i]:
                        runs = _merged(lo[cuts[i] : cuts[i + 1]], length[cuts[i] : cuts[i + 1]])
                    edges = [0, *(x for r in runs for x in r), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.hash("text").alias("sub"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(gone, ["doc", "sub"], "left").select("doc_id", "text", "at")
    return rows.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(hex(x[i + 1:i + 100])) AS h FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 99)) AS i FROM t WHERE octet_length(x) >= 100)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
b AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS new FROM a),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM r UNION ALL SELECT t.doc_id, coalesce(max(r.hi), 0), octet_length(any_value(x)) FROM t LEFT JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id),
s AS (SELECT t.doc_id, sha256(unhex(coalesce(string_agg(hex(x[lo + 1:hi]), '' ORDER BY lo), ''))) AS kept_sha256 FROM t JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id),
n AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM t JOIN s ON s.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""
