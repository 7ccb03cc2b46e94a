"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters,
A-Z lower-cased.  A window is ``WINDOW`` consecutive words of a benchmark item;
an item with fewer words, but at least one, is one window.  Every word of a
document inside an occurrence of a window is hit.

Windows are matched by a 64-bit hash of the word sequence, looked up in a
sorted array; hits are verified with a second, independent 64-bit hash over the
same words.  The set is broadcast only up to ``BROADCAST_WINDOWS`` windows.  A
larger benchmark is cut into blocks of that size, stored in the shared folder,
and each task takes the blocks one after the other: the result is the same.
The documents are not shuffled.

Cases: very long texts need memory in proportion to one text; windows that overlap
or tie hit a word once; null or empty texts have no words, so they neither hit nor are hit; an
empty benchmark hits nothing; a null item id is never listed, but its windows
count; equal items are all listed; repeated document rows are treated alike;
extra columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .files import open_fs
from .shared import new_path

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000

WINDOWS = "h long, g long, length int, items array<string>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = bk.flat(column)
    buf = bk.LOWER[buf]
    return (buf, *bk.spans(buf, offs, bk.IS_ALNUM))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items, with the ids of the items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bk.slices(batch):
                buf, s, e, first = _words(part.column("text"))
                a, b = bk.hash_spans(buf, s, e, 0), bk.hash_spans(buf, s, e, 1)
                n, out = np.diff(first), []
                for length in np.unique(np.minimum(n, window)):
                    if length:
                        h, g = bk.hash_windows(a, int(length), 1), bk.hash_windows(b, int(length), 0)
                        for i in np.flatnonzero(np.minimum(n, window) == length):
                            at = slice(first[i], first[i + 1] - length + 1)
                            out.append((np.repeat(i, at.stop - at.start), h[at], g[at], np.full(at.stop - at.start, length, np.int32)))
                if out:
                    i, h, g, length = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(bk.as_long(h)), pa.array(bk.as_long(g)), pa.array(length), part.column("item_id").cast(pa.string()).take(pa.array(i))], ["h", "g", "length", "item"])

    found = bench.select("item_id", "text").mapInArrow(cut, "h long, g long, length int, item string")
    return found.groupBy("h", "g", "length").agg(F.collect_set("item").alias("items"))


class Block:
    """Windows of one block, by length: sorted hashes, second hashes, items."""

    def __init__(self, table: pa.Table) -> None:
        self.by_length = {}
        h, g, length = (table.column(c).to_numpy() for c in ("h", "g", "length"))
        items = table.column("items").to_pylist()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            at = at[np.argsort(h[at].view(np.uint64), kind="stable")]
            self.by_length[int(n)] = (h[at].view(np.uint64), g[at].view(np.uint64), [items[i] for i in at])


def store_windows(windows: DataFrame, block: int = BROADCAST_WINDOWS) -> tuple[str, int]:
    """Write the windows to the shared folder as blocks of about ``block``; return path and number."""
    path = new_path(windows.sparkSession, "windows")
    windows.write.parquet(path + "/all")
    stored = windows.sparkSession.read.schema(WINDOWS).parquet(path + "/all")
    n = max(1, -(-stored.count() // block))
    if n == 1:
        return path + "/all", 1
    stored.withColumn("block", F.pmod("h", F.lit(n))).repartition("block").write.partitionBy("block").parquet(path + "/blocks")
    return path + "/blocks", n


def _load(path: str) -> Block:
    system, root = open_fs(path)
    return Block(pads.dataset(root, filesystem=system, format="parquet", partitioning=None).to_table(columns=["h", "g", "length", "items"]))


def _scanner(spark, windows: DataFrame, block: int):  # noqa: ANN001, ANN202
    """A function of a text column giving words, hit flags, and the items of each document."""
    path, n = store_windows(windows, block)
    shared = spark.sparkContext.broadcast(_load(path)) if n == 1 else None
    kept: dict[int, Block] = {}

    def blocks() -> Iterator[Block]:
        for k in range(n):
            if shared is not None:
                yield shared.value
            elif open_fs(f"{path}/block={k}")[0].get_file_info(open_fs(f"{path}/block={k}")[1]).type.name == "Directory":
                if k not in kept:
                    kept.clear()
                    kept[k] = _load(f"{path}/block={k}")
                yield kept[k]

    def scan(column: pa.Array) -> tuple:
        buf, s, e, first = _words(column)
        docs = len(first) - 1
        edges = np.zeros(len(s) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(docs)]
        a, doc = bk.hash_spans(buf, s, e, 0), bk.owner(first)
        b = None
        for blk in blocks():
            for length, (h, g, names) in blk.by_length.items():
                w = bk.hash_windows(a, length, 1)
                k = len(w)
                at = np.searchsorted(h, w) if k else np.zeros(0, np.int64)
                hit = np.flatnonzero((h[np.minimum(at, len(h) - 1)] == w) & (doc[:k] == doc[length - 1 : length - 1 + k])) if k else at
                if not len(hit):
                    continue
                if b is None:
                    b = bk.hash_spans(buf, s, e, 1)
                second = bk.hash_windows(b, length, 0)[hit]
                j = at[hit]
                good = g[j] == second
                # Equal first hashes of different windows are neighbours in the sorted array.
                step = 1
                while True:
                    nxt = np.minimum(j + step, len(h) - 1)
                    again = ~good & (j + step < len(h)) & (h[nxt] == w[hit])
                    if not again.any():
                        break
                    found = again & (g[nxt] == second)
                    j, good, step = np.where(found, nxt, j), good | found, step + 1
                hit, j = hit[good], j[good]
                np.add.at(edges, hit, 1)
                np.add.at(edges, hit + length, -1)
                for d, x in {*zip(doc[hit].tolist(), j.tolist(), strict=True)}:
                    items[d].update(i for i in names[x] if i is not None)
        return buf, s, e, first, np.cumsum(edges[:-1]) > 0, items

    return scan


def contamination(docs: DataFrame, bench: DataFrame, block: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    scan = _scanner(docs.sparkSession, benchmark_windows(bench), block)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bk.slices(batch):
                _, _, _, first, hit, items = scan(part.column("text"))
                n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0)
                names = [sorted(x) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0), pa.array(names, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )

    return docs.select("doc_id", "text").mapInArrow(report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", block: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without contamination, with the columns they came with.

    remove="documents" drops every document with a hit word; remove="spans" keeps
    all documents and cuts out each maximal run of hit words, putting a line end
    in its place.
    """
    scan = _scanner(docs.sparkSession, benchmark_windows(bench), block)

    # Columns travel by number, for a name with a dot would not be found.
    at = docs.columns.index("text")
    name = f"c{at}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bk.slices(batch, name):
                _, s, e, first, hit, _ = scan(part.column(name))
                if remove == "documents":
                    n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0)
                    yield part.filter(pa.array(n_hit == 0))
                    continue
                raw, offs = bk.flat(part.column(name))
                texts = part.column(name).to_pylist()
                for d in np.unique(bk.owner(first)[hit]).tolist():
                    h = np.flatnonzero(hit[first[d] : first[d + 1]]) + first[d]
                    ends = np.flatnonzero(np.diff(h) > 1)
                    lo, hi = s[h[np.r_[0, ends + 1]]], e[h[np.r_[ends, len(h) - 1]]]
                    keep = np.r_[offs[d], hi], np.r_[lo, offs[d + 1]]
                    texts[d] = b"\n".join(raw[x:y].tobytes() for x, y in zip(*keep, strict=True)).decode()
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bx),
dx AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hits AS (SELECT dx.doc_id, dx.n, dx.i, bx.item FROM dx JOIN bx ON dx.n = bx.n AND dx.g = bx.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
