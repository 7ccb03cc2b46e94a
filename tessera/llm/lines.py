r"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and A-Z
lower-cased, held as a 128-bit hash.  ``LineRuns`` keeps what is known of the
keys as sorted runs: tables bucketed by hash and sorted by it, each key once,
with the number of documents that hold it and its owner.  A batch of documents
is aggregated into a run of its own and merge-joined with the earlier runs,
bucket by bucket and without another exchange: keys that no earlier run holds
are new and get an owner, the others only add to the count.  Each level holds
at most ``fanout`` runs; then they are compacted into one run of the next level.

Batches come in descending ranges of the document id, so the first batch that
holds a key holds it in its largest document: that is the owner.  Keys of at
least ``MIN_CHARS`` code points in at least ``MIN_DOCS`` documents lose all
their lines except in their owner.

Cases: a null or empty text is one empty line; very long texts and lines need
memory in proportion to one text; a null id is the smallest id; rows that repeat an
id are one document to the count, and each is cut alike; a key that occurs several
times in its owner stays there as often; of equal rows each is cut alike;
an empty table gives an empty result; extra columns are ignored by the report
and carried by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit
from .shared import materialize, new_path

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
NO_ID = -(2**63)
KEY = ["h1", "h2"]


def _key(line: bytes) -> bytes | None:
    """Hash of a line's key, or none if the key is too short to count."""
    k = line.strip().lower()
    if len(k) < MIN_CHARS or (len(k) < 4 * MIN_CHARS and not k.isascii() and len(k.decode()) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(k)


def line_keys(docs: DataFrame) -> DataFrame:
    """(id, h1, h2): the distinct keys of each row; the texts do not leave the task."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch):
                ids, found = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = {_key(x) for x in (text or "").encode().split(b"\n")} - {None}
                    found += own
                    ids += [NO_ID if doc is None else doc] * len(own)
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(keys, "id long, h1 long, h2 long")


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, owner)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        df.select(*KEY, "docs", "owner").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_path(self.spark, "line-run")).format("parquet").saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of a batch whose key is in no run."""
        for run in self.runs():
            batch = batch.hint("merge").join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Take a batch of (id, h1, h2); new keys get their largest id as owner."""
        batch = self.spark.table(self._write(keys.groupBy(*KEY).agg(F.count_distinct("id").alias("docs"), F.max("id").alias("owner"))))
        if self.runs():
            new = self.unseen(batch).select(*KEY, F.lit(True).alias("new"))
            batch = batch.hint("merge").join(new, KEY, "left").select(*KEY, "docs", F.when(F.col("new"), F.col("owner")).alias("owner"))
            run = self._write(batch)
        else:
            run = self.made[-1]
        self._push(run, 0)

    def _push(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fanout:
            merged = self._write(self.merged(self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """All keys, each once, with its count and owner."""
        runs = self.runs() if runs is None else runs
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            # A merge of two sorted runs; between tables of equal buckets it needs no exchange.
            a, b = out.hint("merge").alias("a"), self.spark.table(run).alias("b")
            docs = F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))
            out = a.join(b, KEY, "full").select(*KEY, docs.alias("docs"), F.greatest("a.owner", "b.owner").alias("owner"))
        return out

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_keys(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, gone): for each document that loses lines, the hashes of their keys."""
    spark = docs.sparkSession
    keys = materialize(line_keys(docs), "line-keys")
    cuts = keys.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    store, edges = LineRuns(spark, fanout), [None, *sorted(set(cuts)), None]
    try:
        for lo, hi in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
            part = keys if lo is None else keys.where(F.col("id") > lo)
            store.add(part if hi is None else part.where(F.col("id") <= hi))
        common = materialize(store.merged().where(F.col("docs") >= MIN_DOCS).select(*KEY, "owner"), "common-lines")
    finally:
        store.forget()
    lost = keys.join(common, KEY).where(F.col("id") != F.col("owner"))
    return lost.groupBy("id").agg(F.collect_set(F.struct(*KEY)).alias("gone"))


def _with_gone(docs: DataFrame) -> DataFrame:
    """(row, gone), with null where nothing is lost."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(dropped_keys(docs), F.coalesce(F.col("row.doc_id"), F.lit(NO_ID)) == F.col("id"), "left").select("row", "gone")


def _kept(text: str | None, gone: list | None) -> tuple[list[bytes], int]:
    lines = (text or "").encode().split(b"\n")
    if not gone:
        return lines, len(lines)
    out = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in gone}
    return [x for x in lines if _key(x) not in out], len(lines)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch):
                out = []
                for doc, text, gone in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "gone")), strict=True):
                    kept, n = _kept(text, gone)
                    out.append((doc, n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_gone(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "gone")
    return rows.mapInArrow(report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, with the columns they came with."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = batch.column("row"), batch.column("row").type.get_field_index("text")
            texts = [None if t is None else b"\n".join(_kept(t, g)[0]).decode() for t, g in zip(row.field(at).to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            fields = [pa.array(texts, row.field(i).type) if i == at else row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays(fields, [row.type.field(i).name for i in range(row.type.num_fields)])

    return _with_gone(docs).mapInArrow(cut, docs.schema)


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, c.owner IS NOT NULL AND c.owner <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
