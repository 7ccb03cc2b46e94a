"""Token-ID output: length-delimited binary records with a separate offset index.

Shard file (``part-NNNNNN.rec``), one record per document, little-endian::

    u64 length | u32 masked_crc(length bytes) | payload | u32 masked_crc(payload)
    payload = i64 doc_id | u8 flags (1: the id is null) | u8 id width | ids

Ids take 2 bytes when the vocabulary allows it, else 4.  The checksum is CRC-32,
rotated by 15 bits and offset, so that checksums of data holding checksums stay
well distributed.  Index file (``part-NNNNNN.idx``): 8 magic bytes, then one
28-byte entry per record (doc_id, flags, offset, length, number of ids), for
shuffled reads; its last 4 bytes are the masked checksum of the entries.

Documents are range-partitioned by id and sorted, so shard after shard holds
them in ascending id order (null first; rows that repeat an id in the order of
a hash of their texts, then of the texts; they may spread over several shards).
A shard is written under a temporary name and renamed, so a rerun of a lost
task replaces a shard by the same bytes.  The manifest, a Parquet table with a
row per shard, is what makes shards part of the data set.

Encoding: the pre-tokenizer never joins a character to white space after it, nor
a letter to a digit or mark, nor a mark other than the apostrophe to a letter, so
a text may be cut there (white space stays with what follows it).
Pieces are encoded by the tokenizers library once and looked up afterwards; a
text for which that cut is not provably safe is encoded as one piece, as is any
text under a tokenizer that is not plain byte-level.

Cases: a null text encodes as empty; an empty table makes an empty manifest;
very long texts need memory in proportion to one text; rows equal in id and
text are written as often as they occur; extra columns are not written.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytekit
from .files import Attempt, open_fs
from .shared import new_path

MAGIC = b"TESIDX01"
ENTRY = np.dtype([("doc_id", "<i8"), ("flags", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u4")])
#: Cached pieces per worker; beyond this the cache starts afresh, with equal results.
CACHE_PIECES = 1_000_000
LONGEST_PIECE = 64
#: Records that are read back at once.
READ_ROWS = 256
_MARKS = string.punctuation
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 13]] = True
#: ASCII letters, what ends a run of letters, and of that what a letter after it never joins.
_KIND = np.zeros(256, np.uint8)
_KIND[[*string.ascii_letters.encode()]] = 1
_KIND[[*string.digits.encode(), ord("'")]] = 2
_KIND[[*_MARKS.replace("'", "").encode()]] = 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class PieceEncoder:
    """Encodes texts as packed ids, with ``end_id`` after each.

    Texts are cut where the pre-tokenizer is known to cut them, see above; each
    piece is encoded once, in place of its id stands its number in ``seen``, and
    the ids of a whole slice are gathered at once.  Other tokenizers than plain
    byte-level ones get whole texts.
    """

    # Bytes of the Unicode white space beyond space, \t, \n and \r.
    _rare = rb"[\x0b\x0c]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"

    def __init__(self, path: str, end_id: int = 0) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end, self.model = end_id, self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        self.by_pieces = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not made["model"].get("ignore_merges") and not made["model"].get("continuing_subword_prefix")
        special = [re.escape(x["content"].encode()) for x in made.get("added_tokens") or [] if x["content"]]
        self.unsafe = re.compile(b"|".join([self._rare, *special]))
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.n = self.used = 0
        self.start, self.count, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, self.kind)

    def _piece(self, x: str) -> list[int]:
        """Ids of a piece: after white space, letters and perhaps marks after them, which are pre-tokens of their own."""
        core = x.rstrip(_MARKS)
        if (core[1:] if core[:1] == " " else core).isalpha():
            own = [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(_BYTE_CHARS))]
            return own + self._one(x[len(core) :]) if len(core) < len(x) else own
        return self._one(x)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def _add(self, ids: list[int]) -> int:
        n = len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if self.n == len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + n] = ids
        self.start[self.n], self.count[self.n] = self.used, n
        self.used += n
        self.n += 1
        return self.n - 1

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        first = np.zeros(len(buf) + 1, bool)
        if self.by_pieces:
            blank = _BLANK[buf]
            first[:-1] = blank
            first[1:-1] &= ~blank[:-1]
            if len(buf):
                kind = _KIND[buf]
                first[1:-1] |= (kind[:-1] == 1) & (kind[1:] >= 2) | (kind[:-1] == 3) & (kind[1:] == 1)
            for d in {*np.searchsorted(offs, [m.start() for m in self.unsafe.finditer(buf)], "right").tolist()}:
                first[offs[d - 1] : offs[d]] = False
        first[offs] = True
        return np.flatnonzero(first[:-1])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts in them."""
        buf, offs = bytekit.flat(column)
        s = self._pieces(buf, offs)
        e = np.append(s[1:], len(buf))
        at, inverse = bytekit.distinct(bytekit.hash_spans(buf, s, e))
        if self.n + len(at) > CACHE_PIECES:
            self._clear()
        raw, seen, rows = buf.tobytes(), self.seen, []
        for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True):
            x = raw[a:b]
            row = seen.get(x)
            if row is None:
                short = self.by_pieces and b - a <= LONGEST_PIECE
                row = self._add((self._piece if short else self._one)(x.decode()))
                if short:
                    seen[x] = row
            rows.append(row)
        rows = np.array(rows, np.int64)
        count = self.count[rows][inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[rows][inverse] - total[:-1], count) + np.arange(total[-1])] if len(s) else self.flat[:0]
        ends = total[np.searchsorted(s, offs)]
        if self.n > 2 * len(self.seen):
            # Mostly pieces that are not kept.
            self._clear()
        return np.insert(ids, ends[1:], self.end), ends + np.arange(len(ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offs = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def worker_encoder(path: str, end_id: int) -> PieceEncoder:
    """The encoder of this Python process, which outlives a task and its functions: the next task finds its pieces."""
    kept = sys.modules.setdefault("tessera-worker-encoders", types.ModuleType("tessera-worker-encoders")).__dict__
    if (path, end_id) not in kept:
        kept[path, end_id] = PieceEncoder(path, end_id)
    return kept[path, end_id]


def _byte_chars() -> dict[int, int]:
    """Bytes to the printable characters by which byte-level vocabularies write them."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in keep)}


_BYTE_CHARS = _byte_chars()

MANIFEST = "shard int, path string, first_doc long, n_docs long, n_tokens long, n_bytes long"


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write doc_id and text of ``docs`` as shards under ``path``; return the manifest, in shard order of ids."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, root = open_fs(path)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, end_id)
        system, root = open_fs(path)
        shard = TaskContext.get().partitionId()
        name = f"{root}/part-{shard:06d}"
        entries, at, first, tokens, begun = [], 0, None, 0, False
        wide = encoder.kind.itemsize
        with Attempt(system, name + ".rec") as out:
            for batch in batches:
                for part in bytekit.slices(batch):
                    ids, offs = encoder.encode_column(part.column("text"))
                    own = np.zeros(part.num_rows, ENTRY)
                    own["doc_id"] = pc.fill_null(part.column("doc_id"), 0)
                    own["flags"] = part.column("doc_id").is_null()
                    own["n"] = np.diff(offs)
                    own["length"] = own["n"] * wide + 10
                    own["offset"] = at + np.cumsum(own["length"].astype(np.int64) + 16) - (own["length"] + 16)
                    raw, records = ids.tobytes(), []
                    for doc, flags, length, a, b in zip(own["doc_id"].tolist(), own["flags"].tolist(), own["length"].tolist(), (offs[:-1] * wide).tolist(), (offs[1:] * wide).tolist(), strict=True):
                        payload = struct.pack("<qBB", doc, flags, wide) + raw[a:b]
                        head = struct.pack("<Q", length)
                        records += (head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload)))
                    data = b"".join(records)
                    out.write(data)
                    entries.append(own)
                    at += len(data)
                    first, begun = (first, True) if begun else (part.column("doc_id")[0].as_py(), True)
                    tokens += len(ids)
        entries = np.concatenate(entries) if entries else np.zeros(0, ENTRY)
        index = entries.tobytes()
        with Attempt(system, name + ".idx") as out:
            out.write(MAGIC + index + struct.pack("<I", masked_crc(index)))
        if len(entries):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/part-{shard:06d}", "first_doc": first, "n_docs": len(entries), "n_tokens": tokens, "n_bytes": at}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    # The hash splits what one id (or none) holds over several shards.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).drop("h")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _index(system, path: str) -> np.ndarray:  # noqa: ANN001
    with system.open_input_file(path + ".idx") as f:
        data = f.read()
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != masked_crc(data[8:-4]):
        raise ValueError(f"{path}.idx is damaged")
    return np.frombuffer(data[8:-4], ENTRY)


def _payload(record: bytes, where: str) -> tuple[int | None, np.ndarray]:
    """Id and token ids of one framed record, its checksums verified."""
    (length,) = struct.unpack_from("<Q", record)
    payload = record[12 : 12 + length]
    if struct.unpack_from("<I", record, 8)[0] != masked_crc(record[:8]) or len(record) != length + 16 or struct.unpack_from("<I", record, 12 + length)[0] != masked_crc(payload):
        raise ValueError(f"damaged record in {where}")
    doc, flags, width = struct.unpack_from("<qBB", payload)
    return (None if flags & 1 else doc), np.frombuffer(payload, f"<u{width}", offset=10)


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard, in order, without its index."""
    system, root = open_fs(path)
    with system.open_input_stream(root + ".rec", buffer_size=4 << 20) as f:
        while head := f.read(12):
            (length,) = struct.unpack_from("<Q", head)
            if struct.unpack_from("<I", head, 8)[0] != masked_crc(head[:8]):
                raise ValueError(f"damaged length in {path}")
            yield _payload(head + f.read(length + 4), path)


def read_at(path: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a shard by position, in any order, found through the index."""
    system, root = open_fs(path)
    index, out = _index(system, root), []
    with system.open_input_file(root + ".rec") as f:
        for p in positions:
            f.seek(int(index["offset"][p]))
            out.append(_payload(f.read(int(index["length"][p]) + 16), path))
    return out


def summarise(manifest: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start, n_tokens, ids_crc32, shard, position."""
    starts = manifest.select("shard", "path", (F.sum("n_tokens").over(Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, records = row["start"], enumerate(read_shard(row["path"]))
                while some := list(itertools.islice(records, READ_ROWS)):
                    out = []
                    for i, (doc, ids) in some:
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], i))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, position long")


def token_report(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared place and summarise what was written."""
    return summarise(write_records(docs, new_path(spark, "token-records"), tokenizer))
