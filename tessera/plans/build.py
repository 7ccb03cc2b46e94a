"""Index build: cells, residual codec, and the inverted table of compressed tokens.

Tables: tokens (pid, pos, emb), centroids (cid, emb), index (cid, pid, pos,
codes), cells (cid, n), codec (one row: nbits, cutoffs, weights, avg_residual).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import number_of_cells, sample_size, t_prime_for
from ..functions import vectors as V

#: Centroids travel to the tasks in blocks of at most this many bytes.
CENTROID_BYTES = 64 << 20
#: Scores of tokens by cells that a task holds at once.
SCORE_CELLS = 4 << 20
#: Components that are counted one by one when quantiles are told.
FEW_VALUES = 1 << 18
#: Cells whose sums travel together.
SUM_CELLS = 1024
#: Tokens from which on a codec is trained on the held-out part alone.
HELDOUT_FROM = 10_000
#: Passages whose offsets are added up together.
OFFSET_RUN = 1 << 20


def id_order(column: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(column), F.lit(seed)), F.col(column)]


def sample_pids(passages: DataFrame, n: int, seed: int = 123) -> DataFrame:
    """A fixed-size sample without replacement, the same on each run."""
    return passages.select("pid").distinct().orderBy(*id_order("pid", seed)).limit(n)


def split_heldout(tokens: DataFrame, share: float = 0.05, most: int = 50_000, seed: int = 123, n: int | None = None) -> DataFrame:
    """tokens, n in number, with a flag for the held-out part: a hashed share, so no global order is needed."""
    n = tokens.count() if n is None else n
    share = min(share, most / n) if n else share
    return tokens.withColumn("heldout", F.pmod(F.xxhash64("pid", "pos", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def matrix_blocks(centroids: DataFrame, limit: int = CENTROID_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centroids in ascending blocks of bounded size, as (ids, matrix)."""
    dim, lo, hi = centroids.agg(F.max(F.size("emb")), F.min("cid"), F.max("cid")).first()
    if lo is None:
        return
    rows = max(1, limit // (8 * (dim or 1)))
    for at in range(lo, hi + 1, rows):
        part = centroids if hi - lo < rows else centroids.where(F.col("cid").between(at, at + rows - 1))
        t = part.orderBy("cid").select("cid", F.col("emb").cast("array<double>").alias("emb")).toArrow()
        if t.num_rows:
            yield t.column("cid").to_numpy().astype(np.int64), _matrix(t.column("emb").combine_chunks())


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def best_cells(x: np.ndarray, m: np.ndarray, single: np.ndarray) -> np.ndarray:
    """For each row the place of the centroid of largest dot product, rounded to 12 digits, the first on ties.

    Products in single precision tell where the best is ahead by more than their error; other rows are multiplied again.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        s = x.astype(np.float32) @ single.T
        at = s.argmax(1)
        rows = np.arange(len(x))
        top = s[rows, at].astype(np.float64)
        s[rows, at] = -np.inf
        error = 2e-7 * (x.shape[1] + 8) * np.linalg.norm(x, axis=1) * np.linalg.norm(m, axis=1).max(initial=0.0) + 2e-12
        again = np.flatnonzero(~(s.max(1) < top - 2 * error))
    step = max(1, SCORE_CELLS // len(m))
    for lo in range(0, len(again), step):
        own = again[lo : lo + step]
        at[own] = np.round(x[own] @ m.T, 12).argmax(1)
    return at


def assign(tokens: DataFrame, centroids: DataFrame, sent: list[Broadcast] | None = None) -> DataFrame:
    """tokens with ``cid``, the cell of largest dot product (the lowest on ties), by matrix products in the tasks.

    sent: gets what was broadcast, for a caller who knows when it is done with, since each stays on the disks of all executors.
    """
    out = tokens.withColumns({"cid": F.lit(None).cast("long"), "cell_score": F.lit(float("-inf"))})
    for ids, m in matrix_blocks(centroids):
        shared = tokens.sparkSession.sparkContext.broadcast((ids, m))
        if sent is not None:
            sent.append(shared)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, m = shared.value
            rows, single = max(1, SCORE_CELLS // len(ids)), m.astype(np.float32)
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column("emb"))
                at = np.concatenate([best_cells(x[lo : lo + rows], m, single) for lo in range(0, len(x), rows)])
                top = np.round((x * m[at]).sum(1), 12)
                old = b.column("cell_score").to_numpy(zero_copy_only=False)
                old_id = b.column("cid").to_numpy(zero_copy_only=False)
                new = top > old
                cid = np.where(new, ids[at], np.nan_to_num(old_id.astype(float), nan=-1).astype(np.int64))
                b = b.set_column(b.schema.get_field_index("cid"), b.schema.field("cid"), pa.array(cid))
                yield b.set_column(b.schema.get_field_index("cell_score"), b.schema.field("cell_score"), pa.array(np.where(new, top, old)))

        out = out.mapInArrow(best, out.schema)
    return out.drop("cell_score")


def assign_sql(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same as ``assign`` in built-in expressions: a nested loop over a small centroid table."""
    c = centroids.select("cid", F.col("emb").alias("c_emb"))
    keys = [x for x in tokens.columns if x != "emb"]
    best = tokens.crossJoin(c).groupBy(*keys, "emb").agg(F.max_by("cid", F.struct(F.round(V.dot("emb", "c_emb"), 12), -F.col("cid"))).alias("cid"))
    return best.select(*keys, "emb", "cid")


def _lists(m: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def residuals(assigned: DataFrame, centroids: DataFrame, sent: list[Broadcast] | None = None) -> DataFrame:
    """assigned with ``res``, the token less its centroid.  sent: as for ``assign``."""
    out = assigned.withColumn("res", F.array().cast("array<double>"))
    for ids, m in matrix_blocks(centroids):
        shared = assigned.sparkSession.sparkContext.broadcast((ids, m))
        if sent is not None:
            sent.append(shared)

        def less(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                cid, column = b.column("cid").to_numpy(), b.schema.get_field_index("res")
                at = np.minimum(np.searchsorted(ids, cid), len(ids) - 1)
                here = ids[at] == cid
                res = _matrix(b.column("emb"))
                res[here] -= m[at[here]]
                if len(b.column("res").flatten()):
                    res[~here] = _matrix(b.column("res"))[~here]
                yield b.set_column(column, b.schema.field(column), _lists(res))

        out = out.mapInArrow(less, out.schema)
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; zeros are one, NaN is the largest."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _number(key: int) -> float:
    key = np.int64(key)
    return float((key ^ ((key >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64))


def _counts(res: DataFrame, shift: int, within: tuple[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, float]:
    """How many components share the bits above ``shift``, of those whose bits above another place are among the given, in order; and the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        size = 0.0
        for b in batches:
            x = b.column("res").flatten().drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
            key = _ordered(x)
            if within is None:
                size += float(np.abs(x).sum())
            else:
                above = key >> np.int64(within[0])
                at = np.minimum(np.searchsorted(within[1], above), len(within[1]) - 1)
                key = key[within[1][at] == above]
            for k, n in zip(*(v.tolist() for v in np.unique(key >> np.int64(shift), return_counts=True)), strict=True):
                held[k] = held.get(k, 0) + n
        keys = [*held, 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*held.values(), 0], pa.int64()), pa.array([0.0] * len(held) + [size])], ["key", "n", "size"])

    found = res.mapInArrow(run, "key long, n long, size double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).orderBy("key").toArrow()
    n = found.column("n").to_numpy()
    return found.column("key").to_numpy()[n > 0], n[n > 0], float(np.sum(found.column("size").to_numpy()))


def order_statistics(res: DataFrame, ranks: Callable[[int], list[int]]) -> tuple[dict[int, float], int, float]:
    """The components of the given ranks from 0, their number and the sum of their sizes.

    Components are counted by their highest 16 bits, and those in a bucket that holds a rank again by 10 bits more,
    until few are left; so tasks hold counts alone, and nothing is sorted or gathered in one.
    """
    shift = 48
    keys, n, size = _counts(res, shift, None)
    total, asked = int(n.sum()), {}
    before = np.r_[0, np.cumsum(n)]
    for r in ranks(total) if total else []:
        i = int(np.searchsorted(before, r, "right")) - 1
        asked[r] = (int(keys[i]), r - int(before[i]), int(n[i]))
    while shift and asked:
        chosen = np.array(sorted({k for k, _, _ in asked.values()}), np.int64)
        left = sum({k: held for k, _, held in asked.values()}.values())
        above, shift = shift, 0 if left <= FEW_VALUES else max(0, shift - 10)
        keys, n, _ = _counts(res, shift, (above, chosen))
        own, before = keys >> (above - shift), np.r_[0, np.cumsum(n)]
        first = dict(zip(chosen.tolist(), np.searchsorted(own, chosen).tolist(), strict=True))
        for r, (k, place, _) in asked.items():
            i = int(np.searchsorted(before, before[first[k]] + place, "right")) - 1
            asked[r] = (int(keys[i]), int(before[first[k]] + place - before[i]), int(n[i]))
    return {r: _number(k) for r, (k, _, _) in asked.items()}, total, size


def train_codec(res: DataFrame, nbits: int) -> DataFrame:
    """One row: cutoffs and weights are quantiles of all components pooled, exact, between two by their distance; avg_residual is their mean size."""
    n = 2**nbits
    shares = [i / n for i in range(1, n)] + [(i + 0.5) / n for i in range(n)]
    own = res.select("res").persist(StorageLevel.MEMORY_AND_DISK)
    found, total, size = order_statistics(own, lambda total: sorted({f(p * (total - 1)) for p in shares for f in (math.floor, math.ceil)}))
    own.unpersist()

    def quantile(p: float) -> float:
        at = p * (total - 1)
        low, high = math.floor(at), math.ceil(at)
        return found[low] if found[low] == found[high] else (high - at) * found[low] + (at - low) * found[high]

    values = [quantile(p) for p in shares] if total else None
    row = (nbits, values and values[: n - 1], values and values[n - 1 :], size / total if total else None)
    return res.sparkSession.createDataFrame([row], "nbits int, cutoffs array<double>, weights array<double>, avg_residual double")


def codec_values(codec: DataFrame) -> tuple[int, list[float], list[float]]:
    r = codec.first()
    return r["nbits"], list(r["cutoffs"] or []), list(r["weights"] or [])


def _array(x: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")


def compress(res: DataFrame, codec: DataFrame) -> DataFrame:
    """res with ``codes``, a bucket number per dimension: the number of cutoffs strictly below."""
    cutoffs = np.array(codec_values(codec)[1], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = np.searchsorted(cutoffs, _matrix(b.column("res")), "left").astype(np.int8)
                own = b.drop_columns([x for x in ("res", "emb") if x in b.schema.names])
                yield pa.RecordBatch.from_arrays([*own.columns, _lists(codes)], [*own.schema.names, "codes"])

    return res.mapInArrow(run, T.StructType([x for x in res.schema if x.name not in ("res", "emb")] + [T.StructField("codes", T.ArrayType(T.ByteType()))]))


def _bytes(codes: np.ndarray) -> pa.Array:
    """Codes of up to 4 bits, two in a byte, the first in its high half."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return pa.array([x.tobytes() for x in codes[:, ::2] << 4 | codes[:, 1::2]], pa.binary())


def coded(tokens: DataFrame, centroids: DataFrame, codec: DataFrame, packed: bool = False) -> DataFrame:
    """compress of residuals of assign, in one pass of the tasks where the centroids are one block.  packed: codes are bytes, two in one."""
    found = list(itertools.islice(matrix_blocks(centroids), 2))
    kinds = T.StructType([x for x in tokens.schema if x.name != "emb"] + [T.StructField("cid", T.LongType()), T.StructField("codes", T.BinaryType() if packed else T.ArrayType(T.ByteType()))])
    if len(found) != 1:
        own = compress(residuals(assign(tokens, centroids), centroids), codec)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = b.schema.get_field_index("codes")
                    yield b.set_column(at, "codes", _bytes(_matrix(b.column("codes"))))

        return own.mapInArrow(pack, kinds) if packed else own
    shared = tokens.sparkSession.sparkContext.broadcast((*found[0], np.array(codec_values(codec)[1], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, cutoffs = shared.value
        rows, single = max(1, SCORE_CELLS // len(ids)), m.astype(np.float32)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("emb"))
                at = np.concatenate([best_cells(x[lo : lo + rows], m, single) for lo in range(0, len(x), rows)])
                codes = np.searchsorted(cutoffs, x - m[at], "left").astype(np.int8)
                own = b.drop_columns(["emb"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids[at]), _bytes(codes) if packed else _lists(codes)], [*own.schema.names, "cid", "codes"])

    return tokens.mapInArrow(run, kinds)


def decompress(index: DataFrame, centroids: DataFrame, codec: DataFrame) -> DataFrame:
    """index with ``emb``: centroid plus weights, as a unit vector."""
    _, _, weights = codec_values(codec)
    c = centroids.select("cid", F.col("emb").alias("c_emb"))
    return index.join(c, "cid").withColumn("emb", V.l2_normalize(V.add("c_emb", V.weights_of("codes", _array(weights))))).drop("c_emb")


def cell_sizes(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, n), with 0 for empty cells."""
    n = index.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return centroids.select("cid").join(n, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


def ivf(index: DataFrame) -> DataFrame:
    return index.select("cid", "pid").distinct()


def token_offsets(lengths: DataFrame) -> DataFrame:
    """(pid, length) to (pid, offset): tokens of all passages before it, by ascending pid.

    Sums of runs of passages are added up in one small window, places within a run in windows of their own.
    """
    run = F.floor(F.col("pid") / OFFSET_RUN).alias("run")
    sums = lengths.groupBy(run).agg(F.sum("length").alias("n"))
    before = sums.select("run", (F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    w = Window.partitionBy("run").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    own = lengths.select("pid", "length", run).withColumn("within", F.sum("length").over(w) - F.col("length"))
    return own.join(before, "run").select("pid", (F.col("before") + F.col("within")).alias("offset"))


def ivf_tokens(index: DataFrame, lengths: DataFrame) -> DataFrame:
    """(cid, eid): the tokens of each cell, numbered through all passages."""
    return index.join(token_offsets(lengths), "pid").select("cid", (F.col("offset") + F.col("pos")).alias("eid"))


def mean_length(lengths: DataFrame) -> DataFrame:
    """One row: passages, tokens, and tokens by passage."""
    return lengths.agg(F.count(F.lit(1)).alias("passages"), F.sum("length").alias("tokens"), F.avg("length").alias("mean"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("pid").agg(F.count(F.lit(1)).alias("length"))


def chunk_plan(passages: DataFrame, size: int) -> DataFrame:
    """(chunk, passage_offset, passages, token_offset, tokens) for dense pids and their lengths."""
    c = passages.groupBy(F.floor(F.col("pid") / size).alias("chunk")).agg(F.min("pid").alias("passage_offset"), F.count(F.lit(1)).alias("passages"), F.sum("length").alias("tokens"))
    return c.withColumn("token_offset", F.sum("tokens").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))


SUMS = "block long, n binary, total binary"


def _sums(assigned: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, their numbers of tokens and the sums of these, added up in the tasks before anything is shuffled, then by blocks of ``SUM_CELLS`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cid, weight = _matrix(b.column("emb")), b.column("cid").to_numpy(), b.column("weight").to_numpy()
            order = np.argsort(cid, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(cid[order]) > 0])
            own, n, total = cid[order][first], np.add.reduceat(weight[order], first), np.add.reduceat((x * weight[:, None])[order], first)
            for block in np.unique(own // SUM_CELLS).tolist():
                at = own // SUM_CELLS == block
                if block not in held:
                    held[block] = np.zeros(SUM_CELLS, np.int64), np.zeros((SUM_CELLS, dim))
                held[block][0][own[at] % SUM_CELLS] += n[at]
                held[block][1][own[at] % SUM_CELLS] += total[at]
        for block, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["block", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
        total = sum(np.frombuffer(x, np.float64) for x in table.column("total").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary())})

    parts = assigned.select("cid", "emb", "weight").mapInArrow(run, SUMS)
    tasks = parts.rdd.getNumPartitions()
    if tasks > 64:
        # In two steps, so that no more than some dozens of a block meet at once.
        parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))).groupBy("block", "salt").applyInArrow(lambda t: add(t), SUMS)
    found = parts.groupBy("block").applyInArrow(lambda t: add(t), SUMS).toArrow().to_pylist()
    n = np.concatenate([np.frombuffer(x["n"], np.int64) for x in found]) if found else np.zeros(0, np.int64)
    total = np.concatenate([np.frombuffer(x["total"], np.float64) for x in found]).reshape(-1, dim) if found else np.zeros((0, dim))
    cid = np.concatenate([x["block"] * SUM_CELLS + np.arange(SUM_CELLS) for x in found]) if found else n
    return cid[n > 0], n[n > 0], total[n > 0]


def _centroid_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"cid": pa.array(np.arange(len(m))), "emb": _lists(m)}))


def kmeans(tokens: DataFrame, cells: int, iterations: int = 4, seed: int = 123) -> DataFrame:
    """Spherical k-means by Lloyd's steps; an emptied cell keeps its centroid.  A column ``weight`` says how many tokens a row stands for."""
    weight = F.col("weight") if "weight" in tokens.columns else F.lit(1).cast("long").alias("weight")
    start = tokens.orderBy(F.xxhash64("pid", "pos", F.lit(seed)), "pid", "pos").limit(cells).select("emb").toArrow()
    m = _matrix(start.column("emb").combine_chunks())
    for _ in range(iterations):
        sent: list[Broadcast] = []
        cid, n, total = _sums(assign(tokens.select("pid", "pos", "emb", weight), _centroid_frame(tokens.sparkSession, m), sent), m.shape[1])
        for x in sent:
            x.destroy()
        m = m.copy()
        m[cid] = total / n[:, None]
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return _centroid_frame(tokens.sparkSession, m)


class Index:
    """The tables of an index, built in memory or read from a folder."""

    def __init__(self, centroids: DataFrame, codec: DataFrame, index: DataFrame, cells: DataFrame, meta: dict) -> None:
        self.centroids, self.codec, self.index, self.cells, self.meta = centroids, codec, index, cells, meta

    @classmethod
    def build(cls, tokens: DataFrame, nbits: int = 4, centroids: DataFrame | None = None, cells: int | None = None, iterations: int = 4, seed: int = 123, heldout: bool | None = None, codec: DataFrame | None = None) -> Index:
        """heldout: whether the codec is trained on held-out tokens alone; by default where the cells are trained too, unless there are few tokens."""
        passages, n = tokens.agg(F.count_distinct("pid"), F.count(F.lit(1))).first()
        heldout = n >= HELDOUT_FROM and centroids is None if heldout is None else heldout
        if centroids is None:
            sample = tokens.join(sample_pids(tokens, sample_size(passages), seed), "pid", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
            cells = cells or min(number_of_cells(passages, n / max(1, passages)), n)
            centroids = kmeans(sample, cells, iterations, seed)
            sample.unpersist()
        if codec is None:
            own = split_heldout(tokens, seed=seed, n=n).where("heldout").drop("heldout") if heldout else tokens
            codec = train_codec(residuals(assign(own, centroids), centroids), nbits)
        values = codec_values(codec)
        codec = tokens.sparkSession.createDataFrame([(values[0], values[1], values[2])], "nbits int, cutoffs array<double>, weights array<double>")
        # Cells and search both read it; what memory cannot hold goes to disk, what is lost is built again.
        index = coded(tokens, centroids, codec).select("cid", "pid", "pos", "codes").persist(StorageLevel.MEMORY_AND_DISK)
        return cls(centroids, codec, index, cell_sizes(index, centroids), {"num_passages": passages, "num_embeddings": n, "avg_doclen": n / max(1, passages), "nbits": nbits})

    def write(self, path: str, mode: str = "errorifexists", keep: bool = False) -> Index:
        """Parquet, the inverted table clustered and sorted by cell so that row groups prune; meta last, as the mark of success.

        ``keep``: centroids and codec stay where they are complete.
        """
        spark = self.index.sparkSession
        for name, table in (("centroids", self.centroids), ("codec", self.codec)):
            if not (keep and _done(spark, f"{path}/{name}")):
                table.write.mode(mode).parquet(f"{path}/{name}")
        packed = self.index.withColumn("residual", V.pack("codes", self.meta["nbits"])).drop("codes")
        packed.repartitionByRange("cid").sortWithinPartitions("cid", "pid", "pos").write.mode(mode).parquet(f"{path}/index")
        self.cells.write.mode(mode).parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        dim = spark.read.parquet(f"{path}/centroids").select(F.size("emb")).first()[0]
        index = spark.read.parquet(f"{path}/index").withColumn("codes", unpack("residual", meta["nbits"], dim)).drop("residual")
        return cls(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/codec"), index, spark.read.parquet(f"{path}/cells"), meta)

    def add(self, tokens: DataFrame) -> DataFrame:
        """Index rows of more tokens, under the centroids and codec there are."""
        return coded(tokens, self.centroids, self.codec).select("cid", "pid", "pos", "codes")

    def extended(self, rows: DataFrame) -> Index:
        """With more rows, as ``add`` makes them and a stream writes them; its cells count them."""
        more = rows.groupBy("cid").agg(F.count(F.lit(1)).alias("more"))
        cells = self.cells.join(more, "cid", "left").select("cid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        passages, n = rows.agg(F.count_distinct("pid"), F.count(F.lit(1))).first()
        total = {"num_passages": self.meta["num_passages"] + passages, "num_embeddings": self.meta["num_embeddings"] + n}
        meta = self.meta | total | {"avg_doclen": total["num_embeddings"] / max(1, total["num_passages"])}
        return Index(self.centroids, self.codec, self.index.unionByName(rows.select("cid", "pid", "pos", "codes")), cells, meta)

    def t_prime(self, k: int, given: int | None = None) -> int:
        return t_prime_for(self.meta["num_embeddings"], self.cells.count(), k, given)


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def build_index(tokens: DataFrame, path: str, overwrite: bool | str = False, **options) -> Index:  # noqa: ANN003
    """Build an index in a folder.

    overwrite: False refuses a folder that has an index; True builds it anew;
    "reuse" returns a complete index as it is; "resume" keeps the tables that an
    interrupted build completed, centroids and codec foremost, and makes the rest.
    """
    spark = tokens.sparkSession
    if overwrite == "reuse" and _done(spark, f"{path}/meta"):
        return verified(Index.read(spark, path))
    if overwrite is False and (_done(spark, f"{path}/meta") or _done(spark, f"{path}/centroids")):
        raise FileExistsError(path)
    if overwrite == "resume" and _done(spark, f"{path}/meta"):
        return verified(Index.read(spark, path))
    if overwrite == "resume" and _done(spark, f"{path}/centroids"):
        options |= {"centroids": spark.read.parquet(f"{path}/centroids")}
        if _done(spark, f"{path}/codec"):
            options |= {"codec": spark.read.parquet(f"{path}/codec")}
        return verified(Index.build(tokens, **options).write(path, "overwrite", keep=True))
    return verified(Index.build(tokens, **options).write(path, "overwrite"))


def verified(index: Index) -> Index:
    """The index, if its tables agree with each other."""
    held, counted = index.index.count(), index.cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not held == counted == index.meta["num_embeddings"]:
        raise ValueError(f"the index holds {held} tokens, its cells {counted}, its plan {index.meta['num_embeddings']}")
    return index


def unpack(column: str, nbits: int, dim: int) -> Column:
    """Codes of a packed residual, first dimension in the highest bits."""
    digits = F.hex(column)
    per = 4 // nbits
    digit = lambda i: F.conv(F.substring(digits, (i / per).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.floor(digit(i) / F.pow(F.lit(2), F.lit(nbits) * (per - 1 - i % per))) % 2**nbits).cast("tinyint"))


def index_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files of an index."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def statistics(cells: DataFrame) -> DataFrame:
    """Cells, embeddings and the lower median of the cell sizes."""
    return cells.agg(F.count(F.lit(1)).alias("centroids"), F.sum("n").alias("embeddings"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("median_size"))
