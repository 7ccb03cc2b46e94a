"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct 5-word shingles, as 64-bit hashes.  Two
documents link when their sets' Jaccard similarity is at least 4/5.

1. Documents with one set form a class; the rest works on classes, so exact
   copies cost one map-side sum.
2. Tokens are ordered by hash.  A set of n tokens overlaps with any partner in
   at least t = ceil(4n/5) of them, so in the prefix of length n - t + k both
   share k tokens: prefixes are extended to k = ``COMBINE`` (or t, if smaller).
3. Tokens that one class alone has in its prefix drop out, and with them every
   class that keeps fewer tokens than any partner would have to share.
4. Rare tokens (at most ``RARE`` classes) are indexed singly.  Pairs that meet
   there stay if rare meetings plus possible frequent ones can reach k.
   A pair without rare meetings must share k frequent tokens; classes with that
   many are indexed by combinations of two among the rarest m - k + 2 of them,
   or, where the combinations would be too many, by single tokens.  Whoever
   meets there is joined to the key's smallest class, not to all others.
5. Boilerplate can chain many classes into one candidate group.  A group of more
   than a block is taken apart by its whole sets: a class whose tokens that others
   of such groups have too are fewer than any partner shares drops out, and the
   rest is joined again by the rarest tokens, of which partners share one.
6. Connected candidates are verified on whole sets, by intersection counts in
   blocks of ``BLOCK`` classes, or fewer with ``BLOCK_TOKENS`` tokens; a large
   candidate group becomes many block pairs.
   Only sums and spanning links leave a block, so no list of pairs within a
   group is ever made, and nothing is capped.

Results are one row per document: links are counted for every other document,
copies included.

Cases: very long texts need memory in proportion to one text; a pair at exactly
4/5 links; null or empty texts have an empty set and no links; fewer than five
words make one shingle; rows that repeat an id count as documents of their own
and a class is named by its smallest id; null ids come last in that; an empty
table gives an empty result; extra columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .graph import components
from .shared import materialize

SHINGLE = 5
COMBINE, RARE, COMBINATIONS, BLOCK = 16, 16, 2_000, 1_024
#: Tokens of a block, at most, unless one class alone has more.
BLOCK_TOKENS = 1 << 20
#: Small groups share a verification task, about this many classes and tokens in each.
TASK, TASK_TOKENS = 1_024, 1 << 19
#: Bytes of text that are hashed at once, unless one text is longer.
SLICE = 1 << 19
#: Index keys in a batch, about, and shared tokens that are multiplied at once.
KEY_TOKENS, WIDE = 1 << 17, 1_024
FILTER_BITS = 1 << 24
_SALT = np.uint64(0x5851F42D4C957F2D)


def least_overlap(n):  # noqa: ANN001, ANN201
    """ceil(4 n / 5), for ints, arrays and columns alike."""
    return F.floor((4 * n + 4) / 5).cast("long") if isinstance(n, Column) else (4 * n + 4) // 5


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offs = bk.flat(column)
    buf = bk.LOWER[buf]
    s, e, first = bk.spans(buf, offs, bk.NOT_SPACE)
    words = bk.hash_spans(buf, s, e)
    windows = {m: bk.hash_windows(words, m) for m in range(1, SHINGLE + 1)}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        m = min(SHINGLE, b - a)
        yield np.unique(windows[m][a : b - m + 1]) if m else np.zeros(0, np.uint64)


def class_of(tokens: np.ndarray) -> int:
    """64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(bk.mix(tokens ^ _SALT), dtype=np.uint64) + np.uint64(len(tokens))
        return int(bk.as_long(bk.mix(np.array([total], np.uint64)))[0])


def _lists(tokens: list[np.ndarray]) -> pa.ListArray:
    """One list of longs for each array of tokens."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bk.as_long(np.concatenate(tokens))))


def sets(docs: DataFrame) -> DataFrame:
    """cls, n, prefix, and all columns but the text: the extended prefix of each set, in hash order."""
    carried = [c for c in docs.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bk.slices(batch, limit=SLICE):
                cls, n, kept = [], [], []
                for tokens in shingle_sets(part.column("text")):
                    size = len(tokens)
                    t = least_overlap(size)
                    cls.append(class_of(tokens))
                    n.append(size)
                    kept.append(tokens[: size - t + min(COMBINE, t)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), _lists(kept)], [*carried, "cls", "n", "prefix"])

    return docs.mapInArrow(build, ", ".join(f"{c} long" for c in carried) + ", cls long, n long, prefix array<long>")


def _required(n: Column) -> Column:
    """Tokens that a set of n must share with any partner inside extended prefixes."""
    return F.least(F.lit(COMBINE).cast("long"), least_overlap(least_overlap(n)))


def _common(rows: DataFrame, name: str, required: Callable[[Column], Column] = _required) -> DataFrame:
    """(token, cls, n) to one row per class that can have a partner: cls, n, toks (c, token), c >= 2.

    Counts and join read one exchange: tokens are by far the most that this module shuffles.
    The counts name all columns, none of which is null, so that both sides plan the same one.
    """
    rows = rows.repartition("token")
    counts = rows.groupBy("token").agg(F.expr("count(cls, n)").alias("c")).where("c > 1")
    kept = rows.join(counts, "token").groupBy("cls").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("toks"))
    return materialize(kept.where(F.size("toks") >= required(F.col("n"))), name)


def _frequent_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys of classes by their frequent tokens (rarest first): kind 0 combinations, 1 single, 2 single and anchoring."""
    whose, keys, kinds, held = [], [], [], 0

    def portion() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(whose)), pa.array(bk.as_long(np.concatenate(keys))), pa.array(np.concatenate(kinds))], ["cls", "key", "kind"])

    for batch in batches:
        lists = batch.column("frequent")
        values, offsets = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        for at, (cls, need) in enumerate(zip(batch.column("cls").to_pylist(), batch.column("need").to_pylist(), strict=True)):
            tokens = values[offsets[at] : offsets[at + 1]]
            one = tokens[: len(tokens) - need + 1]
            p = len(tokens) - need + 2
            short = need >= 2 and p * (p - 1) // 2 <= COMBINATIONS
            keys.append(one)
            kinds.append(np.full(len(one), 1 if short else 2, np.int8))
            if short:
                i, j = np.triu_indices(p, 1)
                a, b = np.minimum(tokens[i], tokens[j]), np.maximum(tokens[i], tokens[j])
                keys.append(bk.mix(bk.mix(a) + b))
                kinds.append(np.zeros(len(i), np.int8))
            n = len(one) + (len(i) if short else 0)
            whose.append(np.full(n, cls, np.int64))
            held += n
            if held >= KEY_TOKENS:
                yield portion()
                whose, keys, kinds, held = [], [], [], 0
    if held:
        yield portion()


def candidates(prefixes: DataFrame) -> DataFrame:
    """(cls, n, prefix), a row per class, to edges (u, v) whose components hold every link."""
    rows = prefixes.select(F.explode("prefix").alias("token"), "cls", "n")
    few = _common(rows, "common-1")
    few = _common(few.select(F.explode("toks.token").alias("token"), "cls", "n"), "common-2")

    k = F.least(F.lit(COMBINE).cast("long"), least_overlap(F.col("n")))
    few = few.select("cls", "n", k.alias("k"), F.filter("toks", lambda x: x["c"] <= RARE)["token"].alias("rare"), F.filter("toks", lambda x: x["c"] > RARE)["token"].alias("frequent"))
    rare = few.select(F.explode("rare").alias("token"), "cls", "n", "k", F.size("frequent").alias("m"))
    a, b = rare.alias("a"), rare.alias("b")
    near = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cls") < F.col("b.cls")) & near).groupBy(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("met"), F.max(F.least("a.m", "b.m")).alias("more"), F.max(F.least("a.k", "b.k")).alias("k"))
    edges = pairs.where("met + more >= k").select("u", "v")

    many = few.withColumn("need", _required(F.col("n"))).where("size(frequent) >= need").select("cls", "need", "frequent")
    keys = materialize(many.mapInArrow(_frequent_keys, "cls long, key long, kind byte"), "frequent-keys")
    for own, anchor in (("kind = 0", "kind = 0"), ("kind > 0", "kind = 2")):
        least = keys.where(anchor).groupBy("key").agg(F.min("cls").alias("v"))
        edges = edges.unionAll(keys.where(own).join(least, "key").where("cls <> v").select(F.col("cls").alias("u"), "v").distinct())
    return edges


def _of_whole(n: Column) -> Column:
    """Tokens that a set of n must share with any partner, whose own share of it counts as well."""
    return least_overlap(n)


def _apart(whole: DataFrame) -> DataFrame:
    """(cls, n, tokens), whole sets of classes, to edges (u, v) whose components hold every link among them."""
    rows = whole.select(F.explode("tokens").alias("token"), "cls", "n")
    few = _common(rows, "whole-1", _of_whole)
    few = _common(few.select(F.explode("toks.token").alias("token"), "cls", "n"), "whole-2", _of_whole)
    spare = (F.size("toks") - _of_whole(F.col("n")) + 1).cast("int")
    keys = materialize(few.select("cls", F.explode(F.slice("toks.token", F.lit(1), spare)).alias("key")), "whole-keys")
    least = keys.groupBy("key").agg(F.min("cls").alias("v"))
    return keys.join(least, "key").where("cls <> v").select(F.col("cls").alias("u"), "v").distinct()


def _links(sizes: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which members link: a boolean matrix, true only between ``left`` and ``right`` members."""
    flat = np.concatenate(tokens)
    who = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(x) for x in tokens])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    column = (np.cumsum(count > 1) - 1).astype(np.int32)[at[shared]]
    who = who[shared]
    del flat, at, count, shared
    both = np.zeros((len(tokens), len(tokens)), np.float32)
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    wide = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, wide, WIDE):
        part = slice(*np.searchsorted(column, [lo, lo + WIDE]))
        m = np.zeros((len(tokens), min(WIDE, wide - lo)), np.float32)
        m[who[part], column[part] - lo] = 1
        both += m @ m.T
    # 100 both >= 80 (sums - both); the counts are whole numbers that single floats hold exactly.
    sums = (sizes[:, None] + sizes[None, :]).astype(np.int32)
    out = 9 * both.astype(np.int32) >= 4 * sums
    np.fill_diagonal(out, False)
    return out & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))


def _roots(links: np.ndarray) -> np.ndarray:
    """For each member, the first member of its component."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links)))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _verify(table: pa.Table) -> pa.Table:
    """All candidate groups of one bucket, or one pair of blocks: linked documents and a spanning link per class."""
    root, cls, copies, block, i, j = (table.column(c).to_numpy() for c in ("root", "cls", "copies", "block", "i", "j"))
    order = np.lexsort((cls, root))
    root, cls, copies, block, i, j = (x[order] for x in (root, cls, copies, block, i, j))
    own = []
    for chunk in table.column("tokens").chunks:
        buf, offs = bk.flat(chunk)
        own += [buf[a:b].view(np.uint64) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    tokens = [own[x] for x in order.tolist()]
    out = []
    cuts = np.flatnonzero(np.r_[True, root[1:] != root[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        links = _links(np.array([len(x) for x in tokens[a:b]]), tokens[a:b], block[a:b] == i[a:b], block[a:b] == j[a:b])
        any_ = links.any(axis=1)
        top = _roots(links)
        linked = links @ copies[a:b]
        out += zip(cls[a:b][any_].tolist(), linked[any_].tolist(), cls[a:b][top][any_].tolist(), strict=True)
    u, n, v = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"cls": pa.array(u, pa.int64()), "linked": pa.array(n, pa.int64()), "first": pa.array(v, pa.int64())})


def _whole_sets(docs: DataFrame, wanted: DataFrame, kind: str = "binary") -> DataFrame:
    """cls, tokens: the whole set, 8 bytes per token or as array<long>, of documents whose id is probably in ``wanted`` (column x).

    The test is a bitmap of ``FILTER_BITS`` bits, whatever the data: it lets some
    others through, never fewer, and spares a shuffle of the texts.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = wanted.select(bit("x").alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for part in bk.slices(batch, limit=SLICE):
                own = list(shingle_sets(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()) if kind == "binary" else _lists(own)], ["cls", "tokens"])

    return docs.select(bit("doc_id").alias("bit"), "text").mapInArrow(build, f"cls long, tokens {kind}")


def _blocks(members: DataFrame) -> DataFrame:
    """root, and the number of blocks of each candidate group."""
    return members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (doc_id, text and any longs), and (cls, n_similar, component_id, root) of the classes; root tells components apart."""
    own = materialize(sets(docs), "shingle-sets")
    some = own.where("n > 0")
    classes = some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    edges = candidates(some.groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    groups = components(edges)

    members = materialize(groups.join(classes, F.col("node") == F.col("cls")).select("cls", "root", "rep", "copies", "n"), "members")
    sizes = _blocks(members)
    if not sizes.where("blocks > 1").isEmpty():
        large = members.join(sizes.where("blocks > 1").select("root"), "root")
        whole = _whole_sets(docs, large.select(F.col("rep").alias("x")).distinct(), "array<long>").groupBy("cls").agg(F.first("tokens").alias("tokens"))
        parts = components(_apart(large.select("cls", "n").join(whole, "cls")))
        parts = parts.join(large.drop("root"), F.col("node") == F.col("cls")).select("cls", "root", "rep", "copies", "n")
        members = materialize(members.join(sizes.where("blocks = 1").select("root"), "root").select(parts.columns).unionAll(parts), "members")
        sizes = _blocks(members)
    reps = members.select(F.col("rep").alias("x")).distinct()
    whole = _whole_sets(docs, reps).groupBy("cls").agg(F.first("tokens").alias("tokens"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "root").withColumn("block", block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    placed = placed.select("cls", "root", "copies", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    count, total = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_small = max(1, count // TASK, total // TASK_TOKENS)
    bucket = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(n_small)))
    tasks = placed.withColumn("bucket", bucket).join(whole, "cls").drop("blocks")
    schema = "cls long, linked long, first long"
    found = materialize(tasks.groupBy("bucket", "i", "j").applyInArrow(lambda t: _verify(t), schema), "links")

    linked = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    if sizes.where("blocks > 1").isEmpty():
        top = found.select(F.col("cls").alias("node"), F.col("first").alias("root"))
    else:
        top = components(found.select(F.col("cls").alias("u"), F.col("first").alias("v")))
    named = top.join(classes, F.col("node") == F.col("cls")).select("node", "root", "rep")
    names = named.groupBy("root").agg(F.min("rep").alias("name"))
    place = named.join(names, "root").select(F.col("node").alias("cls"), "name", "root")
    return own, classes.join(linked, "cls", "left").join(place, "cls", "left").select("cls", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.coalesce("name", "rep").alias("component_id"), F.coalesce("root", "cls").alias("root"))


def similar(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id."""
    own, info = _grouped(docs.select("doc_id", "text"))
    info = info.drop("root")
    out = own.select("doc_id", "cls", "n").join(info, "cls", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, 0).otherwise(F.col("n_similar")).cast("long").alias("n_similar"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _numbered(docs: DataFrame) -> DataFrame:
    """rid, and ``row`` with all columns.  A row is named by its place in its file, so that each reading gives the same names."""
    meta = None
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
    if meta is None or "row_index" not in docs.select(meta.alias("m")).schema["m"].dataType.names:
        docs = materialize(docs, "rows")
        meta = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(meta["file_path"], meta["row_index"]).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar ones, with the columns it came with.

    It is the row of smallest id (null ids last), then of smallest text hash,
    then of smallest row name; rows that share an id are rows of their own.
    """
    rows = _numbered(docs)
    own, info = _grouped(rows.select("rid", "row.doc_id", F.xxhash64("row.text").alias("text_hash"), "row.text"))
    placed = own.where("n > 0").join(info.select("cls", "root"), "cls").select("rid", "root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rid").alias("place"))
    placed = materialize(placed, "placed")
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    drop = placed.join(first, "root").where("rid <> first.rid").select(F.col("rid").alias("gone"))
    return rows.join(drop, F.col("rid") == F.col("gone"), "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.c, 0) AS BIGINT) AS n_similar, coalesce(q.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) k ON k.a = w.doc_id
LEFT JOIN (SELECT a, min(root) AS c FROM r GROUP BY a) q ON q.a = w.doc_id
"""
