r"""Language-model scoring with Brown class-based bigrams.

Words are split at ASCII white space, A-Z lower-cased; every text ends with one
end token.  A word's probability is that of its class after the last class,
times that of the word within its class.

* Every word seen ``MIN_COUNT`` times in training has a class of its own choice.
  Words seen less often, and unseen ones, share that of their group, one of
  ``TAILS`` by a hash of their last three bytes.
* The number of classes grows with the root of the number of such words.
* Clustering by exchange sweeps over the whole training corpus: a pass counts,
  for every item, the classes before and after it; then items move to the class
  under which these counts are likeliest, half of the items a sweep, so that
  moves made at once do not chase each other, until hardly any token moves.
  Items are the frequent words, which fit a dense table of ``HEAD_CELLS`` counts,
  and the groups, standing for all others.
* One more exchange gives all other words their classes: each occurrence sends
  the classes around it to its word, wherever that is kept, and words choose.
* Within a class a word has its relative frequency; within a group a word has
  (c + 1) / (n + V + 1), the last 1 for the unknown; transitions are smoothed by
  ``ALPHA``.

What is broadcast is bounded by construction: items, their classes, transitions,
and the counts of words making up at least 1 / ``KNOWN_SHARE`` of the tokens.  All
other words and their classes are a distributed table, joined with the (document,
word) pairs that ask for them.  Words are told apart by 64-bit hashes.

Cases: a null or empty text is its end token alone; a very long text takes memory
in proportion to its length; a null id hashes as the empty text, which puts it
into training; rows that repeat are scored alike and count as often as they
occur; of classes that suit a word alike it takes the first; without training
documents all counts are 0; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .shared import materialize

MIN_COUNT = 5
#: At most so many words are items, fewer where classes are many; a share, so that ties are treated alike.
ITEM_SHARE, HEAD_CELLS, KNOWN_SHARE = 60_000, 1 << 22, 1_000_000
TAILS, SWEEPS, ALPHA = 512, 10, 0.5
#: Sweeps end when two in a row move less than this share of the tokens.
STILL = 0.005
LEAST_CLASSES, MOST_CLASSES = 16, 1024
#: What is found of a word in a document is one whole number: its place among the document's rare words, its class + 1, its count.
COUNT_BITS, CLASS_BITS = 25, 11
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0xE0D)
BLOCK_BYTES = 1 << 20
#: Bytes of sequences that are worked on at once.
SEQUENCE_BYTES = 1 << 20
#: Occurrences that a task merges before they travel, and bytes of them that a bucket is meant to hold.
FLUSH, BUCKET_BYTES = 1_000_000, 32 << 20


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def is_known(n: int) -> Column:
    """Whether a word with ``c`` of ``n`` occurrences is broadcast."""
    return (F.col("c") * KNOWN_SHARE >= n) | (F.col("c") >= 1 << COUNT_BITS)


def number_of_classes(words: int) -> int:
    """A power of two near a quarter of the root of the number of words; the table of transitions stays within 8 MB."""
    return min(MOST_CLASSES, max(LEAST_CLASSES, 2 ** int(math.log2(max(1.0, math.sqrt(words) / 4)))))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail groups of all tokens, an end after each text; and where texts begin."""
    buf, offs = bk.flat(column)
    buf = bk.LOWER[buf]
    s, e, first = bk.spans(buf, offs, bk.NOT_SPACE)
    words = bk.hash_spans(buf, s, e)
    tails = (bk.hash_spans(buf, np.maximum(s, e - 3), e, 1) % np.uint64(TAILS)).astype(np.int16)
    return np.insert(words, first[1:], END), np.insert(tails, first[1:], -1), first + np.arange(len(first))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, tail, c) over all texts; counts are merged in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merge() -> tuple[np.ndarray, ...]:
            h, tail, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, tail[at], np.bincount(inverse, c).astype(np.int64)

        for batch in batches:
            for part in bk.slices(batch):
                h, tail, _ = _tokens(part.column("text"))
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, tail[at], c))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    held[:] = [merge()]
                    if len(held[0][0]) > 700_000:
                        yield emit(held.pop())
        if held:
            yield emit(merge())

    def emit(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bk.as_long(x[0])), pa.array(x[1]), pa.array(x[2])], ["h", "tail", "c"])

    return docs.select("text").mapInArrow(count, "h long, tail short, c long").groupBy("h").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


class Vocabulary:
    """What is known of frequent words, and sums over the rarest; bounded whatever the corpus.

    Items are numbered: 0 the end, then ``words``, then the tail groups.
    """

    def __init__(self, counts: DataFrame) -> None:
        often = F.col("c") >= MIN_COUNT
        n, v, many = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(often, 1))).first()
        self.n, self.v, self.classes = int(n), int(v), number_of_classes(many)
        share = min(ITEM_SHARE, HEAD_CELLS // self.classes)
        known = counts.where(is_known(self.n) | (F.col("h") == int(END))).select("h", "c").toArrow()
        h, c = known.column("h").to_numpy().view(np.uint64), known.column("c").to_numpy()
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        frequent = np.flatnonzero((self.c * share >= self.n) & (self.c >= MIN_COUNT) & (self.h != END))
        self.words = len(frequent)
        self.item = np.full(len(h), -1, np.int32)
        self.item[frequent] = 1 + np.arange(self.words)
        self.item[self.h == END] = 0
        self.items = 1 + self.words + TAILS
        #: For each item its count; for a group that of the words seen too rarely for a class, and their number; occurrences: of all its words.
        self.weight, self.tail_v = np.zeros(self.items), np.zeros(TAILS)
        self.weight[0] = self.c[self.h == END].sum()
        self.weight[1 : 1 + self.words] = self.c[frequent]
        self.occurrences = np.zeros(self.items)
        self.occurrences[: 1 + self.words] = self.weight[: 1 + self.words]
        other = counts.where(((F.col("c") * share < self.n) | ~often) & (F.col("h") != int(END)))
        rest = other.groupBy("tail").agg(F.sum("c").alias("all"), F.coalesce(F.sum(F.when(~often, F.col("c"))), F.lit(0)).alias("n"), F.count(F.when(~often, 1)).alias("v")).toArrow()
        at = rest.column("tail").to_numpy()
        self.occurrences[1 + self.words + at] = rest.column("all").to_numpy()
        self.weight[1 + self.words + at], self.tail_v[at] = rest.column("n").to_numpy(), rest.column("v").to_numpy()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the known (-1: not there) and item (-1: by tail) of words."""
        if not len(self.h):
            return np.full(len(h), -1), np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, at, -1), np.where(hit, self.item[at], -1)


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, seq binary, more binary, rare array<long>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row per document: its items, what else its tokens are, sums over known words, and the words to look up.

    logs: sum of log10(c + 1) over known words; more: for each token that is a
    group's item, in order, its place among the known, or -1 less its place in rare.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        counts = np.append(vocab.c, 0)
        for batch in batches:
            for part in bk.slices(batch):
                h, tail, first = _tokens(part.column("text"))
                at, inverse = bk.distinct(h)
                place, item = (x[inverse] for x in vocab.find(h[at]))
                c = counts[place]
                item = np.where((h == END) & (tail < 0), 0, item)
                by_tail = item < 0
                item = np.where(by_tail, 1 + vocab.words + tail, item).astype(np.uint16)
                doc = bk.owner(first)
                unknown = np.flatnonzero(place < 0)
                order = np.lexsort((h[unknown], doc[unknown]))
                d, w = doc[unknown][order], h[unknown][order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
                begin = np.searchsorted(d[new], np.arange(len(first)))
                more = place.astype(np.int32)
                more[unknown[order]] = -1 - (np.cumsum(new) - 1 - begin[d])
                cut = np.concatenate([[0], np.cumsum(by_tail)])[first]
                more = more[by_tail]
                total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731
                pieces = lambda x, cuts: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(total((c > 0).astype(np.int64))), pa.array(total(np.log10(c + 1.0))),
                        pieces(item, first), pieces(more, cut), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bk.as_long(w[new]))),
                    ],
                    [x.split()[0] for x in ENCODED.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, ENCODED)


def _sequences(batch: pa.RecordBatch, kind: type = np.uint16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (or classes) of a batch of documents, the one before each (the end, at first), and where documents begin."""
    buf, offs = bk.flat(batch.column("seq"))
    item, first = buf.view(kind).astype(np.int64), offs // np.dtype(kind).itemsize
    before = np.empty_like(item)
    before[1:] = item[:-1]
    before[first[:-1]] = 0
    return item, before, first


def _totals(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of (block, counts) rows, an array of whole numbers; many tasks' rows are added up in two steps."""
    kind = "block int, counts binary"

    def total(table: pa.Table) -> pa.Table:
        out = None
        for x in table.column("counts").to_pylist():
            a = np.frombuffer(x, np.int64)
            out = a if out is None else out + a
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    # A task sends few rows; more than some dozens of a block never meet at once.
    tasks = parts.rdd.getNumPartitions()
    if tasks > 64:
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks))))
        parts = salted.groupBy("block", "salt").applyInArrow(lambda t: total(t), kind)
    out, size = np.zeros(math.prod(shape), np.int64), BLOCK_BYTES // 8
    found = parts.groupBy("block").applyInArrow(lambda t: total(t), kind).toArrow()
    for b, x in zip(found.column("block").to_pylist(), found.column("counts").to_pylist(), strict=True):
        part = np.frombuffer(x, np.int64)
        out[b * size : b * size + len(part)] = part
    return out.reshape(shape)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat, size = counts.ravel(), BLOCK_BYTES // 8
    for b, lo in enumerate(range(0, len(flat), size)):
        if flat[lo : lo + size].any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([flat[lo : lo + size].tobytes()], pa.binary())], ["block", "counts"])


def neighbours(encoded: DataFrame, classes: np.ndarray, items: int, k: int) -> np.ndarray:
    """Counts [item, 0: class before, 1: class after] over all training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(items * 2 * k, np.int64)
        held, size = [], 0
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                item, before, _ = _sequences(part)
                held += [item * (2 * k) + classes[before], before * (2 * k) + k + classes[item]]
                size += 2 * len(item)
                if size > items * k // 2:
                    both += np.bincount(np.concatenate(held), minlength=len(both))
                    held, size = [], 0
        if held:
            both += np.bincount(np.concatenate(held), minlength=len(both))
        yield from _blocks(both)

    return _totals(encoded.where(~F.col("held_out")).select("seq").mapInArrow(count, "block int, counts binary"), (items, 2, k))


def _transitions(both: np.ndarray, classes: np.ndarray) -> np.ndarray:
    k = both.shape[2]
    out = np.zeros((k, k))
    np.add.at(out, classes, both[:, 1])
    return out


def affinity(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of a class by the class before it [before, class] and by the one after it [after, class].

    P(neighbours | class): after it by row, before it by column, less the class's own size.  Class 0 is the end's.
    """
    t = t + ALPHA
    step = np.log(t / t.sum(1, keepdims=True))
    before, after = step - np.log(t.sum(0))[None, :], step.T.copy()
    before[:, 0] = after[:, 0] = -1e9
    return before, after


def exchange(both: np.ndarray, classes: np.ndarray, sweep: int) -> np.ndarray:
    """Move every other item to its likeliest class; the end keeps class 0 to itself."""
    before, after = affinity(_transitions(both, classes))
    best = (both[:, 0] @ before + both[:, 1] @ after).argmax(1)
    turn = (np.arange(len(classes)) * 7 + sweep) % 2 == 0
    # Without neighbours, as without training documents, an item stays.
    new = np.where(turn & both.any((1, 2)), best, classes)
    new[0] = 0
    return new


def cluster(encoded: DataFrame, vocabulary: Vocabulary, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item, and the class transition counts of the training corpus under them."""
    k = vocabulary.classes
    weight = vocabulary.occurrences
    order = np.argsort(np.argsort(-weight, kind="stable"))
    classes, moved = 1 + order % (k - 1), 1.0
    classes[0] = 0
    for sweep in range(sweeps):
        both = neighbours(encoded, classes, vocabulary.items, k)
        new = exchange(both, classes, sweep)
        last, moved = moved, weight[new != classes].sum() / max(1, weight.sum())
        classes = new
        if max(last, moved) < STILL:
            break
    return classes, _transitions(neighbours(encoded, classes, vocabulary.items, k), classes)


LEXICON = "h long, cls int, c long"


def lexicon(encoded: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, t: np.ndarray) -> DataFrame:
    """(h, cls, c) of all training words that are no items: the class they choose (-1: seen too rarely) and their count."""
    k, narrow = vocabulary.classes, _narrow(vocabulary.classes)
    spark = encoded.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary.n * 8 // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast((vocabulary.h, classes, *affinity(t)))
    group = 1 + vocabulary.words

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, _, _ = shared.value
        held, size = [], 0
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                item, before, first = _sequences(part)
                after = np.append(item[1:], 0)
                at, word = _words(part, item >= group, first, known)
                held.append((word, classes[before[at]], classes[after[at]]))
                size += len(at)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, b, a = (np.concatenate(x) for x in zip(*held, strict=True))
        at, inverse = bk.distinct(h)
        key, n = np.unique((inverse * k + b) * k + a, return_counts=True)
        word = key // (k * k)
        h, size = h[at], np.bincount(word, minlength=len(at))
        # Words by bucket, and their occurrences in the order of the words.
        bucket = (h >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        begin, cuts = np.cumsum(size) - size, np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = np.repeat(begin[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(key))
        edge = np.concatenate([[0], np.cumsum(size[order])])
        b, a, n = (key // k % k)[rows].astype(narrow), (key % k)[rows].astype(narrow), n[rows].astype(np.uint32)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        for lo in range(0, len(some), 16):
            data = []
            for i in some[lo : lo + 16]:
                own, part = order[cuts[i] : cuts[i + 1]], slice(edge[cuts[i]], edge[cuts[i + 1]])
                data.append(b"".join(x.tobytes() for x in (np.array([len(own), part.stop - part.start], np.int64), h[own], size[own].astype(np.uint32), b[part], a[part], n[part])))
            yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 16], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    def read(blob: bytes) -> tuple[np.ndarray, ...]:
        words, rows = np.frombuffer(blob, np.int64, 2).tolist()
        at, out = 16, []
        for kind, count in ((np.uint64, words), (np.uint32, words), (narrow, rows), (narrow, rows), (np.uint32, rows)):
            out.append(np.frombuffer(blob, kind, count, at))
            at += out[-1].nbytes
        return np.repeat(out[0], out[1]), *out[2:]

    def choose(table: pa.Table) -> pa.Table:
        _, _, before, after = shared.value
        h, b, a, n = (np.concatenate(x) for x in zip(*map(read, table.column("data").to_pylist()), strict=True))
        order = np.argsort(h, kind="stable")
        h, b, a, n = (x[order] for x in (h, b, a, n))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        c = np.add.reduceat(n.astype(np.int64), begin)
        best, step = np.empty(len(begin), np.int32), max(1, BLOCK_BYTES // (8 * k))
        edge = np.append(begin, len(h))
        for lo in range(0, len(begin), step):
            hi = min(lo + step, len(begin))
            rows = slice(edge[lo], edge[hi])
            word = np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1])) * k
            fit = np.bincount(word + b[rows], n[rows], (hi - lo) * k).reshape(-1, k) @ before
            fit += np.bincount(word + a[rows], n[rows], (hi - lo) * k).reshape(-1, k) @ after
            best[lo:hi] = fit.argmax(1)
        best[c < MIN_COUNT] = -1
        return pa.table({"h": pa.array(bk.as_long(h[begin])), "cls": pa.array(best), "c": pa.array(c)})

    sent = encoded.where(~F.col("held_out")).select("seq", "more", "rare").mapInArrow(send, "bucket int, data binary")
    return sent.groupBy("bucket").applyInArrow(lambda t: choose(t), LEXICON)


def _narrow(k: int) -> type:
    """The kind of number that holds a class, or that a class is not known yet."""
    return np.uint8 if k < 256 else np.uint16


def _words(part: pa.RecordBatch, grouped: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the tokens that are a group's item."""
    at = np.flatnonzero(grouped)
    more = bk.flat(part.column("more"))[0].view(np.int32)
    rare = part.column("rare")
    base = rare.offsets.to_numpy()[:-1] - rare.offsets[0].as_py()
    doc = np.searchsorted(first, at, "right") - 1
    values = rare.flatten().to_numpy().view(np.uint64)
    out = np.empty(len(at), np.uint64)
    seen = more >= 0
    out[seen] = known[more[seen]]
    out[~seen] = values[base[doc[~seen]] - 1 - more[~seen]]
    return at, out


RESOLVED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, emitted double, seq binary, places binary, groups binary, n_rare int"
CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, emitted double, seq binary"


def classed(encoded: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, words: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Class sequences of all documents, complete sums over counts, and log10 of the words within their classes; and the sizes of the classes."""
    k, narrow = vocabulary.classes, _narrow(vocabulary.classes)
    known = words.where(is_known(vocabulary.n)).toArrow()
    own_class = np.full(len(vocabulary.h) + 1, -1, np.int32)
    if known.num_rows:
        own_class[np.searchsorted(vocabulary.h, known.column("h").to_numpy().view(np.uint64))] = known.column("cls").to_numpy()
    chosen = words.where("cls >= 0").groupBy("cls").agg(F.sum("c").alias("n")).toArrow()
    weight = np.maximum(vocabulary.weight, 1.0)
    size = np.bincount(classes, weight, k)
    size[chosen.column("cls").to_numpy()] += chosen.column("n").to_numpy()
    group = 1 + vocabulary.words
    # log10 of an unseen word of a group, within the group's class.
    unseen = np.log10(weight[group:]) - np.log10(vocabulary.weight[group:] + vocabulary.tail_v + 1)
    shared = encoded.sparkSession.sparkContext.broadcast((own_class, np.append(vocabulary.c, 0), classes, weight, np.log10(np.maximum(size, 1e-300)), unseen))
    pieces = lambda x, cuts: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All but the rare words, which count as unseen ones for now."""
        own_class, counts, classes, weight, size, unseen = shared.value
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                item, _, first = _sequences(part)
                at = np.flatnonzero(item >= group)
                more = bk.flat(part.column("more"))[0].view(np.int32)
                own, count = own_class[np.maximum(more, -1)], counts[np.maximum(more, -1)]
                some = own >= 0
                cls, logs = classes[item], np.log10(weight[item])
                cls[at[some]] = own[some]
                logs[at] = np.where(some, np.log10(np.maximum(count, 1)), np.log10(count + 1.0) + unseen[item[at] - group])
                emitted = np.add.reduceat(logs - size[cls], first[:-1])
                rare = at[more < 0]
                cls[rare] = k
                cut = np.searchsorted(rare, first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(emitted), pieces(cls.astype(narrow), first), pieces(-1 - more[more < 0], cut), pieces((item[rare] - group).astype(np.uint16), cut), part.column("n_rare")],
                    [x.split()[0] for x in RESOLVED.split(", ")],
                )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, classes, _, size, unseen = shared.value
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                cls, _, first = _sequences(part, narrow)
                at = np.flatnonzero(cls == k)
                places, groups = bk.flat(part.column("places"))[0].view(np.int32), bk.flat(part.column("groups"))[0].view(np.uint16).astype(np.int64)
                length = part.column("n_rare").to_numpy().astype(np.int64)
                base = np.cumsum(length) - length
                hits = part.column("found")
                x, row = hits.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(part.num_rows), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                where = base[row] + (x >> (COUNT_BITS + CLASS_BITS))
                own_class, own_count = np.full(int(length.sum()), -1), np.zeros(int(length.sum()), np.int64)
                own_class[where], own_count[where] = (x >> COUNT_BITS & (1 << CLASS_BITS) - 1) - 1, x & (1 << COUNT_BITS) - 1
                doc = np.searchsorted(first, at, "right") - 1
                own, count = own_class[base[doc] + places], own_count[base[doc] + places]
                default = classes[group + groups]
                some = own >= 0
                cls[at] = np.where(some, own, default)
                more = np.where(some, np.log10(np.maximum(count, 1)) - size[own] - unseen[groups] + size[default], np.log10(count + 1.0))
                total = lambda y: np.bincount(doc, y, part.num_rows)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(part.column("n_known").to_numpy() + total(count > 0).astype(np.int64)), pa.array(part.column("logs").to_numpy() + total(np.log10(count + 1.0))),
                        pa.array(part.column("emitted").to_numpy() + total(more)), pieces(cls.astype(narrow), first),
                    ],
                    [x.split()[0] for x in CLASSED.split(", ")],
                )

    asked = encoded.select("rid", F.posexplode("rare").alias("j", "h"))
    packed = F.shiftleft(F.col("j").cast("long"), COUNT_BITS + CLASS_BITS) + F.shiftleft((F.col("cls") + 1).cast("long"), COUNT_BITS) + F.col("c")
    found = asked.join(words.where(~is_known(vocabulary.n)), "h").groupBy("rid").agg(F.collect_list(packed).alias("found"))
    rows = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "seq", "more", F.size("rare").alias("n_rare")).mapInArrow(resolve, RESOLVED)
    return rows.join(found, "rid", "left").drop("rid").mapInArrow(complete, CLASSED), size


def steps(sequences: DataFrame, k: int) -> np.ndarray:
    """Class transition counts over all training documents."""
    narrow = _narrow(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k, np.int64)
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                cls, before, _ = _sequences(part, narrow)
                out += np.bincount(before * k + cls, minlength=k * k)
        yield from _blocks(out)

    return _totals(sequences.where(~F.col("held_out")).select("seq").mapInArrow(count, "block int, counts binary"), (k, k))


class Model:
    """A trained model: ``vocabulary``, ``classes`` of its items, ``words`` with theirs, ``size`` of the classes, and their ``transition`` as log10."""

    def __init__(self, docs: DataFrame) -> None:
        counts = materialize(word_counts(docs.where(~held_out(F.col("doc_id")))), "word-counts")
        self.vocabulary = Vocabulary(counts)
        encoded = materialize(encode(docs, self.vocabulary), "encoded")
        self.classes, t = cluster(encoded, self.vocabulary)
        self.words = materialize(lexicon(encoded, self.vocabulary, self.classes, t), "lexicon")
        rows, self.size = classed(encoded, self.vocabulary, self.classes, self.words)
        self.sequences = materialize(rows, "classed")
        t = steps(self.sequences, self.vocabulary.classes) + ALPHA
        self.transition = np.log10(t / t.sum(1, keepdims=True))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and perplexity by token."""
    model = Model(docs)
    vocab, narrow = model.vocabulary, _narrow(model.vocabulary.classes)
    shared = docs.sparkSession.sparkContext.broadcast(model.transition)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition = shared.value
        for batch in batches:
            for part in bk.slices(batch, "seq", SEQUENCE_BYTES):
                cls, before, first = _sequences(part, narrow)
                x = np.add.reduceat(transition[before, cls], first[:-1]) + part.column("emitted").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(x)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    scored = model.sequences.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(vocab.n + vocab.v + 1))).alias("base_score"),
        "score",
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
