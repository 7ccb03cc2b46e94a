"""Text encoders: a registry, and a hashing encoder that needs no model.

An encoder turns (id, text) rows into token vectors (id, pos, emb), of whole
texts where the limit of tokens is None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import l2_normalize

Encoder = Callable[[DataFrame, int | None], DataFrame]
_registry: dict[str, Encoder] = {}


def register_encoder(name: str, encoder: Encoder) -> None:
    _registry[name] = encoder


def get_encoder(name: str) -> Encoder:
    if name not in _registry:
        raise KeyError(f"no encoder {name!r}; there are {sorted(_registry)}")
    return _registry[name]


def words(text: str) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_numbered = lambda own: F.transform(own, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))


def plain_tokens(text: str, limit: int | None) -> F.Column:
    """(pos, word) of the words of a text, of the first ``limit`` at most."""
    return _numbered(words(text) if limit is None else F.slice(words(text), 1, limit))


def padded_tokens(text: str, length: int, pad: str = "[PAD]") -> F.Column:
    """Exactly ``length`` tokens: cut, or filled with padding."""
    own = F.slice(words(text), 1, length)
    return _numbered(F.concat(own, F.array_repeat(F.lit(pad), F.lit(length) - F.size(own))))


def query_tokens(text: str, length: int | None = 32, context: str | None = None, longest: int = 500) -> F.Column:
    """A query marker, the words, and masks up to ``length``; without a length as many as the text has, ``longest`` at most; the words of a context follow after a separator."""
    room = F.lit(longest if length is None else length)
    own = F.slice(words(text), 1, room - 1)
    own = F.concat(F.array(F.lit("[Q]")), own)
    if length is not None:
        own = F.concat(own, F.array_repeat(F.lit("[MASK]"), room - F.size(own)))
    if context is not None:
        own = F.concat(own, F.array(F.lit("[SEP]")), words(context))
    return _numbered(own)


def document_tokens(text: str, limit: int | None = None) -> F.Column:
    """A document marker and the words; tokens that are punctuation alone take a place but give no vector."""
    own = F.concat(F.array(F.lit("[D]")), words(text) if limit is None else F.slice(words(text), 1, limit - 1))
    return F.filter(_numbered(own), lambda x: F.length(F.translate(x["word"], PUNCTUATION, "")) > 0)


def hashing_encoder(dim: int = 64, tokens: Callable[[str, int | None], F.Column] = plain_tokens) -> Encoder:
    """Each word a unit vector of signed hashed components: same word, same vector.  ``word`` stays with it, for skip lists.

    ``encode.tokens`` and ``encode.vectors`` are its halves, so that what words share is made once a word.
    """

    def vectors(toks: DataFrame) -> DataFrame:
        raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.col("word"), i), F.lit(2001)) - 1000) / 1000.0)
        return toks.withColumn("emb", l2_normalize(raw))

    def encode(rows: DataFrame, max_tokens: int | None) -> DataFrame:
        toks = rows.select("id", F.explode(tokens("text", max_tokens)).alias("token")).select("id", "token.pos", "token.word")
        return vectors(toks).select("id", "pos", "emb", "word")

    encode.tokens, encode.vectors = tokens, vectors
    return encode


def arrow_encoder(load: Callable[[], Callable[[list[str], int | None], list[list[list[float]]]]], batch: int = 128) -> Encoder:
    """Adapter for a model: ``load`` runs once per task and returns texts, limit -> vectors by text."""

    def encode(rows: DataFrame, max_tokens: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    out = {"id": [], "pos": [], "emb": []}
                    for i, vectors in zip(part.column("id").to_pylist(), model([t or "" for t in part.column("text").to_pylist()], max_tokens), strict=True):
                        for pos, v in enumerate(vectors[:max_tokens]):
                            out["id"].append(i)
                            out["pos"].append(pos)
                            out["emb"].append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(out["id"], part.schema.field("id").type), pa.array(out["pos"], pa.int32()), pa.array(out["emb"], pa.list_(pa.float64()))], ["id", "pos", "emb"])

        return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pos int, emb array<double>")

    return encode


def drop_skipped(tokens: DataFrame, skipped: DataFrame) -> DataFrame:
    """Without the words on a skip list (column word), such as punctuation."""
    return tokens.join(skipped.select("word"), "word", "left_anti")


register_encoder("hash", hashing_encoder())
register_encoder("hash-query", hashing_encoder(tokens=query_tokens))
register_encoder("hash-document", hashing_encoder(tokens=document_tokens))
