"""Command line: ``python -m tessera index -c collection.tsv -o index [-n 4]``, ``python -m tessera search -i index -q queries.tsv -o ranking.tsv``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.encode import get_encoder
from .operators.search import search_text
from .plans.build import Index, build_index
from .sources.text import read_collection, read_queries, write_ranking


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index", help="build an index of a collection")
    build.add_argument("-c", "--collection", required=True)
    build.add_argument("-o", "--output", required=True)
    build.add_argument("-n", "--nbits", type=int, choices=(2, 4), default=4)
    build.add_argument("-m", "--mode", choices=("new", "overwrite", "reuse", "resume"), default="new")
    ask = commands.add_parser("search", help="rank the passages of an index for queries")
    ask.add_argument("-i", "--index", required=True)
    ask.add_argument("-q", "--queries", required=True)
    ask.add_argument("-o", "--output", required=True)
    ask.add_argument("-k", type=int, default=100)
    ask.add_argument("-p", "--nprobe", type=int, default=16)
    for p in (build, ask):
        p.add_argument("-e", "--encoder", default="hash")
    a = parser.parse_args(arguments)
    spark, encoder = SparkSession.builder.getOrCreate(), get_encoder(a.encoder)
    if a.command == "index":
        passages = read_collection(spark, a.collection).withColumnRenamed("pid", "id")
        tokens = encoder(passages, None).select(F.col("id").alias("pid"), "pos", "emb")
        build_index(tokens, a.output, {"new": False, "overwrite": True}.get(a.mode, a.mode), nbits=a.nbits)
    else:
        ranking = search_text(Index.read(spark, a.index), read_queries(spark, a.queries), encoder, a.k, nprobe=a.nprobe)
        write_ranking(ranking, a.output, vars(a))


if __name__ == "__main__":
    main()
