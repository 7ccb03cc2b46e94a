"""Experiment grids, what is missing of them, and step timing."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def expand(grid: dict) -> list[dict]:
    """The Cartesian product of lists; scalars stay."""
    lists = {k: v if isinstance(v, list) else [v] for k, v in grid.items()}
    return [dict(zip(lists, x, strict=True)) for x in itertools.product(*lists.values())]


def expand_file(path: str) -> tuple[dict, list[dict]]:
    """Name, type and parameters of a configuration file, and its expanded configurations."""
    with open(path) as f:
        c = json.load(f)
    return {k: c.get(k) for k in ("name", "type", "parameters")}, expand(c["configurations"])


def grid_frame(spark: SparkSession, **columns: list) -> DataFrame:
    """The grid as rows."""
    return spark.createDataFrame(expand(columns))


def missing_configs(configs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return configs.join(results, keys, "left_anti")


def execute(spark: SparkSession, configs: list[dict], run: Callable[[dict], dict], path: str) -> DataFrame:
    """Run the configurations that a table of results lacks, adding a row after each; the whole table (config, result), as JSON.

    A run that breaks off is taken up where it ended; a configuration is known by its values, whatever their order.
    """
    schema, key = "config string, result string", lambda c: json.dumps(c, sort_keys=True)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done = {r["config"] for r in spark.read.schema(schema).parquet(path).select("config").collect()}
    for c in configs:
        if key(c) not in done:
            done.add(key(c))
            spark.createDataFrame([(key(c), json.dumps(run(c), sort_keys=True))], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Tracker:
    """Seconds by step; every iteration must run the same steps in one order."""

    def __init__(self, steps: list[str]) -> None:
        self.steps, self.rows, self.now = steps, [], None

    @contextmanager
    def iteration(self) -> Iterator[None]:
        self.now = []
        yield
        if [x for x, _ in self.now] != self.steps:
            raise ValueError(f"steps ran as {[x for x, _ in self.now]}")
        self.rows.append(dict(self.now))
        self.now = None

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        t = time.perf_counter()
        yield
        self.now.append((name, time.perf_counter() - t))

    def summary(self) -> dict[str, float]:
        return {s: sum(r[s] for r in self.rows) / max(1, len(self.rows)) for s in self.steps}


def same_over_runs(runs: list[dict]) -> bool:
    """Whether metrics repeat exactly: retrieval is deterministic."""
    return all(r == runs[0] for r in runs)
