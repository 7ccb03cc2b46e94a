"""The shared folder of the library, and the corpus table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import shared
from ..shared import new_path, shared_dir

__all__ = ["documents", "materialize", "new_path", "shared_dir"]

#: Spark drops the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` of the library; what its query shuffled is off the disk soon after."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return shared.materialize(df, name)
    finally:
        conf.set(CLEANUP, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
