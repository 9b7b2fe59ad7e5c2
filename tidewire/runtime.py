"""What workers need to run this package's functions."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def on_workers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with this package's folder on the Python path of workers (a cluster ships it with --py-files)."""
    root = str(Path(__file__).resolve().parent.parent)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
        if root not in parts:
            env["PYTHONPATH"] = ":".join([*parts, root])
        return query(spark, sf_dir)

    return run
