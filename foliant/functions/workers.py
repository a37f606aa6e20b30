"""Arrow batches in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers; on a cluster whose executors do not see the folder, ship the package with --py-files."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", "")]))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the Python path of the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
