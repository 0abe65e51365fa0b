"""What a session needs so that Python workers find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def show_package(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path, for sessions started elsewhere.

    That serves local sessions and clusters on which the folder is shared;
    otherwise install the package or pass it with --py-files.
    """
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", "")]))
