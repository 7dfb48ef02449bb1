"""What the jobs share: settings files, logs, sessions of the command lines, and the ways they write."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def settings(kind, path: str | None, name: str):
    """``kind`` (a dataclass) from a JSON file: the one given, else the one beside the job."""
    with open(path or Path(__file__).with_name(f"{name}.json"), encoding="utf-8") as f:
        return kind(**json.load(f))


def command(description: str, *paths: str) -> argparse.Namespace:
    """The arguments of a command line: the paths, all needed, and the settings file."""
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark can read and write")
    parser.add_argument("--config", help="a settings file in place of the one beside the job")
    parser.add_argument("--shared", help="folder for tables on the way, where spark.checkpoint.dir is not set")
    return parser.parse_args()


def session(name: str, shared: str | None = None) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` in the place of those partitions of ``path`` that it has rows of."""
    df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
