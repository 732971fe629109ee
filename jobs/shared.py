"""What both jobs need: their command line, their config file, and reading a folder that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def config_of(path: str, **known: type | tuple[type, ...]) -> dict:
    """The config file's values; raises for one that is missing, unknown or of another type."""
    with open(path) as f:
        config = json.load(f)
    if set(config) != set(known):
        raise ValueError(f"{path} has {sorted(config)} and needs {sorted(known)}")
    for name, kind in known.items():
        if not isinstance(config[name], kind) or isinstance(config[name], bool):
            raise ValueError(f"{path}: {name} is {config[name]!r}")
    return config


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder; no rows where nothing was written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while; then they are as they were."""
    before = {k: spark.conf.get(k) for k in values}  # settings of Spark's own have a default
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def command_line(name: str, about: str, paths: dict[str, str], config: str, run: Callable[[SparkSession, argparse.Namespace], DataFrame]) -> None:
    """Parses the paths, starts a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for path, help_ in paths.items():
        parser.add_argument(f"--{path}", required=True, help=help_)
    parser.add_argument("--config", default=config, help="JSON file with the job's parameters")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
