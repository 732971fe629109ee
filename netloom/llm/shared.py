"""Shared storage and table access used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine (tests) makes a temporary folder and sets it; on a
    cluster that would be a folder of the driver's machine, so it raises.
    """
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="netloom-")
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that `written` made, or paths, once what they were for is written itself."""
    for x in tables:
        path = x if isinstance(x, str) else x.written_path
        if path in _made:
            _made.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the paths made within the block at its end, but for those put into the list."""
    kept: list[str] = []
    before = set(_made)
    try:
        yield kept
    finally:
        discard(spark, *[p for p in _made if p not in before and p not in kept])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_remembered: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    """Called by a worker before it fills what the named operator remembers: workers outlive stages, so what
    other operators left in this one goes."""
    for other in [x for x in _remembered if x != name]:
        _remembered.pop(other)()
    _remembered[name] = forget


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h bytes are known to be common."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[h:n], "big") ^ int.from_bytes(b[h:n], "big")
    return n - (x.bit_length() + 7 >> 3)
