"""The null histogram as a stream: counts per bin merge by addition, so batches of replicates can arrive at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.null import NBINS, bin_of


def counted(values: DataFrame, hi: float, nbins: int = NBINS) -> DataFrame:
    """rep, bin, n of a stream (rep, i, j, v)."""
    return values.groupBy("rep", bin_of("v", hi, nbins).alias("bin")).agg(F.count("*").alias("n"))


def start(values: DataFrame, hi: float, name: str, nbins: int = NBINS) -> StreamingQuery:
    return counted(values, hi, nbins).writeStream.outputMode("complete").format("memory").queryName(name).start()
