"""Job 1: keeps an association network of terms up to date with a folder of documents that grows.

    python -m jobs.term_network --documents DIR --output DIR --checkpoint DIR [--config FILE]

A new sample in an association study changes the network; this job takes in what is new without reading
the old documents again. Per language, terms are the variables, sources are the samples, and a cell is the
number of the source's documents that have the term: terms are normalised for the depth of their source,
the most variable ones are correlated, correlations are calibrated against both terms' backgrounds, each
term keeps its strongest edges, and connected terms are a module.

1. A file stream with a checkpoint and the availableNow trigger takes the files that no earlier run took, and
   counts each batch into its own partition of OUTPUT/counts. A batch that runs again replaces its partition.
2. Languages whose counts have batches beyond OUTPUT/mark are built anew from the counts (never from the
   texts) and replace their partitions of OUTPUT/network.
3. OUTPUT/mark gets each language's last batch.

A run that ends between two of these steps leaves the rest to the next one; a run without new files, and
one that was stopped and started again, give the same output. Files are taken once each by their path.

OUTPUT/network, partitioned by lang: term_a, term_b, strength (absolute correlation), score, module (its
smallest term); a term without edges has one row, without term_b, strength and score. Null text, lang and source count as empty strings; languages without a term
in min_docs documents have no rows.
"""

from __future__ import annotations

import logging
import math
import os
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.shared import command_line, config_of, read_if_there, settings
from netloom.operators.calibrate import calibrated
from netloom.operators.dependence import correlation
from netloom.operators.graph import top_k
from netloom.operators.modules import components
from netloom.operators.transform import completed, depth_normalised, top_variance
from netloom.sources.store import kept

log = logging.getLogger("jobs.term_network")
CONFIG = f"{os.path.dirname(os.path.abspath(__file__))}/term_network.json"
#: What separates terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Digits to which values are ordered, so that equal ones tie whatever the order of their sums.
TIES = 9
#: Counts that a task holds, about, and what a task reads of a file or a shuffle: its memory stays the same as documents grow.
HELD = 250_000
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "32m"}
DOCUMENTS = "text string, lang string, source string"
COUNTS = "lang string, source string, term string, docs long, batch long"
MARK = "lang string, batch long"
NETWORK = "term_a string, term_b string, strength double, score double, module string, lang string"


def config(path: str = CONFIG) -> dict:
    return config_of(path, min_docs=int, top_terms=int, edges_per_term=int, files_per_batch=int)


def term_documents(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs: how many documents of the group have the term."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    each = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.explode(F.array_distinct(F.split(lower, BETWEEN))).alias("term"))
    return each.filter("term <> ''").groupBy("lang", "source", "term").agg(F.count("*").alias("docs"))


def take_new(spark: SparkSession, documents: str, counts: str, checkpoint: str, files_per_batch: int) -> tuple[int, int]:
    """Counts the documents of files that aren't taken yet; how many batches and rows."""

    def count(batch: DataFrame, number: int) -> None:
        own = term_documents(batch).withColumn("batch", F.lit(number).cast("long"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    running = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    done = [p for p in running.recentProgress if p["numInputRows"]]
    return len(done), sum(p["numInputRows"] for p in done)


def network(counts: DataFrame, min_docs: int, top_terms: int, edges_per_term: int) -> DataFrame:
    """The network of every language of the counts. Tables that are read more than once are kept on the way."""
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, math.ceil(counts.count() / HELD))
    dealt = counts.repartition(tasks, "lang", "term").withColumn("n", F.sum("docs").over(W.partitionBy("lang", "term")))
    per_group = dealt.filter(F.col("n") >= min_docs).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"))
    cells = kept(per_group.select(F.col("lang").alias("grp"), F.col("term").alias("var"), F.col("source").alias("sample"), F.col("docs").cast("double").alias("x")))
    values = kept(depth_normalised(kept(completed(cells, "grp"))).select("grp", "var", "sample", F.col("y").alias("x")))
    best = kept(top_variance(values, top_terms, TIES, keys=("grp",)))
    # numbers of languages and of the terms kept, one narrow row each, in the terms' order
    langs = best.select("grp").distinct().withColumn("lang_number", F.row_number().over(W.orderBy("grp")))
    terms = best.select("grp", "var").distinct().join(langs, "grp")
    number = F.row_number().over(W.partitionBy("grp").orderBy("var"))
    names = kept(terms.select(F.col("grp").alias("lang"), F.col("var").alias("term"), F.col("lang_number").alias("grp"), number.alias("var")))
    m = kept(best.withColumnsRenamed({"grp": "lang", "var": "term"}).join(names, ["lang", "term"]).select("grp", "var", "sample", "x"))
    pairs = correlation(m, keys=("grp",)).select("grp", "i", "j", F.abs("r").alias("strength"))
    scores = kept(calibrated(kept(pairs), "strength", keys=("grp",)))
    edges = kept(top_k(scores, edges_per_term, digits=TIES, keys=("grp",)))

    node = lambda var: F.col("grp").cast("long") * (1 << 32) + F.col(var)
    found = components(names.select(node("var").alias("src"), node("var").alias("dst"), F.lit(0.0).alias("w")).unionByName(edges.select(node("src").alias("src"), node("dst").alias("dst"), "w")))
    first = found.groupBy("module").agg(F.min("member").alias("first"))
    modules = found.join(first, "module").select(F.col("member").alias("node"), F.col("first").bitwiseAND((1 << 32) - 1).alias("first"))

    a = names.select("lang", "grp", F.col("var").alias("src"), F.col("term").alias("term_a"))
    b = names.select("grp", F.col("var").alias("dst"), F.col("term").alias("term_b"))
    label = names.select("grp", F.col("var").alias("first"), F.col("term").alias("module"))
    both = edges.withColumn("i", F.least("src", "dst")).withColumn("j", F.greatest("src", "dst")).join(scores, ["grp", "i", "j"]).select("grp", "src", "dst", "strength", "score")
    rows = a.join(both, ["grp", "src"], "left").join(b, ["grp", "dst"], "left").withColumn("node", node("src")).join(modules, "node").join(label, ["grp", "first"])
    return rows.select("term_a", "term_b", "strength", "score", "module", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, parameters: dict) -> DataFrame:
    """Takes in what is new and returns the whole network as it stands."""
    with settings(spark, SMALL):
        return _run(spark, documents, output, checkpoint, parameters)


def _run(spark: SparkSession, documents: str, output: str, checkpoint: str, parameters: dict) -> DataFrame:
    counts_path, mark_path, network_path = (f"{output.rstrip('/')}/{x}" for x in ("counts", "mark", "network"))
    batches, rows = take_new(spark, documents, counts_path, checkpoint, parameters["files_per_batch"])
    log.info("read %d rows of %s in %d batches", rows, documents, batches)

    counts = read_if_there(spark, counts_path, COUNTS).withColumn("lang", F.coalesce("lang", F.lit("")))
    last = counts.groupBy("lang").agg(F.max("batch").alias("batch"))
    mark = read_if_there(spark, mark_path, MARK).withColumnRenamed("batch", "built")
    stale = last.join(mark, "lang", "left").filter("built IS NULL OR built < batch").select("lang")
    if stale.isEmpty():
        log.info("no language has new counts; wrote nothing")
    else:
        own = network(counts.join(stale, "lang", "left_semi"), parameters["min_docs"], parameters["top_terms"], parameters["edges_per_term"])
        own.repartition("lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(network_path)
        last.write.mode("overwrite").parquet(mark_path)
        log.info("wrote the networks of languages with new counts to %s", network_path)
    # an empty language is a partition without a name
    out = read_if_there(spark, network_path, NETWORK).withColumn("lang", F.coalesce("lang", F.lit("")))
    log.info("the network has %d rows", out.count())
    return out


def main() -> None:
    paths = {"documents": "folder of Parquet files with text, lang and source", "output": "folder for counts, mark and network", "checkpoint": "folder for the stream's checkpoint"}
    command_line("term_network", __doc__.splitlines()[0], paths, CONFIG, lambda spark, a: run(spark, a.documents, a.output, a.checkpoint, config(a.config)))


if __name__ == "__main__":
    main()
