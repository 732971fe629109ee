"""Job 2: calibrated association networks of suppliers, region by region, held against their nations.

    python -m jobs.supplier_network --lineitem DIR --supplier DIR --nation DIR --output DIR [--config FILE]

Suppliers are the variables, months the samples, quantities the values. Within each region, pairs get their
B-spline mutual information, calibrated against both members' backgrounds; each supplier keeps its
strongest edges, and the ranking of all pairs is evaluated against the pairs that share a nation.

OUTPUT/edges, partitioned by region: src, dst, score, same_nation. OUTPUT/evaluation, partitioned by region:
pairs, positives, ap, base_rate, auroc. Regions are replaced as a whole (dynamic partition overwrite), so a
run that is repeated, or was stopped and starts again, gives the same output; "regions" in the config
names those to build, null builds all. Suppliers with the same quantity in every month have no information
and are left out, as are rows without a supplier, date or quantity. Measures of a region without pairs of one
nation are null.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.shared import command_line, config_of, read_if_there
from netloom.operators import bins
from netloom.operators.calibrate import calibrated
from netloom.operators.dependence import block_mi
from netloom.operators.graph import contenders, top_k
from netloom.operators.metrics import ranked_apart
from netloom.operators.transform import completed, varying
from netloom.sources.store import kept

log = logging.getLogger("jobs.supplier_network")
CONFIG = f"{os.path.dirname(os.path.abspath(__file__))}/supplier_network.json"
TIES = 9
EDGES = "src int, dst int, score double, same_nation boolean, region int"
EVALUATION = "pairs long, positives long, ap double, base_rate double, auroc double, region int"


def config(path: str = CONFIG) -> dict:
    return config_of(path, bins=(str, int), order=int, edges_per_supplier=int, regions=(list, type(None)))


def matrix(lineitem: DataFrame, members: DataFrame) -> DataFrame:
    """region, var, sample, x: quantity by supplier and month of the members, every month of a region."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    rows = lineitem.select(F.col("l_suppkey").cast("int").alias("var"), month.alias("sample"), F.col("l_quantity").alias("x")).dropna()
    cells = rows.groupBy("var", "sample").agg(F.sum("x").alias("x")).join(members.select("var", "region"), "var")
    return varying(completed(cells, "region"))


def run(spark: SparkSession, lineitem: str, supplier: str, nation: str, output: str, parameters: dict) -> DataFrame:
    """Builds the regions asked for; returns all edges as they stand, with their region's evaluation."""
    edges_path, evaluation_path = (f"{output.rstrip('/')}/{x}" for x in ("edges", "evaluation"))
    items = spark.read.parquet(lineitem)
    nations = spark.read.parquet(nation).select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("region"))
    if parameters["regions"] is not None:
        nations = nations.filter(F.col("region").isin(parameters["regions"]))
    suppliers = spark.read.parquet(supplier).select(F.col("s_suppkey").cast("int").alias("var"), F.col("s_nationkey").cast("int").alias("nation"))
    members = suppliers.join(nations, "nation")
    log.info("read %d suppliers of %s and %d rows of %s", members.count(), supplier, items.count(), lineitem)

    m = kept(matrix(items, members))
    scores = calibrated(kept(block_mi(m, bins.counts(m, parameters["bins"]), parameters["order"], keys=("region",))), keys=("region",))
    # members and thresholds, a row a supplier, are sent to the pairs, which are their square
    of = lambda k: F.broadcast(members.select(F.col("var").alias(k), F.col("nation").alias(f"nation_{k}")))
    named = lambda df, i, j: df.join(of(i), i).join(of(j), j).withColumn("same_nation", F.col(f"nation_{i}") == F.col(f"nation_{j}"))
    scores = kept(named(scores, "i", "j").select("region", "i", "j", "score", "same_nation"))
    k = parameters["edges_per_supplier"]
    chosen = top_k(contenders(scores, k, digits=TIES, keys=("region",)), k, digits=TIES, keys=("region",))
    edges = named(chosen, "src", "dst").select("src", "dst", F.col("w").alias("score"), "same_nation", "region")

    labelled = scores.withColumn("label", F.col("same_nation").cast("int"))
    evaluation = ranked_apart(labelled, ["region"]).select(F.col("n").alias("pairs"), F.col("n_pos").alias("positives"), "ap", "base_rate", "auroc", "region")
    for df, path in ((edges, edges_path), (evaluation, evaluation_path)):
        df.repartition("region").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(path)

    found, measures = read_if_there(spark, edges_path, EDGES), read_if_there(spark, evaluation_path, EVALUATION)
    for r in measures.orderBy("region").collect():  # one row a region
        log.info("region %s: %d pairs, average precision %s at a base rate of %s", r["region"], r["pairs"], r["ap"], r["base_rate"])
    log.info("wrote %d edges to %s", found.count(), edges_path)
    return found.join(measures, "region")


def main() -> None:
    paths = {x: f"Parquet table {x}" for x in ("lineitem", "supplier", "nation")} | {"output": "folder for edges and evaluation"}
    command_line("supplier_network", __doc__.splitlines()[0], paths, CONFIG, lambda spark, a: run(spark, a.lineitem, a.supplier, a.nation, a.output, config(a.config)))


if __name__ == "__main__":
    main()
