"""Readers and writers of matrices, networks and tables of text files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _long(wide: DataFrame, ids: list[str]) -> DataFrame:
    columns = [c for c in wide.columns if c not in ids]
    own = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return own.unpivot(ids, columns, "sample", "x").filter("x IS NOT NULL")


def compendium(spark: SparkSession, path: str) -> DataFrame:
    """var, sample, x of a wide table: the variable is the second to last part (_) of the first column."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first = wide.columns[0]
    return _long(wide.withColumn("var", F.element_at(F.split(F.col(f"`{first}`"), "_"), -2)).drop(first), ["var"])


def plain_matrix(spark: SparkSession, path: str, names_path: str, sep: str = "\t") -> DataFrame:
    """var, sample (column number), x of a table without header; names stand in a file of their own, in order.

    Lines are numbered by their files' order, as a position in the file is all that joins both.
    """
    number = lambda p: spark.read.text(p).rdd.map(lambda r: r[0]).zipWithIndex().toDF("line string, k long")
    rows, names = number(path), number(names_path).select(F.trim("line").alias("var"), "k")
    cells = rows.join(names, "k").select("var", F.posexplode(F.split("line", sep)).alias("sample", "x"))
    return cells.select("var", "sample", F.expr("try_cast(x AS double)").alias("x")).filter("x IS NOT NULL")


def named_csv(spark: SparkSession, path: str) -> DataFrame:
    """var, sample, x of a wide table with names in its first column."""
    wide = spark.read.csv(path, header=True)
    return _long(wide.withColumnRenamed(wide.columns[0], "var"), ["var"])


def commented(spark: SparkSession, path: str) -> DataFrame:
    """A table with # comments and numbered column names ("1)id"); cells are trimmed, missing ones empty."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#")
    names = [c.strip().split(")", 1)[-1] if c.strip()[:1].isdigit() and ")" in c else c.strip() for c in rows.columns]
    return rows.toDF(*names).select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names])


def network(spark: SparkSession, path: str) -> DataFrame:
    """factor, target, confidence, distinct, of a file of seven columns or more (gene in the third, target in
    the fifth, confidence in the seventh) or of the classic five (factor, target, effect, evidence, confidence)."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).filter("value <> '' AND NOT value LIKE '#%'").select(cells.alias("c"))
    wide = F.size("c") >= 7
    own = rows.select(
        F.explode(F.split(F.when(wide, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(0))), r"[;,/ ]+")).alias("factor"),
        F.trim(F.when(wide, F.get("c", F.lit(4))).otherwise(F.get("c", F.lit(1)))).alias("target"),
        F.upper(F.substring(F.trim(F.when(wide, F.get("c", F.lit(6))).otherwise(F.get("c", F.lit(4)))), 1, 1)).alias("confidence"),
    )
    head = F.lower(F.col("factor")).rlike(r"^([0-9]+\))?(regulator|tf)")
    return own.filter((F.trim("factor") != "") & (F.col("target") != "") & ~head).distinct()


def experimenters(spark: SparkSession, path: str) -> DataFrame:
    """experiment_name, grp: what follows "experimenter:" in a description; unknown ones are a group each."""
    rows = spark.read.csv(path, sep="\t", header=True)
    found = F.nullif(F.trim(F.regexp_extract("description", r"experimenter:([^,]*)", 1)), F.lit(""))
    per = rows.groupBy("experiment_name").agg(F.min(found).alias("grp"))
    return per.select("experiment_name", F.coalesce("grp", F.concat(F.lit("unknown_"), F.col("experiment_name"))).alias("grp"))


def annotated(spark: SparkSession, path: str, labels: str, wanted: str, names: str = "gene_name", block: int = 256) -> DataFrame:
    """var (name), sample, x of the cells of an HDF5 file (X, obs, var) whose label is the wanted one.

    Needs h5py. Only the wanted cells are read, in blocks of neighbours, a task some blocks; categories of
    either layout are decoded.
    """
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 needs h5py; convert the file to Parquet elsewhere") from missing
    import numpy as np
    import pandas as pd

    def decoded(file, group: str, field: str) -> list[str]:
        text = lambda xs: [x.decode() if isinstance(x, bytes) else str(x) for x in xs]
        node = file[f"{group}/{field}"]
        if isinstance(node, h5py.Group):
            return np.array(text(node["categories"][:]))[node["codes"][:]].tolist()
        kinds = file.get(f"{group}/__categories/{field}")
        return text(node[:]) if kinds is None else np.array(text(kinds[:]))[node[:]].tolist()

    with h5py.File(path, "r") as file:
        variables = decoded(file, "var", names)
        cells = np.flatnonzero(np.array(decoded(file, "obs", labels)) == wanted)
    blocks = spark.createDataFrame([(cells[k : k + block].tolist(),) for k in range(0, len(cells), block)], "cells array<long>")

    def read(batches):
        with h5py.File(path, "r") as file:
            for pdf in batches:
                for own in pdf.cells:
                    x = file["X"][np.asarray(own), :]
                    yield pd.DataFrame({"var": np.tile(variables, len(own)), "sample": np.repeat(own, len(variables)), "x": x.astype(float).ravel()})

    return blocks.mapInPandas(read, "var string, sample long, x double")


def edge_list(edges: DataFrame, variables: DataFrame, symmetric: bool = False) -> DataFrame:
    """src, dst, w of named edges (a, b, weight) between known variables (var, name); symmetric takes the larger of both."""
    names = variables.select("name", "var")
    own = edges.join(names.select(F.col("name").alias("a"), F.col("var").alias("src")), "a").join(names.select(F.col("name").alias("b"), F.col("var").alias("dst")), "b")
    own = own.select("src", "dst", F.col("weight").cast("double").alias("w"))
    if symmetric:
        own = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return own.groupBy("src", "dst").agg(F.max("w").alias("w"))


def write_matrix(m: DataFrame, path: str, samples: list, sep: str = "\t") -> None:
    """A wide table with a row a variable and the given samples as columns."""
    m.groupBy("var").pivot("sample", samples).agg(F.first("x")).write.mode("overwrite").csv(path, sep=sep, header=True)


def save_artifacts(tables: dict[str, DataFrame], parameters: dict, path: str) -> None:
    """Tables as Parquet and parameters as JSON under one path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"parameters": parameters, "tables": sorted(tables)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_artifacts(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest["parameters"]


def pending(tasks: DataFrame, done_path: str, key: str) -> DataFrame:
    """Tasks without a result yet; results are written as partitions by the key, which appear when whole."""
    spark = tasks.sparkSession
    try:
        done = spark.read.parquet(done_path).select(F.col(key).cast(tasks.schema[key].dataType)).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return tasks
    return tasks.join(done, key, "left_anti")


def write_results(results: DataFrame, path: str, key: str) -> None:
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def synthetic(spark: SparkSession, modules: list[int], noise: int, samples: int, loading: float = 0.85, seed: int = 1, common: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A planted matrix (var, sample, x) and its modules (module, member): members load on their module's
    factor, all on a common one."""
    owner = [m for m, n in enumerate(modules) for _ in range(n)] + [-1] * noise
    rows = spark.createDataFrame([(v, m) for v, m in enumerate(owner)], "var int, module int").crossJoin(spark.range(samples).select(F.col("id").cast("int").alias("sample")))

    def normal(*parts: str) -> Column:
        from netloom.functions.numeric import inverse_normal

        return inverse_normal((F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(10**9)) + 0.5) / 1e9)

    own = F.when(F.col("module") >= 0, F.lit(loading)).otherwise(0.0)
    rest = F.sqrt(F.greatest(1 - own * own - common * common, F.lit(0.0)))
    x = own * normal("module", "sample") + common * normal("sample") + rest * normal("var", "sample", "module")
    named = [(f"M{m}", v) for v, m in enumerate(owner) if m >= 0]
    return rows.select("var", "sample", x.alias("x")), spark.createDataFrame(named, "module string, member int")
