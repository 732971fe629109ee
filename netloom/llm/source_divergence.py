"""Operator 12: source divergence audit, in plain relational steps.

How far is each source of a language from the language's other sources, term by term? Runs of
characters without BETWEEN are exploded and counted by language, source and term (in tasks first). The terms of enough documents
of a language are its vocabulary. Each group (lang, source) is crossed with its language's vocabulary,
so that terms it lacks count zero; smoothed shares p are whole numbers of billionths. Pairs of groups
come from a self-join on lang and term, summed per pair (in tasks first); terms are ranked per group.

The cross of groups and vocabulary joins on the language and a bucket of terms, so that a language
that has most of the documents fills all tasks; each unordered pair of groups is summed once and
turned over afterwards. The result has one row for each ordered pair of sources of a language.

Defined results: null text, lang and source are empty strings, and so are a language or source of
their own; null doc_ids and repeated rows count, each row as a document; a group without any kept term
has N = 0; a language without vocabulary has pairs of value 0 and no terms; ties rank by the item's
UTF-8 bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netloom.llm.shared import discard, shuffle_width, written

#: What is in no term. Matches of the opposite class are what stands between: to split there is much the
#: cheaper way to them, and leaves an empty string at a text's ends at most.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Added to every count, and units of a share.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Ranks of terms that are reported.
TOP_TERMS = 50


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences in the group, and documents that have the term.

    A group has one more row, of a null term, for its documents.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.split(lower, BETWEEN).alias("terms"))
    # every occurrence with 0 documents, every different term with 1; one null for the row itself
    kind = lambda terms, count, docs: F.struct(terms.alias("terms"), F.lit(count).alias("count"), F.lit(docs).alias("docs"))
    kinds = F.array(kind(F.col("terms"), 1, 0), kind(F.array_distinct("terms"), 0, 1), kind(F.array(F.lit(None).cast("string")), 0, 1))
    each = found.select("lang", "source", F.explode(kinds).alias("k")).select("lang", "source", F.explode("k.terms").alias("term"), "k.count", "k.docs")
    counts = each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return counts.filter(F.col("term").isNull() | (F.col("term") != ""))


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * size)), in whole numbers of any size."""
    up = (F.col(count) + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = (F.col(total) + F.col(size) * SMOOTHING).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", up, down)


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    counts = written(term_counts(docs), "divergence-counts")
    vocabulary = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
    vocabulary = written(vocabulary.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-vocabulary")
    kept = counts.filter("term IS NOT NULL").drop("docs").join(vocabulary.select("lang", "term"), ["lang", "term"])
    kept = written(kept, "divergence-kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_count").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.fillna(0, ["total", "size", "lang_total"]), "divergence-groups")
    discard(spark, counts)

    # every group with every kept term of its language, in buckets of terms
    buckets = shuffle_width(spark)
    dealt = groups.select("lang", "source", "total", "size", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    terms = vocabulary.select("lang", "term", F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"))
    crossed = dealt.join(terms, ["lang", "bucket"]).drop("bucket").join(kept, ["lang", "source", "term"], "left").fillna(0, ["count"])
    dense = written(crossed.select("lang", "source", "term", share("count", "total", "size").alias("p")), "divergence-shares")

    a, b = dense, dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    summed = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    # pairs of a language without vocabulary have no rows to sum
    other = groups.filter("size = 0").select("lang", "source")
    none = other.join(other.withColumnRenamed("source", "item"), "lang").filter(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    once = summed.unionByName(none)
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
    pairs = once.select("lang", turned, "value").select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value")

    known = kept.filter("count > 0").join(groups, ["lang", "source"]).join(vocabulary, ["lang", "term"])
    above = known.select("lang", "source", "term", share("count", "total", "size").alias("p"), share("lang_count", "lang_total", "size").alias("q")).filter("p > q")
    items = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(items.select("*", rank).filter(F.col("rank") <= top_terms))
