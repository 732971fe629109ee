"""Operator 7: n-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its WORDS-word shingles. Documents with equal sets are one class, of which a
representative goes on. Its MinHash signature has TREES prefixes of DEPTH values.

1. The prefixes of all trees are sorted, globally and by range, so a node of a tree's trie is a run of
   rows, and a node as large as the corpus still spreads over many tasks. A row gets the sizes of the
   nodes at each of its prefixes, from the longest down to SHORTEST values.
2. Every document starts from its longest prefix in all trees and shortens one prefix after another
   until a pair at the similarity asked for is found with probability RECALL. The next prefix to be
   shortened is the one whose node grows least. Nodes of up to SMALL rows cost nothing, so that no choice
   hangs on whether one partner is there, which would spoil the probability; among equals the longest
   is shortened. So documents with common prefixes keep these long and shorten others instead.
3. All rows of a node that a document has stopped at are matched. The rows of a node are linked to one of
   each of SALTS parts, these to one of the node: stars, so nodes never become pairs of rows.
4. Links are verified exactly. What stars connect is one unit if it has at most UNIT representatives.
   Larger ones, which chance matches can string together, are taken apart: what nodes of more than SMALL
   rows connect is a family, and every smaller node that joins different families, or documents of
   none, is a unit of its own; a pair counts in the first unit that has it. A family of more than UNIT is
   dealt into blocks at random, and each pair of blocks is a unit. Units count links by products of 0/1
   matrices and hand on counts and a spanning forest, not pairs. Connected representatives, and their
   copies, get one class id.

Counting every link of a document takes work for every link: a family of n different texts that are
all similar takes n * n / 2 comparisons, and each of them goes to as many units as there are blocks
(32 up to 16,384 texts, then n / BLOCK). Other representatives go to at most one unit a node.

Defined results: words are what stands between ASCII white space, as written. A text of fewer than
WORDS words is one shingle of them all; a null text or one without words has no shingles, no links,
and is a class of its own, as is a text unlike all others. Repeated rows are copies of each other.
Null doc_ids are kept and give a class its id only if it has no other. An empty table gives an empty
result; other columns are ignored, or handed on by `representatives`. Shingles are compared by 64-bit
hashes, which differ for different shingles but for one in 2^64.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.kept_texts import Texts
from netloom.llm.shared import discard, remember, scratch, shuffle_width, written

WORDS, TREES, DEPTH, SHORTEST, RECALL = 5, 16, 6, 3, 0.9997
#: Similarity asked for, as a fraction of integers.
SIMILAR = (4, 5)
#: Rows of a node that cost nothing, and parts of a node's star.
SMALL, SALTS = 64, 32
#: Representatives of one unit, of a block at least and at most, blocks until they grow; columns of a matrix.
UNIT, FINE, BLOCK, BLOCKS, COLUMNS = 256, 128, 512, 32, 8192
KEPT_WORDS, KEPT_BYTES = 250_000, 64
_M = np.uint64(0x9E3779B97F4A7C15)
_LENGTHS = range(SHORTEST, DEPTH + 1)


def chosen_lengths(sizes: np.ndarray, similarity: float = SIMILAR[0] / SIMILAR[1], recall: float = RECALL) -> np.ndarray:
    """The prefix length of each document (rows) in each tree (columns), from the sizes of the nodes at
    the lengths SHORTEST to DEPTH (third axis).

    A pair of that similarity shares a prefix of d values with probability similarity ** d, independently
    in every tree, so the logarithms of missing it add up.
    """
    docs, trees, steps = sizes.shape
    evidence = -np.log1p(-(similarity ** np.arange(SHORTEST, SHORTEST + steps)))
    cost = np.where(sizes > SMALL, sizes, 0)
    at = np.full((docs, trees), steps - 1)
    got = np.full(docs, trees * evidence[-1])
    open_ = np.flatnonzero(got < -math.log1p(-recall))
    while len(open_):
        now = at[open_]
        here = np.take_along_axis(cost[open_], now[..., None], 2)[..., 0]
        there = np.take_along_axis(cost[open_], np.maximum(now - 1, 0)[..., None], 2)[..., 0]
        gain = evidence[np.maximum(now - 1, 0)] - evidence[now]
        price = np.where(now > 0, (there - here) / np.maximum(gain, 1e-12), np.inf)
        # among equal prices the longest prefix, then the first tree
        best = np.lexsort((np.broadcast_to(np.arange(trees), now.shape), -now, price), axis=1)[:, 0]
        each = np.arange(len(open_))
        fits = now[each, best] > 0
        open_, best, each = open_[fits], best[fits], each[fits]
        got[open_] += gain[each, best]
        at[open_, best] -= 1
        open_ = open_[got[open_] < -math.log1p(-recall)]
    return at + SHORTEST


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def forget() -> None:
    """Forgets the worker's words."""
    _words.clear()


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the text's shingles, ascending, each once."""
    words = text.split()
    n = len(words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        k = min(WORDS, n)
        if not k:
            return h
        out = h[: n - k + 1].copy()
        for i in range(1, k):
            out = out * _M + h[i : n - k + 1 + i]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        return np.unique(out ^ (out >> np.uint64(29)))


_seeds = np.random.default_rng(20240229)
_FACTORS = _seeds.integers(1, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _seeds.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def signature(own: np.ndarray) -> bytes:
    """MinHash values, tree after tree, each big-endian, so that bytes sort as values do."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 4096):
            h = (own[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
            least = np.minimum(least, (h[:, None] * _FACTORS + _TERMS).min(axis=0))
    return least.astype(">u4").tobytes()


SETS = "file int, row int, doc_id long, digest binary, size int, signature binary"


def sets(texts: Texts, spark: SparkSession, column: str = "text") -> DataFrame:
    """A row a document: its place, the digest and size of its set, and the set's signature."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("near_duplicates", forget)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                row = 0
                for part in texts.batches(file, ["doc_id", column]):
                    out = []
                    for text in part[column]:
                        own = shingles((text.as_py() or "").encode())
                        out.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), signature(own)) if len(own) else (None, 0, None))
                    n = len(part)
                    columns = list(zip(*out)) if out else [(), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, file, np.int32)),
                            pa.array(np.arange(row, row + n, dtype=np.int32)),
                            part["doc_id"].cast(pa.int64()),
                            pa.array(columns[0], pa.binary()),
                            pa.array(columns[1], pa.int32()),
                            pa.array(columns[2], pa.binary()),
                        ],
                        ["file", "row", "doc_id", "digest", "size", "signature"],
                    )
                    row += n

    return texts.every_file(spark).mapInArrow(make, SETS)


TRIES = "uid long, tree int, " + ", ".join(f"n{d} int" for d in _LENGTHS) + ", " + ", ".join(f"k{d} long" for d in _LENGTHS)


def tries(reps: DataFrame, spark: SparkSession) -> DataFrame:
    """Sorted prefixes of all trees: uid, tree, and the size and key of its node at each length.

    Rows that share no prefix of SHORTEST values are left out. Sizes count the rows of a node in one range.
    """
    width = 4 * DEPTH
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.substring("signature", t * width + 1, F.lit(width)).alias("prefix")))
    rows = reps.select("uid", F.inline(prefixes))
    ordered = rows.repartitionByRange(shuffle_width(spark), "tree", "prefix", "uid").sortWithinPartitions("tree", "prefix", "uid")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b"".join(b.column(2).to_pylist())) for b in batches if len(b)]
        if not held:
            return
        uid, tree = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        values = np.frombuffer(b"".join(h[2] for h in held), ">u4").reshape(len(uid), DEPTH).astype(np.uint64)
        del held
        same = np.zeros((len(uid), DEPTH + 1), bool)  # with the row before: the tree, then each value
        same[1:, 0] = tree[1:] == tree[:-1]
        same[1:, 1:] = values[1:] == values[:-1]
        shared = np.cumprod(same, axis=1).sum(axis=1) - 1
        key = tree.astype(np.uint64) + np.uint64(1)
        sizes, keys = [], []
        with np.errstate(over="ignore"):
            for d in range(DEPTH):
                key = (key ^ (key >> np.uint64(29))) * _M + values[:, d]
                if d + 1 >= SHORTEST:
                    run = np.cumsum(shared < d + 1) - 1
                    sizes.append(np.bincount(run)[run].astype(np.int32))
                    keys.append((key ^ (key >> np.uint64(32))).view(np.int64))
                    if d + 1 == SHORTEST:
                        wanted = (sizes[0] > 1) | (run == 0) | (run == run[-1])
        for at in range(0, len(uid), 1 << 16):
            some = at + np.flatnonzero(wanted[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (uid, tree, *sizes, *keys)], [x.split()[0] for x in TRIES.split(", ")])

    return ordered.mapInArrow(nodes, TRIES)


NODES = "uid long, key long, own boolean"


def searched(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """uid, key, own: the nodes of each document from its shortest length to the one that it chose, which is its own."""
    steps = len(_LENGTHS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            uid = table["uid"].to_numpy()
            end = int(np.searchsorted(uid, uid[-1])) if len(uid) else 0  # the last document may go on
            left = table.slice(end)
            yield from of(table.slice(0, end))
        if left is not None:
            yield from of(left)

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        uid, tree = table["uid"].to_numpy(), table["tree"].to_numpy()
        docs, at = np.unique(uid, return_inverse=True)
        sizes = np.ones((len(docs), TREES, steps), np.int64)
        keys = np.stack([table[f"k{d}"].to_numpy() for d in _LENGTHS], axis=1)
        sizes[at, tree] = np.stack([table[f"n{d}"].to_numpy() for d in _LENGTHS], axis=1)
        last = chosen_lengths(sizes)[at, tree] - SHORTEST
        row, step = np.nonzero(np.arange(steps)[None, :] <= last[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(keys[row, step]), pa.array(step == last[row])], ["uid", "key", "own"])

    return rows.repartition(shuffle_width(spark), "uid").sortWithinPartitions("uid").mapInArrow(choose, NODES)


def matched(nodes: DataFrame, name: str) -> DataFrame:
    """uid, key, n, local, first: the rows of each node that some document stopped at and that has several, with
    the first of its part of the node and of the node."""
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "salt").agg(F.min("uid").alias("local"), F.count("*").alias("rows"), F.max("own").alias("own"))
    whole = parts.groupBy("key").agg(F.min("local").alias("first"), F.sum("rows").alias("n"), F.max("own").alias("own")).filter("n > 1 AND own")
    stars = parts.select("key", "salt", "local").join(whole.select("key", "first", "n"), "key")
    return written(salted.select("uid", "key", "salt").join(stars, ["key", "salt"]).select("uid", "key", "n", "local", "first"), name)


def star_edges(nodes: DataFrame) -> DataFrame:
    """a, b: what connects the rows of a node with the first of its part, and that with the node's first."""
    return few_edges(nodes.select("uid", F.col("local").alias("root"))).unionByName(few_edges(nodes.select(F.col("local").alias("uid"), F.col("first").alias("root"))))


def few_edges(pairs: DataFrame) -> DataFrame:
    """a, b: edges with the same components as the pairs (uid, root), one a uid and those between the roots of a uid."""
    own = pairs.groupBy("uid").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    least = F.col("roots")[0]
    between = own.select(F.explode("roots").alias("a"), least.alias("b")).filter("a <> b").distinct()
    return own.select(F.col("uid").alias("a"), least.alias("b")).filter("a <> b").unionByName(between)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node of each component of the edges (a, b).

    Every round a node, and the root it has so far, take the smallest root of the node's neighbours;
    then roots are followed one step. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-roots")
    while True:
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        near = both.join(of_b, "b").join(of_a, "a").filter("root_b < root_a")
        told = near.select(F.explode(F.array("a", "root_a")).alias("node"), F.col("root_b").alias("root"))
        told = written(told.groupBy("node").agg(F.min("root").alias("root")), f"{name}-told")
        if told.isEmpty():
            discard(spark, both, told)
            return roots
        lower = roots.unionByName(told).groupBy("node").agg(F.min("root").alias("root"))
        lower = written(lower, f"{name}-roots")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        followed = written(lower.join(up, "root").select("node", F.col("top").alias("root")), f"{name}-roots")
        discard(spark, roots, told, lower)
        roots = followed


def _uid() -> Column:
    return (F.col("file").cast("long") * F.lit(1 << 32) + F.col("row")).alias("uid")


def blocks_of(n: Column) -> Column:
    """How many blocks n representatives are dealt into."""
    many = F.greatest(F.ceil(n / BLOCK), F.least(F.lit(BLOCKS), F.ceil(n / FINE)))
    return F.when(n <= UNIT, F.lit(1)).otherwise(many).cast("int")


def units(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, row, uid, copies, family, keys, and an array of (group, blocks, block) for each unit that a representative is in.

    A unit that is one node has 0 blocks, its key is the group, and pairs within a family or with a
    smaller common key belong to other units.
    """
    groups = connected(star_edges(nodes), "near-candidates")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    large = written(groups.join(sizes.filter(F.col("size") > UNIT), "root").select(F.col("node").alias("uid")), "near-large")
    small = groups.join(sizes.filter(F.col("size") <= UNIT), "root").select(F.col("node").alias("uid"), F.col("root").alias("group"), F.lit(1).alias("blocks"))
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block")
    no_keys, no_units = F.array().cast("array<long>"), F.array().cast("array<struct<group:long,blocks:int,block:int>>")
    alone = small.select("uid", F.lit(None).cast("long").alias("family"), no_keys.alias("keys"), F.array(F.struct("group", "blocks", block)).alias("units"))
    if large.isEmpty():
        return reps.join(alone, "uid")

    within = nodes.join(large, "uid", "left_semi")
    families = connected(star_edges(within.filter(F.col("n") > SMALL)), "near-families")
    family_sizes = families.groupBy("root").agg(blocks_of(F.count("*")).alias("blocks"))
    in_family = families.join(family_sizes, "root").select(F.col("node").alias("uid"), F.col("root").alias("family"), "blocks")
    loose = within.filter(F.col("n") <= SMALL).select("uid", "key").join(in_family.select("uid", "family"), "uid", "left")
    kinds = F.coalesce("family", -1 - F.col("uid"))
    kept = loose.groupBy("key").agg(F.min(kinds).alias("low"), F.max(kinds).alias("high"), F.bit_xor(F.xxhash64("uid")).alias("who"), F.count("*").alias("n")).filter("low <> high")
    kept = kept.groupBy("who", "n").agg(F.min("key").alias("key")).select("key")  # nodes with the same rows once
    loose = loose.join(kept, "key", "left_semi").groupBy("uid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    both = in_family.join(loose, "uid", "full").withColumn("keys", F.coalesce("keys", no_keys))
    of_family = F.when(F.col("family").isNotNull(), F.array(F.struct(F.col("family").alias("group"), "blocks", block))).otherwise(no_units)
    of_nodes = F.transform("keys", lambda k: F.struct(k.alias("group"), F.lit(0).alias("blocks"), F.lit(0).alias("block")))
    taken = both.select("uid", "family", "keys", F.concat(of_family, of_nodes).alias("units"))
    return reps.join(alone.unionByName(taken), "uid")


MEMBERS = "target int, group long, i int, j int, uid long, block int, copies long, family long, keys array<long>, shingles binary"
LINKS = "uid long, links long, root long"


def linked(sets_: list[np.ndarray], blocks: np.ndarray, crossing: bool) -> np.ndarray:
    """Which sets are similar, as a symmetric 0/1 matrix; with `crossing` only those of different blocks."""
    n, sizes = len(sets_), np.array([len(s) for s in sets_])
    joined = np.concatenate(sets_)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(joined, kind="stable")
    joined, owner = joined[by], owner[by]
    first = np.concatenate([[True], joined[1:] != joined[:-1]])
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        shared += x @ x.T
    counts = shared.astype(np.int64)  # exact: set sizes are below 2^24
    union = sizes[:, None] + sizes[None, :] - counts
    out = SIMILAR[1] * counts >= SIMILAR[0] * union
    np.fill_diagonal(out, False)
    if crossing:
        out &= blocks[:, None] != blocks[None, :]
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """For each node the smallest node that links connect it with."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def without_others(links: np.ndarray, rows: list[dict]) -> np.ndarray:
    """The links of a unit that is one node, less those that are in another unit."""
    for a, b in zip(*np.nonzero(np.triu(links))):
        x, y = rows[a], rows[b]
        elsewhere = x["family"] is not None and x["family"] == y["family"]
        if elsewhere or min(set(x["keys"]).intersection(y["keys"])) != x["group"]:
            links[a, b] = links[b, a] = False
    return links


def _verified(members: DataFrame, texts: Texts, spark: SparkSession, column: str) -> DataFrame:
    """uid, links (copies of linked representatives), root: of each unit that a representative is in."""

    width = shuffle_width(spark)

    def target(group: int, i: int = 0, j: int = 0) -> int:
        """The task of a unit: pairs of a family's blocks go to one task after another, from a hashed start."""
        return (xxhash.xxh3_64_intdigest(group.to_bytes(8, "little", signed=True)) + j * (j + 1) // 2 + i) % width

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("near_duplicates", forget)
        wanted: dict[int, dict[int, dict]] = defaultdict(dict)
        for batch in batches:
            for row in batch.to_pylist():
                wanted[row["file"]][row["row"]] = row
        for file, rows in wanted.items():
            out, held = [], 0
            for row, text in texts.rows(file, column):
                if row not in rows:
                    continue
                own, x = shingles(text).tobytes(), rows[row]
                for unit in x["units"]:
                    group, block = unit["group"], unit["block"]
                    rest = ((file << 32) + row, block, x["copies"], x["family"], x["keys"], own)
                    if not unit["blocks"]:
                        out.append((target(group), group, -1, -1, *rest))
                    for other in range(unit["blocks"]):
                        i, j = min(block, other), max(block, other)
                        out.append((target(group, i, j), group, i, j, *rest))
                    held += len(own) * max(1, unit["blocks"])
                    if held > 4 << 20:
                        yield _members(out)
                        out, held = [], 0
            if out:
                yield _members(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r["uid"])
            blocks, copies, uids = (np.array([r[k] for r in rows]) for k in ("block", "copies", "uid"))
            links = linked([np.frombuffer(r["shingles"], np.uint64) for r in rows], blocks, rows[0]["i"] != rows[0]["j"])
            if rows[0]["i"] < 0:
                links = without_others(links, rows)
            return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(links @ copies), pa.array(uids[forest(links)])], ["uid", "links", "root"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in ("group", "i", "j")):
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    n_files = max(1, len(texts))
    shipped = members.repartitionById(n_files, "file").mapInArrow(ship, MEMBERS)
    unit = ["group", "i", "j"]
    return shipped.repartitionById(width, "target").sortWithinPartitions(*unit).mapInArrow(verify, LINKS)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MEMBERS.split(", ")])


def _joined(texts: Texts, spark: SparkSession, column: str) -> DataFrame:
    """file, row, doc_id, class_id, copy_of, n_links, first: a row a document."""
    own = written(sets(texts, spark, column), "near-sets").withColumn("uid", _uid())
    classes = written(
        own.filter("digest is not null").groupBy("digest").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")),
        "near-classes",
    )
    reps = own.select("uid", "file", "row", "signature").join(classes.select(F.col("rep").alias("uid"), "copies"), "uid")
    with scratch(spark) as kept:
        found = written(tries(reps.select("uid", "signature"), spark), "near-tries")
        nodes = matched(written(searched(found, spark), "near-searched"), "near-nodes")
        members = units(reps.select("uid", "file", "row", "copies"), nodes)
        links = written(_verified(members.select("file", "row", "copies", "family", "keys", "units"), texts, spark, column), "near-links")
        kept.append(links.written_path)
    roots = connected(few_edges(links.select("uid", "root")), "near-classes")
    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    of_rep = written(
        classes.withColumnRenamed("rep", "uid").join(counts, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        .select("digest", "copies", "copy_of", "uid", F.coalesce("links", F.lit(0)).alias("links"), "root", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt")),
        "near-representatives",
    )
    # the first document of a class: the smallest doc_id, then the first place; of equal sets, then of linked ones
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    of_set = own.filter("digest is not null").groupBy("digest").agg(F.min(place).alias("of_set"))
    sets_ = of_rep.join(of_set, "digest")
    of_root = sets_.filter("root is not null").groupBy("root").agg(F.min("of_set").alias("of_root")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = F.coalesce("of_root", "of_set")
    per_set = sets_.join(of_root, ["root", "salt"], "left").select("digest", "copies", "copy_of", "links", first["doc_id"].alias("class_id"), first["uid"].alias("first"))
    return own.select("file", "row", "doc_id", "digest", "uid").join(per_set, "digest", "left").select(
        "file",
        "row",
        "doc_id",
        F.coalesce(F.when(F.col("digest").isNotNull(), F.col("class_id")), "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("first", "uid") == F.col("uid")).alias("first"),
    )


def joined(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id that links connect it with), copy_of (smallest doc_id with an
    equal set) and n_links (other documents at the similarity or more, copies included)."""
    spark = docs.sparkSession
    texts = Texts.of(docs.select("doc_id", column), "near-texts")
    return _joined(texts, spark, column).select("doc_id", "class_id", "copy_of", "n_links")


def representatives(docs: DataFrame, column: str = "text") -> DataFrame:
    """The first document of every class, with its columns."""
    spark = docs.sparkSession
    texts = Texts.of(docs, "near-texts")
    if not len(texts):
        return docs
    n_files = len(texts)
    schema = docs.schema

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = defaultdict(list)
        for batch in batches:
            for file, row in zip(batch["file"].to_pylist(), batch["row"].to_pylist()):
                wanted[file].append(row)
        for file, rows in wanted.items():
            rows, base = np.sort(rows), 0
            for part in texts.batches(file):
                a, b = np.searchsorted(rows, [base, base + len(part)])
                if b > a:
                    yield part.take(pa.array(rows[a:b] - base))
                base += len(part)

    firsts = _joined(texts, spark, column).filter("first").select("file", "row")
    return firsts.repartitionById(n_files, "file").mapInArrow(take, schema)
