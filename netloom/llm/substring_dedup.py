"""Operator 11: removal of repeated substrings of words, by fixed-block anchors.

A word goes if it lies in a window of WINDOW words whose words also start elsewhere. Every document
is cut into reference blocks of BLOCK words, one after the other, without overlap. WINDOW words hold
at least one whole block of their document wherever they start (BLOCK * 2 - 1 <= WINDOW), so of two
equal windows each holds a block of its own document that the other has at the same offset.

1. Index and probe. Tasks send the hashes of all rolling windows of BLOCK words, each once a chunk of
   a file, with a flag on those that are reference blocks. They meet by hash. A hit is a hash that is
   a block somewhere and is found in more than one place.
2. Extend. Around each hit lie the windows of WINDOW words that have it inside. Only these are met
   again, by 128 bits of hash, each once a chunk: a hit extends to every window that is found twice.
3. Cut. Repeated windows that overlap or touch make up the maximal repeats of a document; their words go.

Rows that are exchanged are packed arrays of a chunk of a file, so a task sends one row for each
partition and chunk. What is exchanged is each hash once a chunk, whatever the number of its copies,
and no group of copies is ever gathered, nor are pairs of them made. The different words of a chunk are
hashed to 128 bits (xxh3); a window's 128 bits are two polynomials over its words', so two different windows
pass for equal with a probability below 2**-100, unless made to. Hashes of blocks have 40 bits in a partition, as they only choose candidates.

Documents are kept in a table in the shared folder and read there by the tasks; texts aren't shuffled.

Defined results: null text counts as empty; texts shorter than WINDOW words lose nothing and are
handed back with single spaces, as all are; exact copies of WINDOW words or more lose everything, the
first one too; repeated rows are copies of each other; a text of one very long word is one word;
columns other than text are handed on, whatever their names: where docs has one of the names of the
columns added, that one gets further underscores in front; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from netloom.llm.kept_texts import Texts
from netloom.llm.shared import discard, shuffle_width, written
from netloom.llm.suffix_dedup import mixed, unions

WINDOW = 35
#: The longest block of which every window holds a whole one.
BLOCK = (WINDOW + 1) // 2
#: Bytes of a text that are split at a time, and of a chunk, about.
SEGMENT, CHUNK = 1 << 20, 6 << 20
#: Bytes of the table of texts for each task in which hashes meet.
MEETING_BYTES = 8 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOW = np.uint64(40)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SEGMENT bytes; no word is cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + SEGMENT) if at + SEGMENT < len(text) else None
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of every word of the parts, one after another, and how many words each part has."""
    split = pc.ascii_split_whitespace(pa.array(parts, pa.string()))
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    bits = np.frombuffer(b"".join(map(xxh3_128_digest, different)), "<u8").reshape(-1, 2)
    index = coded.indices.to_numpy()
    word = np.array([bool(w) for w in different] or [False])[index] if len(index) else np.zeros(0, bool)  # white space at the ends gives empty strings
    upto = np.concatenate([[0], np.cumsum(word)])[split.offsets.to_numpy()]
    return bits[index[word]], np.diff(upto)


class Chunk:
    """Neighbouring words of a file's documents: parts of documents, which overlap by WINDOW - 1 words."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]]):
        sizes = np.array([len(words) for _, _, words in parts], np.int64)
        ends = np.cumsum(sizes)
        self.row = np.repeat(np.array([row for row, _, _ in parts], np.int64), sizes)
        self.place = np.arange(len(self.row)) - np.repeat(ends - sizes - np.array([first for _, first, _ in parts], np.int64), sizes)
        self.end = np.repeat(ends, sizes)
        self.words = np.concatenate([words for _, _, words in parts])

    def inside(self, length: int) -> np.ndarray:
        """Which windows of so many words lie in one document."""
        n = max(0, len(self.row) - length + 1)
        return np.arange(length, n + length) <= self.end[:n]

    def rolled(self, length: int, kind: int) -> np.ndarray:
        """A hash of every window of so many words."""
        block, size, out, taken = self.words[:, kind], 1, None, 0
        if len(block) < length:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            while size <= length:
                power = np.uint64(pow(_MULTIPLIERS[kind], size, 1 << 64))
                if length & size:
                    n = len(block) - taken
                    out = block if out is None else out[:n] * power + block[taken : taken + n]
                    taken += size
                if 2 * size <= length:
                    block = block[:-size] * power + block[size:]
                size *= 2
            return mixed(out[: len(self.row) - length + 1])


def chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[Chunk]:
    """The same chunks of the same rows, always."""
    held: list[tuple[int, bytes]] = []
    size, last, seen, tail = 0, -1, 0, np.zeros((0, 2), "<u8")  # of the last document so far: its row, words, and last words

    def chunk() -> Chunk:
        nonlocal last, seen, tail
        words, counts = hashed([part for _, part in held])
        parts, end = [], 0
        for (row, _), n in zip(held, counts.tolist()):
            own, first = words[end : end + n], 0
            end += n
            if row == last:
                own, first = np.concatenate([tail, own]), seen - len(tail)
            last, seen, tail = row, first + len(own), own[-(WINDOW - 1) :]
            parts.append((row, first, own))
        return Chunk(parts)

    for row, text in rows:
        for part in parts_of(text):
            held.append((row, part))
            size += len(part)
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


PROBES = "target int, file int, chunk int, hashes binary, flags binary"
FOUND = "file int, chunk int, hashes binary"


def _sent(file: int, chunk: int, keys: np.ndarray, flags: np.ndarray, targets: np.ndarray, width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of each target's keys (of `size` bytes each); targets ascend."""
    bounds = np.searchsorted(targets, np.arange(width + 1))
    rows = [
        (t, file, chunk, keys[a:b].tobytes(), flags[a:b].tobytes()) for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a
    ]
    for at in range(0, len(rows), 64):
        yield _batch(PROBES, rows[at : at + 64])


def block_keys(chunk: Chunk, width: int) -> np.ndarray:
    """The partition of every rolling window of BLOCK words, and 40 bits of its hash."""
    h = chunk.rolled(BLOCK, 0)
    return (h >> _LOW) % np.uint64(width) << _LOW | h & np.uint64((1 << 40) - 1)


def _probes(texts: Texts, column: str, width: int):
    """Tasks that send each chunk's rolling hashes once. Flags: 1 a reference block, 2 more than one place."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for number, chunk in enumerate(chunks(texts.rows(file, column))):
                    own = chunk.inside(BLOCK)
                    keys = block_keys(chunk, width)[own]
                    if not len(keys):
                        continue
                    order = np.argsort(keys)
                    keys = keys[order]
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    reference = np.logical_or.reduceat((chunk.place[: len(own)][own] % BLOCK == 0)[order], first)
                    flags = reference.astype(np.uint8) | (np.diff(np.append(first, len(keys))) > 1).astype(np.uint8) << 1
                    keys = keys[first]
                    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    yield from _sent(file, number, low, flags, (keys >> _LOW).astype(np.int64), width, 5)

    return send


def _met(batches: Iterator[pa.RecordBatch]) -> tuple[list[dict], np.ndarray]:
    blocks = [row for batch in batches for row in batch.to_pylist()]
    return blocks, np.concatenate([np.frombuffer(b["flags"], np.uint8) for b in blocks]) if blocks else np.zeros(0, np.uint8)


def _told(blocks: list[dict], hit: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of what was hit of each row that met."""
    at = 0
    for b in blocks:
        n = len(b["flags"])
        some = keys[at : at + n][hit[at : at + n]]
        at += n
        if len(some):
            yield _batch(FOUND, [(b["file"], b["chunk"], some.astype("<u8").tobytes())])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of reference blocks that have more than one place."""
    blocks, flags = _met(batches)
    if not blocks:
        return
    low = np.zeros((len(flags), 8), np.uint8)
    low[:, :5] = np.concatenate([np.frombuffer(b["hashes"], np.uint8) for b in blocks]).reshape(-1, 5)
    target = np.repeat(np.array([b["target"] for b in blocks], np.uint64), [len(b["flags"]) for b in blocks])
    keys = low.view("<u8").ravel() | target << _LOW
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    every = np.bitwise_or.reduceat(flags[order], first)
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat((every & 1 > 0) & ((sizes > 1) | (every & 2 > 0)), sizes)
    yield from _told(blocks, hit, keys)


def _by_chunk(batches: Iterator[pa.RecordBatch], texts: Texts, column: str) -> Iterator[tuple[int, int, Chunk, np.ndarray]]:
    """(file, number, chunk, hashes found in it) of the files in the batches, which are sorted by file and chunk.

    Only one chunk's hashes are held. A file with a row of chunk -1 has all its chunks, others end with
    their last hashes.
    """
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        file, whole = row["file"], row["chunk"] < 0
        if whole:
            row = next(rows, None)
        for number, chunk in enumerate(chunks(texts.rows(file, column))):
            found = []
            while row is not None and row["file"] == file and row["chunk"] == number:
                found.append(row["hashes"])
                row = next(rows, None)
            yield file, number, chunk, np.frombuffer(b"".join(found), "<u8")
            if not whole and (row is None or row["file"] != file):
                break
        if whole:
            yield file, -1, None, None  # its end


def _extensions(texts: Texts, column: str, width: int):
    """Tasks that send the windows of WINDOW words around hits, each once a chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, number, chunk, hits in _by_chunk(batches, texts, column):
            inside = chunk.inside(WINDOW)
            if not len(hits) or not inside.any():
                continue
            hits, keys = np.sort(hits), block_keys(chunk, width)
            hit = hits[np.minimum(np.searchsorted(hits, keys), len(hits) - 1)] == keys
            count = np.concatenate([[0], np.cumsum(hit)])
            reach = WINDOW - BLOCK + 1  # places of a block in a window
            around = np.flatnonzero(inside & (count[reach : reach + len(inside)] > count[: len(inside)]))
            if not len(around):
                continue
            a, b = (chunk.rolled(WINDOW, kind)[around] for kind in (0, 1))
            targets = a % np.uint64(width)
            order = np.lexsort((b, a, targets))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            flags = (np.diff(np.append(first, len(a))) > 1).astype(np.uint8)
            pairs = np.stack([a[first], b[first]], axis=1).astype("<u8")
            yield from _sent(file, number, pairs, flags, targets[order][first].astype(np.int64), width, 16)

    return send


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that are found twice or more."""
    blocks, flags = _met(batches)
    if not blocks:
        return
    pairs = np.concatenate([np.frombuffer(b["hashes"], "<u8") for b in blocks]).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    first = np.flatnonzero(np.concatenate([[True], (pairs[order][1:] != pairs[order][:-1]).any(axis=1)]))
    sizes = np.diff(np.append(first, len(pairs)))
    hit = np.zeros(len(pairs), bool)
    hit[order] = np.repeat((sizes > 1) | (np.bitwise_or.reduceat(flags[order], first) > 0), sizes)
    yield from _told(blocks, hit, pairs)


def among(pairs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which (a, b) are rows of pairs."""
    if not len(pairs):
        return np.zeros(len(a), bool)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    at = np.searchsorted(pairs[:, 0], a)
    last = np.searchsorted(pairs[:, 0], a, "right")
    out = np.zeros(len(a), bool)
    while (open_ := at < last).any():
        out[open_] |= pairs[at[open_], 1] == b[open_]
        at += 1
    return out


def _taken(chunk: Chunk, pairs: np.ndarray) -> np.ndarray:
    """Row, first word and end of each run of repeated windows of a chunk."""
    inside = np.flatnonzero(chunk.inside(WINDOW))
    if not len(inside) or not len(pairs):
        return np.zeros((0, 3), np.int64)
    some = inside[among(pairs, chunk.rolled(WINDOW, 0)[inside], chunk.rolled(WINDOW, 1)[inside])]
    if not len(some):
        return np.zeros((0, 3), np.int64)
    rows, starts = chunk.row[some], chunk.place[some]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(some) - 1)
    return np.stack([rows[new], starts[new], starts[last] + WINDOW], axis=1)


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words, and parts of what is left without words in the spans, which are disjoint and ascend."""
    n, kept = 0, []
    for part in parts_of(text):
        words = part.split()
        if len(starts):
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, np.clip(starts - n, 0, len(words)), 1)
            np.add.at(edges, np.clip(ends - n, 0, len(words)), -1)
            left = b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
        else:
            left = b" ".join(words)
        n += len(words)
        if left:
            kept.append(left)
    return n, kept


def deduplicated(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows of docs with `_n_words`, `_n_removed`, `_n_spans` (maximal runs of words that went) and `_kept`
    (the words left, joined by one space), by names that are free."""
    spark = docs.sparkSession
    texts = Texts.of(docs, "substring-texts")
    names = docs.columns
    schema = StructType([*docs.schema.fields])
    for name, kind in (("_n_words", "long"), ("_n_removed", "long"), ("_n_spans", "long"), ("_kept", "string")):
        while name.lower() in {x.lower() for x in schema.names}:
            name = f"_{name}"
        schema.add(name, kind)
    n_files = len(texts)
    if not n_files:
        return spark.createDataFrame([], schema)
    width = max(shuffle_width(spark), texts.size // MEETING_BYTES)
    hits = written(_every(spark, texts).mapInArrow(_probes(texts, column, width), PROBES).repartitionById(width, "target").mapInArrow(_hits, FOUND), "substring-hits")
    around = _in_order(hits, n_files).mapInArrow(_extensions(texts, column, width), PROBES)
    repeated = written(around.repartitionById(width, "target").mapInArrow(_repeated, FOUND), "substring-repeats")
    discard(spark, hits)
    whole = _every(spark, texts).select(F.col("id").cast("int").alias("file"), F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("hashes"))
    text_at = names.index(column)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = []
        for file, number, chunk, found in _by_chunk(batches, texts, column):
            if number >= 0:
                spans.append(_taken(chunk, found.reshape(-1, 2)))
                continue
            taken, base = np.concatenate([*spans, np.zeros((0, 3), np.int64)]), 0
            spans = []
            for batch in texts.batches(file):
                bounds = np.searchsorted(taken[:, 0], np.arange(base, base + len(batch) + 1))
                columns: list[list] = [[], [], [], []]
                for i, text in enumerate(batch.column(text_at)):
                    _, starts, ends = taken[bounds[i] : bounds[i + 1]].T
                    if len(starts):
                        starts, ends = unions(starts, ends)
                    n, kept = cut((text.as_py() or "").encode(), starts, ends)
                    for values, value in zip(columns, (n, int((ends - starts).sum()), len(starts), b" ".join(kept).decode())):
                        values.append(value)
                base += len(batch)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    return _in_order(repeated.unionByName(whole), n_files).mapInArrow(left, schema)


def _every(spark: SparkSession, texts: Texts) -> DataFrame:
    return texts.every_file(spark)


def _in_order(found: DataFrame, n_files: int) -> DataFrame:
    return found.repartitionById(n_files, "file").sortWithinPartitions("file", "chunk")
