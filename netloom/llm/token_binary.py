"""Operator 4: token ids in fixed-width bit-packed files.

A shard holds the ids of consecutive documents, each id in the fewest bits that hold the vocabulary:

    magic | blocks of BLOCK_IDS ids, packed little-endian | footer | footer length (8) | magic
    footer: 5 uint64 (bits, documents, ids, blocks, BLOCK_IDS), then int64 doc ids, uint8 doc-id
            validity, uint64 end of each document in ids, uint64 byte offset of each block

BLOCK_IDS is a multiple of 8, so every block starts at a byte: any block is found by its offset and
unpacked by numpy alone. Shards are numbered in ascending doc_id order. They are written under a
name of the attempt and then renamed, so a task that runs again replaces its own shards.

Defined results: null text counts as empty and has the end id only; null doc_ids come first;
repeated doc_ids follow each other in the order of their texts; an empty table gives no shards and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.shared import fresh_path, shuffle_width

MAGIC = b"NLIDPACK"
BLOCK_IDS = 8192
#: Documents' tables are held until a shard closes: at most so many documents and ids a shard.
SHARD_DOCS, SHARD_IDS = 1_000_000, 1 << 28
#: What a worker remembers at most: chunks, and their bytes.
KEPT_CHUNKS, KEPT_BYTES = 1_200_000, 64 << 20
MANIFEST = "shard string, documents long, ids long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first, padded to a whole byte."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    rows = np.zeros((n, 32), np.uint8)
    rows[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").reshape(n)


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.pending: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.ids)
        if self.held >= 64 * BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self.offsets.append(self.at)
            self._put(pack(ids[i : min(i + BLOCK_IDS, whole)], self.bits))
        self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        head = np.array([self.bits, len(self.doc_ids), self.ids, len(self.offsets), BLOCK_IDS], "<u8")
        footer = b"".join(
            (
                head.tobytes(),
                np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(),
                np.array([x is not None for x in self.doc_ids], np.uint8).tobytes(),
                np.array(self.ends, "<u8").tobytes(),
                np.array(self.offsets, "<u8").tobytes(),
            )
        )
        self._put(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Shard:
    """Random access to a shard through a file object that can seek."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of packed ids, or not whole")
        size = int.from_bytes(tail[:8], "little")
        self.footer_at = end - 16 - size
        file.seek(self.footer_at)
        footer = file.read(size)
        self.bits, docs, self.n_ids, blocks, self.block_ids = map(int, np.frombuffer(footer, "<u8", 5))
        at = 40
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.valid = np.frombuffer(footer, np.uint8, docs, at + 8 * docs).astype(bool)
        self.ends = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(footer, "<u8", blocks, at + 17 * docs).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard; reads their blocks only."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.offsets[first]))
        stop = self.footer_at if last + 1 == len(self.offsets) else int(self.offsets[last + 1])
        data = self.file.read(stop - int(self.offsets[first]))
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        return unpack(data, self.bits, n)[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self, per_read: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the shard and ids of each document; reads about per_read ids at a time."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k - 1]) if k else 0
            stop = max(k + 1, int(np.searchsorted(self.ends, start + per_read, "right")))
            held = self.ids(start, int(self.ends[stop - 1]))
            at = start
            for i in range(k, stop):
                end = int(self.ends[i])
                yield (int(self.doc_ids[i]) if self.valid[i] else None), at, held[at - start : end - start]
                at = end
            k = stop


#: A full stop or comma between a letter or digit and white space or the end.
_STOP = re.compile(rb"(?<=[a-z0-9])[.,](?![^\x20\x09-\x0D])")
#: Marks that an ASCII character may be composed with.
_MARKS = re.compile("[\u0300-\u036f]")


def plain(text: str, added: tuple[bytes, ...] = ()) -> bytes:
    """The text with ASCII letters in lower case and stops after words set apart: the tokenizer sees
    the same words, and there are fewer different chunks. Texts with combining marks stay as they
    are, since those may compose with one case only; so do chunks with an added token in any case
    (added, in lower case), which the tokenizer finds in one case only."""
    data = text.encode()
    if not text.isascii() and _MARKS.search(text):
        return data
    lower = data.lower()
    if any(a in lower for a in added):
        return b" ".join(c if any(a in c.lower() for a in added) else _STOP.sub(rb" \g<0>", c.lower()) for c in data.split())
    return _STOP.sub(rb" \g<0>", lower)


class Chunks(dict):
    """Numbers of chunks, what stands between ASCII white space, and their ids in one array; kept within bounds.

    Encoding chunk by chunk equals encoding the whole text only for tokenizers that turn to lower
    case and drop white space before they split, that part letters and digits from other characters,
    and whose splits and normal forms never cross white space.

    New chunks are encoded together. Words of Latin letters go GROUP to a text, since each ends in
    its only token that ends a word; a group where this doesn't add up is encoded chunk by chunk.
    """

    GROUP = 64

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.added = tuple(t.content.encode().lower() for t in tokenizer.get_added_tokens_decoder().values())
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.held = self.size = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the new chunks, whose numbers follow the known ones'."""
        texts = [x.decode() for x in self.new]
        first = len(self) - len(texts)
        word = [x.isalpha() and (y or max(x) < "\u0250") for x, y in zip(texts, (c.isascii() for c in self.new))]
        words = [k for k, w in enumerate(word) if w]
        alone = [k for k, w in enumerate(word) if not w]
        groups = [words[i : i + self.GROUP] for i in range(0, len(words), self.GROUP)]
        found: dict[int, np.ndarray] = {}
        for group, ids in zip(groups, self._encode([" ".join([texts[k] for k in g]) for g in groups])):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                alone += group
                continue
            self._put(first + np.array(group), np.diff(ends, prepend=0), ids)
        for k, ids in zip(alone, self._encode([texts[k] for k in alone])):
            found[k] = np.array(ids, np.uint32)
        if found:
            self._put(first + np.array(list(found)), np.array([len(x) for x in found.values()]), np.concatenate([*found.values(), np.zeros(0, np.uint32)]))
        self.held += sum(map(len, self.new))
        self.new = []

    def _put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(len(self), np.int64)]) for x in (self.starts, self.sizes))
        if self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.starts[numbers] = self.size + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.size += len(ids)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > KEPT_CHUNKS or self.held > KEPT_BYTES or self.size > KEPT_BYTES // 4:
            self.forget()
        number = self.__getitem__
        numbers = [np.fromiter(map(number, x), np.int64, len(x)) for x in (plain(text, self.added).split() for text in texts)]
        if self.new:
            self._learn()
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[every] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) for x in numbers)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_tokenizers: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """This worker's tokenizer: loaded once, with what it remembers."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers.clear()
        _tokenizers[path] = Chunks(Tokenizer.from_file(path))
    return _tokenizers[path]


def vocabulary_bits(path: str, *more_ids: int) -> int:
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(path).get_vocab_size() - 1, *more_ids).bit_length())


def write_packed(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> list:
    """Encodes documents and writes shards under `path`; rows (shard, documents, ids) in shard order.

    The manifest has one row a shard, of which there are as many as shuffle partitions or a few more.
    """
    bits = vocabulary_bits(tokenizer_path, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = chunks(tokenizer_path), TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        end = np.array([end_id], "<u4")
        done, writer, part = [], None, ""

        def close() -> None:
            writer.close()
            name = f"shard-{task.partitionId():06d}-{len(done):04d}.ids"
            store.move(part, f"{root}/{name}")
            done.append((name, len(writer.doc_ids), writer.ids))

        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(batch), 200):
                encoded = own.of([t.as_py() or "" for t in texts[at : at + 200]])
                for doc_id, ids in zip(doc_ids[at : at + 200].to_pylist(), encoded):
                    if writer is None:
                        part = f"{root}/_attempts/{task.taskAttemptId()}-{len(done)}"
                        writer = ShardWriter(store.open_output_stream(part), bits)
                    writer.add(doc_id, np.concatenate([ids, end]))
                    if len(writer.doc_ids) >= SHARD_DOCS or writer.ids >= SHARD_IDS:
                        close()
                        writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["shard", "documents", "ids"],
        )

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(f"{root}/_attempts", recursive=True)
    ordered = (
        docs.selectExpr("cast(doc_id as long) doc_id", "text")
        .repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return sorted(ordered.mapInArrow(write, MANIFEST).collect())


def read_packed(spark: SparkSession, path: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)

        def out(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for name, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                with store.open_input_file(f"{root}/{name}") as file:
                    rows, held = [], 0
                    for doc_id, start, ids in Shard(file).documents():
                        rows.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held > 1 << 20 or len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    bases, base = [], 0
    for shard, _, n in manifest:
        bases.append((shard, base))
        base += n
    shards = spark.createDataFrame(bases, "shard string, base long")
    # one shard a task: dealt by position, as there are no more rows than shards
    return shards.repartition(max(1, len(bases)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes documents to packed shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    return read_packed(spark, path, write_packed(docs, tokenizer_path, end_id, path))
