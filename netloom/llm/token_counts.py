"""Operator 6: token counts of sections, by offsets of whole documents.

A document's fields are joined by a newline and encoded once, by the tables of `byte_bpe`, whose time and
stack don't hang on the length of a run of white space or letters (a library that matches the split
pattern by recursion ends the worker on a million spaces). The ids give each token's span of bytes, and
so of characters. Spans of tokens are joined with the spans of sections, which are ordered and
cover the text, by searching the section bounds. A token that crosses a bound is allocated by RULES:

    first  to the section of its first character
    last   to the section of its last character
    most   to the section with most of its characters, the first of several
    split  to every section in proportion to its characters

A token that begins or ends within a character has that character. Sections are the lines of each
field, with their newline, so every character lies in one section, and the counts of a document add
up to its tokens.

Defined results: a null or empty field is one section without characters and tokens (the newline
after a field that isn't the last belongs to its last line); repeated rows are counted each; null
doc_ids are kept; an empty table gives an empty result; other columns are ignored. Runs of white space
of any length, alone or inside text, give the tokens of the definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.byte_bpe import codec

RULES = ("first", "last", "most", "split")
#: Rows of a batch, about.
ROWS = 200_000
SCHEMA = "doc_id long, field string, section int, start_char long, n_chars long, n_tokens double, n_crossing long"


class Attribution:
    def __init__(self, ranks_path: str, pattern: str, rule: str):
        if rule not in RULES:
            raise ValueError(f"rule is one of {RULES}")
        self.codec = codec(ranks_path, pattern)
        self.lengths = np.array(self.codec.vocabulary.sizes, np.int64)
        self.rule = rule

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(ids, "<u4") for ids in self.codec.encode(texts)]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First character and the one after the last of every token."""
        ends = np.cumsum(self.lengths[ids])
        if text.isascii():
            return np.stack([ends - self.lengths[ids], ends])
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        return np.stack([char[ends - self.lengths[ids]], char[ends - 1] + 1])

    def counts(self, text: str, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each section, and how many of them also lie in another. bounds: sections' starts, ascending."""
        starts, ends = self.spans(text, ids)
        n = len(bounds)
        # of sections that start at the same character only the last has any
        a = np.searchsorted(bounds, starts, "right") - 1
        b = np.searchsorted(bounds, ends - 1, "right") - 1
        crossing = np.flatnonzero(a != b)
        to = (b if self.rule == "last" else a).copy()
        if self.rule in ("first", "last") or not len(crossing):
            return np.bincount(to, minlength=n).astype(float), np.bincount(to[crossing], minlength=n)
        out = np.bincount(a[a == b], minlength=n).astype(float)
        crossed = np.zeros(n, np.int64)
        edges = np.append(bounds, len(text))
        for t in crossing:
            k = np.arange(a[t], b[t] + 1)
            chars = np.minimum(edges[k + 1], ends[t]) - np.maximum(edges[k], starts[t])
            if self.rule == "split":
                out[k] += chars / (ends[t] - starts[t])
                crossed[k] += chars > 0
            else:
                out[k[np.argmax(chars)]] += 1
                crossed[k[np.argmax(chars)]] += 1
        return out, crossed


def line_starts(value: str) -> np.ndarray:
    """The first character of each line."""
    data = np.frombuffer(value.encode(), np.uint8)
    ends = np.flatnonzero(data == 10)
    if not value.isascii():
        ends = ends - np.cumsum((data & 0xC0) == 0x80)[ends]
    return np.concatenate([[0], ends + 1])


def attributed(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "first") -> DataFrame:
    """A row for each section of each field: doc_id, field, section, start_char (within the document's
    joined fields), n_chars, n_tokens and n_crossing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = Attribution(ranks_path, pattern, rule), pa.array(fields)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())

        def batch_of(held: list[list]) -> pa.RecordBatch:
            doc_ids, sizes, *columns = zip(*held)
            doc_id = pa.array(doc_ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            field, *numbers = (pa.array(np.concatenate(c)) for c in columns)
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip([doc_id, names.take(field), *numbers], kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), 200):
                doc_ids, *parts = (c.to_pylist() for c in batch.slice(at, 200).columns)
                texts = ["\n".join(v or "" for v in values) for values in zip(*parts)]
                held, n_rows = [], 0
                for doc_id, text, ids, *values in zip(doc_ids, texts, own.encode(texts), *parts):
                    starts, begin = [], 0
                    for value in values:  # the newline after a field ends its last line
                        starts.append(begin + line_starts(value or ""))
                        begin += len(value or "") + 1
                    bounds, n_lines = np.concatenate(starts), [len(x) for x in starts]
                    n, crossed = own.counts(text, ids, bounds)
                    number = np.concatenate([np.arange(k) for k in n_lines])
                    held.append([doc_id, len(bounds), np.repeat(np.arange(len(fields)), n_lines), number, bounds, np.diff(np.append(bounds, len(text))), n, crossed])
                    n_rows += len(bounds)
                    if n_rows > ROWS:
                        yield batch_of(held)
                        held, n_rows = [], 0
                if held:
                    yield batch_of(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *fields).mapInArrow(count, SCHEMA)
