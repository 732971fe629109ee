"""Operator 10: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text exactly one token can come last in the prefix's encoding. That
token is found from earlier prefixes: a token that ends the prefix and may follow the last token of
what is left. The tokens that end a prefix come from one automaton over the vocabulary. Two tokens may
follow each other if no merge across their border comes before the merges that its neighbours go into,
which the trees of both tokens' merges tell. An encoding is read off from the end, an append continues
the table, and an edit recomputes it only until it agrees with the old one over the longest token's
length. Pieces are encoded in sorted order, so a piece continues the table of the prefix that it shares
with the one before.

Each match of the split pattern is a piece of its own. A piece that is a token as a whole is that
token. Tokens that merging their own bytes would not give back never come from the table.

Defined results: null text counts as empty; empty text has no tokens; repeated rows are encoded
each; an empty table gives an empty result; other columns are ignored. Long texts are split and encoded
in groups of GROUP pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from netloom.llm.shared import common, remember

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
#: Bounds of a worker's memory: pieces and token pairs of a generation that it remembers, and the longest piece kept.
KEPT_PIECES, KEPT_PAIRS, KEPT_BYTES = 250_000, 250_000, 64
#: Characters and number of texts that are encoded together, and pieces of a longer text.
TOGETHER, TEXTS, GROUP = 4 << 20, 1200, 100_000
_NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.sizes = list(map(len, self.bytes_of))
        self.coded = [rank.to_bytes(4, "little") for rank in range(len(self.bytes_of))]
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.older_pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, ...] | None] = {}
        self._in_order: dict[int, bool] = {}

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The encoding of a short byte string by its definition, until `least` parts are left: the lowest rank merges first, leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            found = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == _NEVER:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, ...] | None:
        """The two tokens that merge into it last, () for a byte, None if merging its bytes doesn't give it."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = tuple(self.merged(data, 2)) if len(data) > 1 else ()
            self._halves[token] = parts if len(parts) in (0, 2) else None
        return self._halves[token]

    def in_order(self, token: int) -> bool:
        """Whether the token is merged after its parts, and they after theirs."""
        known = self._in_order.get(token)
        if known is None:
            own = self.halves(token)
            known = own is not None and all((x < token or len(self.bytes_of[x]) == 1) and self.in_order(x) for x in own)
            self._in_order[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives the two tokens back."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.older_pairs, self.pairs = self.pairs, {}
            known = self.older_pairs.get(key)
            if known is None:
                known = self._stay_apart(left, right)
            self.pairs[key] = known
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undoes the merges of both tokens from the last on. Of two neighbours at the border, a and b, a
        goes into a merge of rank a_until and b into one of b_until; theirs comes first if its rank is
        lower, and as the one further left at equal rank to b's."""
        if not (self.in_order(left) and self.in_order(right)):
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a, b, a_until, b_until = left, right, _NEVER, _NEVER
        while True:
            rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)
            if rank < a_until and rank <= b_until:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (a > b or not of_b):
                a, a_until = of_a[1], a
            elif of_b:
                b, b_until = of_b[0], b
            else:
                return True


class Prefixes:
    """The table of one piece: last[i] is the last token of the encoding of its first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _extend(self, data: bytes, last: list[int], done: Callable[[], bool] | None = None) -> None:
        """Adds the entries of the prefixes of data that are longer than the table, until done says so."""
        v = self.vocabulary
        known, n = v.pairs.get, len(last)
        for end, (token, size) in v.ending.iter(data.decode("latin-1"), max(0, n - v.longest + 1)):
            if end != n:
                if end < n:  # a table entry, or found by a longer token
                    continue
                break
            if size <= end:
                before = last[end - size]
                fits = known(before << 32 | token)
                if not (v.may_follow(before, token) if fits is None else fits):
                    continue
            elif v.halves(token) is None:
                continue
            last.append(token)
            n += 1
            if done is not None and done():
                return
        if n < len(data):
            raise ValueError(f"byte {data[n]} is in no token")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(self.data, self.last)

    def become(self, data: bytes) -> None:
        """The table of other bytes, continued from the prefix that they share with the present ones."""
        del self.last[common(self.data, data, 0) :]
        self.data = data
        self._extend(data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in place of bytes start to end; how many entries were computed anew."""
        old, tail = self.last, self.data[end:]
        data = self.data[:start] + new + tail
        last, agreed = old[:start], 0

        def agrees() -> bool:
            nonlocal agreed
            at = len(last) - start - len(new)  # bytes of the tail so far
            agreed = agreed + 1 if at > 0 and last[-1] == old[end + at - 1] else 0
            return agreed >= self.vocabulary.longest

        if len(last) < len(data):
            self._extend(data, last, agrees)
        done = len(last) - start
        last += old[end + len(last) - start - len(new) :] if len(last) < len(data) else []
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        out, last, end, sizes = [], self.last, len(self.last), self.vocabulary.sizes
        while end:
            out.append(token := last[end - 1])
            end -= sizes[token]
        out.reverse()
        return out


class Pieces(dict):
    """Encodings of pieces, as little-endian 32-bit ids, made on demand and kept for two generations."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.table = Prefixes(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data, v = piece.encode(), self.vocabulary
            token = v.ranks.get(data)
            if token is not None:
                out = v.coded[token]
            else:
                self.table.become(data)
                out = b"".join(map(v.coded.__getitem__, self.table.ids()))
            if len(data) > KEPT_BYTES:
                return out
        self[piece] = out
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes those not known yet, in sorted order."""
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        for piece in sorted(set(pieces).difference(self)):
            self[piece]


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(ranks_path))
        self.pieces = Pieces(self.vocabulary)
        self.split = regex.compile(pattern)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if sum(map(len, texts)) > TOGETHER:
            if len(texts) == 1:
                return [self._long(texts[0])]
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        split = [self.split.findall(t) for t in texts]
        self.pieces.learn(chain.from_iterable(split))
        return [b"".join(map(self.pieces.__getitem__, own)) for own in split]

    def _long(self, text: str) -> bytes:
        out = []
        for group in batched(self.split.finditer(text), GROUP):
            own = [m[0] for m in group]
            self.pieces.learn(own)
            out += map(self.pieces.__getitem__, own)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """This worker's codec: loaded once, with what it remembers."""
    remember("byte_bpe", _codecs.clear)
    if (ranks_path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the SHA-256 of the bytes decoded from them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(batch), TEXTS):
                ids = own.encode([t or "" for t in texts[at : at + TEXTS].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[at : at + TEXTS],
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, SCHEMA)
