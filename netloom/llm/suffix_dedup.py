"""Operator 9: removal of repeated byte strings by a distributed sort of sparse suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere. Sorting suffixes brings
such strings together. Not every suffix is sorted: of the first WINDOW positions of every string of
LENGTH bytes, the one with the least hash of its next GRAM bytes is an anchor. The choice depends on
the string alone, so equal strings have their anchors at equal offsets, and two strings that share an
anchor `o` bytes from their starts are equal if the bytes before it agree for `o` and those from it
for LENGTH - o.

1. Tasks find the anchors of their documents. The CORE bytes from an anchor lie in every string that
   it stands for. Anchors whose core has no equal anywhere are dropped, by counting hashes; a hash
   that occurs often in a file is sent once.
2. Tasks sort the suffixes at the anchors left (LENGTH bytes, then the bytes before, backwards) in runs
   of SORTED at most, cut them by splitters that never part equal cores, and exchange the runs
   front-coded: each string is the length of its common prefix with the one before, and the rest. There
   are as many ranges as keep one at about RANGE_BYTES; beyond RANGES splitters, a range is parted by a
   hash of the core.
3. A task merges the runs of its range, FAN at a time, with a loser tree that knows the common prefixes
   of its contenders with the last string put out, and compares only what follows. The merge gives the
   lengths of common prefixes of neighbours, which tell for every offset o which suffixes have a
   partner. Equal strings are one entry with all their places.
4. Tasks cut the spans found out of their documents.

The hashes only choose candidates; what is removed rests on compared bytes. Documents are kept in a
table in the shared folder and read there by the tasks, so texts aren't shuffled.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; exact copies of
LENGTH bytes or more lose everything, the first one too; repeated rows are copies of each other;
columns other than text are handed on, whatever their names: where docs has one of the names of the
columns added, that one gets further underscores in front; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.llm.kept_texts import Texts
from netloom.llm.shared import common, discard, remember, shuffle_width, written

LENGTH, WINDOW, GRAM = 200, 64, 16
CORE = LENGTH - WINDOW + 1
#: Bytes of text that are hashed at a time, and anchors of a file that are held at a time.
SEGMENT, HELD = 1 << 20, 1 << 22
#: Suffixes sampled for splitters, about: so many, and so many a range.
SAMPLE, PER_RANGE = 20_000, 16
#: Suffixes of a run, bytes of suffixes in a range, ranges by splitters, and runs merged at a time.
SORTED, RANGE_BYTES, RANGES, FAN = 100_000, 16 << 20, 1 << 16, 512
#: Bytes of the table of texts for each task that counts hashes.
MEETING_BYTES = 128 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_M = np.uint64(_MULTIPLIER)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position that has so many."""
    h, power, size = data.astype(np.uint64) + np.uint64(1), _M, 1
    while size < GRAM:
        h = h[:-size] * power + h[size:]
        power, size = power * power, 2 * size
    return mixed(h)


class Powers:
    """Powers of the multiplier and their inverses modulo 2^64, for hashes of substrings."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _M, np.uint64))])
            inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64))])

    def of(self, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        return mixed((sums[starts + length] - sums[starts]) * self.down[starts])


_powers: list[Powers] = []


def forget() -> None:
    """Forgets the worker's powers."""
    _powers.clear()


def powers(n: int) -> Powers:
    if not _powers or len(_powers[0].up) <= n:
        _powers[:] = [Powers(max(n, SEGMENT * 2))]
    return _powers[0]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in joined texts, and hashes of their cores. No string crosses the texts' bounds."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        inside = np.zeros(len(least) + 1, np.int32)  # +1 where a text's strings start, -1 after the last
        long = ends - starts >= LENGTH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        chosen = (least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(chosen):
            return none
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        return chosen, powers(len(data)).of(data, chosen, CORE)


def segments(rows: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about SEGMENT bytes; long texts come in parts that overlap."""
    held, size = [], 0
    for row, text in rows:
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, SEGMENT):
            part = text if len(text) <= SEGMENT else text[at : at + SEGMENT + LENGTH - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
            if part is text:
                break
    if held:
        yield held


class Run:
    """A front-coded sorted run, decoded one string at a time: bytes, common prefix with the one before."""

    def __init__(self, lcps: bytes, sizes: bytes, tails: bytes):
        self.lcps, self.sizes, self.tails = np.frombuffer(lcps, "<u2"), np.frombuffer(sizes, "<u2"), tails

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        at, last = 0, b""
        for lcp, size in zip(self.lcps.tolist(), self.sizes.tolist()):
            last = last[:lcp] + self.tails[at : at + size]
            at += size
            yield last, lcp


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    lcps, tails, last = [], [], b""
    for s in strings:
        lcps.append(common(last, s, 0))
        tails.append(s[lcps[-1] :])
        last = s
    return np.array(lcps, "<u2").tobytes(), np.array([len(x) for x in tails], "<u2").tobytes(), b"".join(tails)


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(string, common prefix with the one before, run) in ascending order.

    shared[i] is the common prefix of run i's string with the last one put out, or with the winner it
    lost to. Of two contenders the one with more in common comes first; only at a tie are bytes
    compared, from there on. The next string of the winner's run has its common prefix from the coding.
    """
    k = 1
    while k < len(runs):
        k *= 2
    steps = [iter(r).__next__ for r in runs]
    now: list[bytes] = [b""] * k
    shared = [-1] * k  # -1: at its end
    for i, step in enumerate(steps):
        try:
            now[i], shared[i] = step()[0], 0
        except StopIteration:
            pass
    tree = [0] * (2 * k)  # losers; tree[0]: the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        ha, hb = shared[a], shared[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = now[a], now[b]
        h = common(x, y, ha)
        if y[h : h + 1] < x[h : h + 1]:
            shared[a] = h
            return b, a
        shared[b] = h
        return a, b

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while runs and shared[best] >= 0:
        yield now[best], shared[best], best
        try:
            now[best], shared[best] = steps[best]()
        except StopIteration:
            now[best], shared[best] = b"", -1
        node = best + k >> 1
        while node:
            other = tree[node]
            hb, ho = shared[best], shared[other]
            if ho > hb:
                tree[node], best = best, other
            elif ho == hb and hb >= 0:
                best, tree[node] = play(best, other)
            node >>= 1


def merged_entries(runs: list[Run], fan: int = FAN) -> Iterator[tuple[bytes, int, int]]:
    """(string, common prefix with the one before, entry) in ascending order; entries are numbered run after run.

    More than `fan` runs are merged in passes, of which each leaves a front-coded run of a group.
    """
    ends = np.cumsum([len(r.lcps) for r in runs], dtype=np.int64)
    entries = [np.arange(end - len(r.lcps), end) for r, end in zip(runs, ends)]
    while len(runs) > fan:
        groups = [(runs[at : at + fan], entries[at : at + fan]) for at in range(0, len(runs), fan)]
        runs, entries = [], []
        for own, numbers in groups:
            lcps, tails, order = [], [], []
            for string, lcp, entry in _numbered(own, numbers):
                lcps.append(lcp)
                tails.append(string[lcp:])
                order.append(entry)
            runs.append(Run(np.array(lcps, "<u2").tobytes(), np.array([len(x) for x in tails], "<u2").tobytes(), b"".join(tails)))
            entries.append(np.array(order, np.int64))
    yield from _numbered(runs, entries)


def _numbered(runs: list[Run], entries: list[np.ndarray]) -> Iterator[tuple[bytes, int, int]]:
    at = [iter(x.tolist()).__next__ for x in entries]
    for string, lcp, run in merged(runs):
        yield string, lcp, at[run]()


def partners(lcps: np.ndarray, sizes: np.ndarray, lefts: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset o (or LENGTH, -1) at which each sorted suffix is in a repeated string.

    lcps: common prefix with the suffix before; sizes: bytes from the anchor; lefts: bytes before it,
    backwards; copies: places of the suffix. o fits if another suffix, or another place of this one,
    has LENGTH - o bytes from the anchor and o bytes before it in common.
    """
    n = len(lcps)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    room = np.array([len(x) for x in lefts], np.int64)
    order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    padded = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in lefts), np.uint8).reshape(n, WINDOW)[order]
    apart = padded[1:] != padded[:-1]
    left_lcps = np.zeros(n, np.int64)
    left_lcps[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), WINDOW)
    left_lcps[1:] = np.minimum(left_lcps[1:], np.minimum(room[order][1:], room[order][:-1]))
    near = np.maximum(lcps, np.append(lcps[1:], 0))
    near_left = np.empty(n, np.int64)
    near_left[order] = np.maximum(left_lcps, np.append(left_lcps[1:], 0))
    several = copies > 1
    for o in range(WINDOW):
        fits = (sizes >= LENGTH - o) & (room >= o)
        hit = fits & several
        some = np.flatnonzero(fits & (near >= LENGTH - o) & (near_left >= o))
        if len(some):
            right_class = np.cumsum(lcps < LENGTH - o)[some]
            left_class = np.empty(n, np.int64)
            left_class[order] = np.cumsum(left_lcps < o) if o else 0
            both = right_class * (n + 1) + left_class[some]
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            shared = np.zeros(len(some), bool)
            shared[by[1:][same]] = True
            shared[by[:-1][same]] = True
            hit[some[shared]] = True
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    return least, most


def _u4(x) -> bytes:
    return np.asarray(x).astype("<u4").tobytes()


def _read(x: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(x, kind)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


PLACES = "file int, rows binary, places binary"
HASHES = "target int, file int, hashes binary, often binary, rows binary, places binary"
RUNS = "target int, lcps binary, lengths binary, tails binary, sizes binary, copies binary, file int, rows binary, places binary"
SPANS = "file int, rows binary, starts binary, ends binary"


def _candidates(spark: SparkSession, texts: Texts, column: str, width: int) -> DataFrame:
    """Places of anchors whose core hash occurs twice or more."""
    n_files = len(texts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("suffix_dedup", forget)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held: list[tuple] = []

                def flush() -> Iterator[pa.RecordBatch]:
                    hashes, rows, places = (np.concatenate(x) for x in zip(*held))
                    held.clear()
                    _, first, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                    often = count[group] > 1
                    out = []
                    # known to occur here more than once: their places go on as they are, their hashes once
                    known = np.flatnonzero(often)
                    for at in range(0, len(known), 1 << 16):
                        some = known[at : at + (1 << 16)]
                        out.append(((file + at) % width, file, b"", b"", _u4(rows[some]), _u4(places[some])))
                    targets = (hashes[first] % np.uint64(width)).astype(np.int64)
                    order = np.argsort(targets, kind="stable")
                    bounds = np.searchsorted(targets[order], np.arange(width + 1))
                    for target in range(width):
                        at = first[np.sort(order[bounds[target] : bounds[target + 1]])]
                        if len(at):
                            out.append((target, file, hashes[at].astype("<u8").tobytes(), often[at].tobytes(), _u4(rows[at]), _u4(places[at])))
                    for at in range(0, len(out), 64):
                        yield _batch(HASHES, out[at : at + 64])

                last = (-1, -1)
                for parts in segments(texts.rows(file, column)):
                    sizes = np.array([len(p) for _, _, p in parts])
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    at, hashes = anchors(np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), starts, ends)
                    part = np.searchsorted(ends, at, "right")
                    rows = np.array([r for r, _, _ in parts])[part] if len(at) else at
                    places = at - starts[part] + np.array([o for _, o, _ in parts])[part] if len(at) else at
                    # the parts of a long text may share an anchor
                    new = (rows != last[0]) | (places > last[1])
                    if len(parts) > 1 and len(at):
                        new[1:] &= (rows[1:] != rows[:-1]) | (places[1:] > places[:-1])
                    if new.any():
                        held.append((hashes[new], rows[new], places[new]))
                        last = (int(rows[new][-1]), int(places[new][-1]))
                    if sum(len(x[0]) for x in held) >= HELD:
                        yield from flush()
                if held:
                    yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["hashes"]:
                    blocks.append(row)
                else:
                    yield _batch(PLACES, [(row["file"], row["rows"], row["places"])])
        if not blocks:
            return
        hashes = np.concatenate([_read(b["hashes"], "<u8") for b in blocks])
        often = np.concatenate([_read(b["often"], np.bool_) for b in blocks])
        rows, places = (np.concatenate([_read(b[c]) for b in blocks]) for c in ("rows", "places"))
        files = np.repeat([b["file"] for b in blocks], [len(b["often"]) for b in blocks])
        _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
        wanted = np.flatnonzero((count[group] > 1) & ~often)
        by_file = wanted[np.argsort(files[wanted], kind="stable")]
        cuts = np.flatnonzero(np.diff(files[by_file])) + 1
        for some in np.split(by_file, cuts):
            if len(some):
                yield _batch(PLACES, [(int(files[some[0]]), _u4(rows[some]), _u4(places[some]))])

    found = spark.range(0, n_files, 1, max(1, n_files)).mapInArrow(find, HASHES)
    return written(found.repartitionById(width, "target").mapInArrow(meet, PLACES), "suffix-places")


def _by_file(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> dict[int, list[np.ndarray]]:
    """Arrays of each file, sorted by row."""
    held = defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            held[row["file"]].append([_read(row[n]) for n in names if row[n] is not None])
    out = {}
    for file, parts in held.items():
        parts = [p for p in parts if p]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32) for k in range(len(names))]
        order = np.lexsort((columns[1], columns[0]))
        out[file] = [c[order] for c in columns]
    return out


def _suffixes(texts: Texts, column: str, file: int, rows: np.ndarray, places: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
    """(suffix and what is before it, bytes from the anchor, row, place) of the places of a file."""
    at, n = 0, len(rows)
    for row, text in texts.rows(file, column):
        if at == n:
            return
        while at < n and rows[at] == row:
            p = int(places[at])
            right = text[p : p + LENGTH]
            yield right.ljust(LENGTH, b"\0") + text[max(0, p - WINDOW + 1) : p][::-1], len(right), row, p
            at += 1


def _splitters(candidates: DataFrame, texts: Texts, column: str, width: int) -> tuple[list[bytes], int]:
    """Cores between the ranges, from a bounded sample of suffixes, as many from every part of the corpus; and
    into how many parts each range is split by a hash of the core."""
    total = candidates.agg(F.coalesce(F.sum(F.octet_length("rows")), F.lit(0))).first()[0] // 4
    wanted = max(width, total * (LENGTH + WINDOW) // RANGE_BYTES)
    ranges = min(wanted, max(width, RANGES))
    rate = max(1, total // max(SAMPLE, PER_RANGE * ranges))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, (rows, places) in _by_file(batches, ("rows", "places")).items():
            some = mixed(rows.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64)) % np.uint64(rate) == 0
            keys = sorted(s[:CORE] for s, _, _, _ in _suffixes(texts, column, file, rows[some], places[some]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    n_files = max(1, len(texts))
    keys = sorted(r[0] for r in candidates.repartitionById(n_files, "file").mapInArrow(sample, "key binary").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else [], -(-wanted // ranges)


def _spans(candidates: DataFrame, texts: Texts, column: str, width: int) -> DataFrame:
    """Spans of the files' rows that lie in repeated strings."""
    cores, parts = _splitters(candidates, texts, column, width)
    n_files = max(1, len(texts))

    def coded(items: list[tuple[bytes, int, int, int]], target: int, file: int) -> pa.RecordBatch:
        strings, sizes, copies = [], [], []
        for key, size, _, _ in items:
            if strings and strings[-1] == key and sizes[-1] == size:
                copies[-1] += 1
            else:
                strings.append(key)
                sizes.append(size)
                copies.append(1)
        return _batch(RUNS, [(target, *front_coded(strings), bytes(sizes), _u4(copies), file, _u4([x[2] for x in items]), _u4([x[3] for x in items]))])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, (rows, places) in _by_file(batches, ("rows", "places")).items():
            for run in batched(_suffixes(texts, column, file, rows, places), SORTED):
                items, at = sorted(run), 0
                while at < len(items):
                    target = bisect_right(cores, items[at][0][:CORE])
                    end = bisect_left(items, cores[target], at, key=lambda x: x[0][:CORE]) if target < len(cores) else len(items)
                    if parts == 1:
                        yield coded(items[at:end], target, file)
                    else:
                        split = defaultdict(list)
                        for x in items[at:end]:
                            split[crc32(x[0][:CORE]) % parts].append(x)
                        for part, own in split.items():
                            yield coded(own, target * parts + part, file)
                    at = end

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_target = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                by_target[row["target"]].append(row)
        for blocks in by_target.values():
            runs = [Run(b["lcps"], b["lengths"], b["tails"]) for b in blocks]
            own_sizes = b"".join(b["sizes"] for b in blocks)
            own_copies = np.concatenate([_read(b["copies"]) for b in blocks]).astype(np.int64)
            lcps, sizes, lefts, merged_to = [], [], [], np.zeros(len(own_copies), np.int64)
            last = b""
            for string, lcp, k in merged_entries(runs):
                size = own_sizes[k]
                if not (lcps and lcp == len(string) == len(last) and size == sizes[-1]):
                    lcps.append(lcp)
                    sizes.append(size)
                    lefts.append(string[LENGTH:])
                    last = string
                merged_to[k] = len(lcps) - 1
            entries = np.repeat(merged_to, own_copies)
            n = len(lcps)
            least, most = partners(np.array(lcps, np.int64), np.array(sizes, np.int64), lefts, np.bincount(entries, minlength=n))
            rows, places = (np.concatenate([_read(b[c]) for b in blocks]).astype(np.int64) for c in ("rows", "places"))
            files = np.repeat([b["file"] for b in blocks], [len(b["rows"]) // 4 for b in blocks])
            found = np.flatnonzero(most[entries] >= 0)
            found = found[np.argsort(files[found], kind="stable")]
            starts = places[found] - most[entries[found]]
            ends = places[found] - least[entries[found]] + LENGTH
            cuts = np.flatnonzero(np.diff(files[found])) + 1
            for some in np.split(np.arange(len(found)), cuts):
                if len(some):
                    yield _batch(SPANS, [(int(files[found[some[0]]]), _u4(rows[found[some]]), _u4(starts[some]), _u4(ends[some]))])

    runs = candidates.repartitionById(n_files, "file").mapInArrow(sort, RUNS)
    return written(runs.repartitionById((len(cores) + 1) * parts, "target").mapInArrow(merge, SPANS), "suffix-spans")


def unions(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, not touching, that cover the same; starts ascend."""
    reach = np.maximum.accumulate(ends)
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)]


def deduplicated(docs: DataFrame, column: str = "text", replace: bool = False) -> DataFrame:
    """The rows of docs with `_n_bytes`, `_n_removed`, `_n_spans` and `_kept` (the bytes left, joined), by names that are free.

    With `replace` the rows have no more columns, but the text becomes what is left of it, without
    characters that lost a byte; a null text stays null.
    """
    spark = docs.sparkSession
    texts = Texts.of(docs, "suffix-texts")
    width = max(shuffle_width(spark), texts.size // MEETING_BYTES)
    names = docs.columns
    schema = StructType([*docs.schema.fields])
    if not replace:
        for name, kind in (("_n_bytes", "long"), ("_n_removed", "long"), ("_n_spans", "long"), ("_kept", "binary")):
            while name.lower() in {x.lower() for x in schema.names}:
                name = f"_{name}"
            schema.add(name, kind)
    n_files = len(texts)
    if not n_files:
        return spark.createDataFrame([], schema)
    candidates = _candidates(spark, texts, column, width)
    spans = _spans(candidates, texts, column, width)
    discard(spark, candidates)
    every = spark.range(0, n_files, 1, n_files).select(
        F.col("id").cast("int").alias("file"), *[F.lit(None).cast("binary").alias(c) for c in ("rows", "starts", "ends")]
    )
    text_at = names.index(column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, (rows, starts, ends) in _by_file(batches, ("rows", "starts", "ends")).items():
            base = 0
            for batch in texts.batches(file):
                if not len(batch):
                    continue
                bounds = np.searchsorted(rows, np.arange(base, base + len(batch) + 1))
                sizes, removed, n_spans, kept = [], [], [], []
                for i, text in enumerate(batch.column(text_at)):
                    data = (text.as_py() or "").encode()
                    a, b = bounds[i], bounds[i + 1]
                    sizes.append(len(data))
                    if a == b:
                        removed.append(0)
                        n_spans.append(0)
                        kept.append(data)
                        continue
                    s, e = unions(starts[a:b].astype(np.int64), ends[a:b].astype(np.int64))
                    removed.append(int((e - s).sum()))
                    n_spans.append(len(s))
                    kept.append(b"".join(data[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(data)])))
                base += len(batch)
                if replace:
                    columns = list(batch.columns)
                    left = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(columns[text_at].to_pylist(), kept)]
                    columns[text_at] = pa.array(left, pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                more = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return spans.unionByName(every).repartitionById(n_files, "file").mapInArrow(cut, schema)
