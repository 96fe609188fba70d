"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of consecutive words of the benchmark items, written with a blank on either side, so a
match starts and ends at words. They are searched in normalised text (A-Z lowered, every other byte that is
no word byte a blank, runs of blanks one blank). A table is built for each class of pattern lengths: of each
pattern's first ``m`` bytes (m: the shortest of the class), every block of ``block`` bytes gets its least
distance from the end as shift, and patterns stand in buckets by the hash of their last block. The search looks
at the block that ends a window of m bytes, skips by its shift, and only where the shift is zero compares the
bucket's patterns byte by byte. All texts of a batch are searched at once, in lanes that overlap by one
pattern, one vectorised step after the other.

Defined results. Null texts have no words and no hits; an item without words has no window; an item of fewer
words than a window is one window. Repeated documents each have their own row; repeated item ids count once. The
windows of an item without an id mark words, but it is no item to count or list. Empty tables are fine. Whole texts
are searched; only the named columns are read. Patterns are broadcast in groups of a fixed number of bytes, however
long an item is: a benchmark beyond it makes more groups, searched one after the other. The benchmark, a query set, is
read through the driver one partition at a time, which holds one group.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held

#: Normalisation of bytes: digits, lower-case letters and all above 0x7F stay, A-Z are lowered, all else is a blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
#: Text searched at a time; a longer text stands alone. The arrays beside it take some fifty times as much.
TEXT_BYTES = 2 << 20
EDGE = 10  # stands between documents and in no pattern


def item_words(text: str | None) -> list[bytes]:
    return FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    n = min(width, len(words))
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)]


@dataclass
class Table:
    """One class of patterns: ``m`` and ``block`` bytes, shifts by block hash, patterns sorted by suffix hash."""

    m: int
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray  # hashes of last blocks, sorted
    start: np.ndarray  # of each sorted pattern in ``data``
    length: np.ndarray
    number: np.ndarray  # pattern numbers
    data: np.ndarray


def _views(data: np.ndarray) -> np.ndarray:
    """The integer of the 8 bytes from every position; ``data`` has 8 spare bytes at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _keys(ints: np.ndarray, block: int, bits: int) -> np.ndarray:
    kept = ints & np.uint64((1 << (8 * block)) - 1) if block < 8 else ints
    return ((kept * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def build(patterns: list[bytes], block: int = 8) -> list[Table]:
    """Tables for distinct patterns; lengths within a factor of two share a table."""
    classes = defaultdict(list)
    for i, p in enumerate(patterns):
        classes[len(p).bit_length()].append(i)
    out = []
    for members in classes.values():
        m = min(len(patterns[i]) for i in members)
        b = min(block, m)
        bits = max(12, min(22, (16 * len(members) * (m - b + 1)).bit_length()))
        data = np.frombuffer(b"".join(patterns[i] for i in members) + bytes(16), np.uint8).copy()
        length = np.array([len(patterns[i]) for i in members])
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        ints = _views(data)
        shift = np.full(1 << bits, m - b + 1, np.int32)
        for j in range(m - b + 1):
            np.minimum.at(shift, _keys(ints[start + j], b, bits), m - b - j)
        suffix = _keys(ints[start + m - b], b, bits)
        order = np.argsort(suffix, kind="stable")
        out.append(Table(m, b, bits, shift, suffix[order], start[order], length[order], np.array(members)[order], data))
    return out


def search(t: Table, text: np.ndarray, n: int, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern number) of every occurrence in the first ``n`` bytes; ``text`` has spare bytes after them."""
    none = np.empty(0, np.int64)
    if n < t.m:
        return none, none
    ints = _views(text)
    first = np.arange(0, n - t.m + 1, lane)
    stop = np.minimum(first + lane, n - t.m + 1)  # window starts of each lane
    pos, hits = first.copy(), []
    while len(pos):
        jump = t.shift[_keys(ints[pos + t.m - t.block], t.block, t.bits)]
        hits.append(pos[jump == 0])
        pos = pos + np.maximum(jump, 1)
        on = pos < stop
        pos, stop = pos[on], stop[on]
    at = np.concatenate(hits)
    if not len(at):
        return none, none
    key = _keys(ints[at + t.m - t.block], t.block, t.bits)
    lo, hi = np.searchsorted(t.suffix, key, "left"), np.searchsorted(t.suffix, key, "right")
    found_at, found_p = [], []
    for a in range(0, len(at), 1 << 16):
        count = (hi - lo)[a : a + (1 << 16)]
        who = np.repeat(np.arange(a, a + len(count)), count)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[a : a + (1 << 16)], count)
        where, begin, length = at[who], t.start[which], t.length[which]
        fits = where + length <= n
        where, begin, length, which = where[fits], begin[fits], length[fits], which[fits]
        step = 0
        while len(where) and step < length.max():
            # 8 bytes at a time; the last step of a pattern compares its last 8 bytes again
            off = np.minimum(step, np.maximum(length - 8, 0))
            x, y = _views(text)[where + off], _views(t.data)[begin + off]
            short = length < 8
            if short.any():
                mask = np.where(short, (np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
                x, y = x & mask, y & mask
            same = x == y
            where, begin, length, which = where[same], begin[same], length[same], which[same]
            step += 8
        found_at.append(where)
        found_p.append(t.number[which])
    return np.concatenate(found_at), np.concatenate(found_p)


def normalised(column: pa.Array) -> tuple[np.ndarray, int, np.ndarray]:
    """One text for a column of binaries: its bytes (16 spare ones after the length), length, and each document's start."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    size = np.diff(off)
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
    start = np.concatenate(([0], np.cumsum(size + 3)))  # edge, blank, text, blank
    text = np.full(start[-1], 32, np.uint8)
    inside = np.ones(start[-1], bool)
    for k in (start[:-1], start[:-1] + 1, start[1:] - 1):
        inside[k] = False
    text[inside] = FOLD[raw]
    text[start[:-1]] = EDGE
    blank = text == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    text = text[keep]
    begin = np.concatenate(([0], np.cumsum(keep)))[start[:-1]]
    return np.concatenate((text, np.zeros(16, np.uint8))), len(text), begin


def _matcher(groups: list, keep_spans: bool, keep: tuple[str, ...] = ()):
    """mapInArrow function over (doc_id, text): counts, item ids and, if asked, hit word spans of each row."""
    built: dict[int, tuple] = {}

    def tables(k: int) -> tuple:
        if k not in built:
            built.clear()  # one group's tables at a time
            patterns, owners = groups[k].value
            built[k] = (build(patterns), owners)
        return built[k]

    def one(ids: pa.Array, column: pa.Array, kept: list[pa.Array]) -> pa.RecordBatch:
        text, n, begin = normalised(column)
        docs = len(column)
        ends = np.concatenate((begin[1:], [n])) if docs else begin
        word = (text[:n] > 32) & (np.concatenate(([32], text[: n - 1])) <= 32) if n else np.zeros(0, bool)
        upto = np.concatenate(([0], np.cumsum(word)))
        n_words = upto[ends] - upto[begin]
        edges = np.zeros(n + 1, np.int32)
        items: dict[int, set] = defaultdict(set)
        for k in range(len(groups)):
            made, owners = tables(k)
            for t in made:
                at, p = search(t, text, n)
                if not len(at):
                    continue
                span = np.zeros(max(p) + 1, np.int64)
                span[t.number[t.number <= max(p)]] = t.length[t.number <= max(p)]
                np.add.at(edges, at + 1, 1)
                np.add.at(edges, at + span[p] - 1, -1)
                for d, q in set(zip((np.searchsorted(begin, at, "right") - 1).tolist(), p.tolist(), strict=True)):
                    items[d].update(owners[q])
        hit = word & (np.cumsum(edges[:n]) > 0)
        hits = np.concatenate(([0], np.cumsum(hit)))
        n_hit = hits[ends] - hits[begin]
        found = [sorted(items[d]) if d in items else [] for d in range(docs)]
        cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found])]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
        if keep_spans:
            cols.append(pa.array([np.flatnonzero(hit[a:b][word[a:b]]).tolist() if h else [] for a, b, h in zip(begin, ends, n_hit, strict=True)], pa.list_(pa.int64())))
            names.append("hit_words")
        return pa.RecordBatch.from_arrays([*cols, *kept], [*names, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hi, size = lo, 0
                while hi < b.num_rows and (hi == lo or size + len(b.column(1)[hi].as_buffer() or b"") <= TEXT_BYTES):
                    size += len(b.column(1)[hi].as_buffer() or b"")
                    hi += 1
                yield one(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), [c.slice(lo, hi - lo) for c in b.columns[2:]])
                lo = hi

    return run


def pattern_groups(benchmark: DataFrame, width: int, group_bytes: int) -> list:
    """Broadcasts of (patterns, item ids of each), each of about ``group_bytes`` item bytes at most; items arrive one partition at a time."""
    sc = benchmark.sparkSession.sparkContext
    out, size, owners = [], 0, defaultdict(set)

    def close() -> None:
        nonlocal size, owners
        if owners:
            out.append(sc.broadcast((list(owners), [tuple(x) for x in owners.values()])))
        size, owners = 0, defaultdict(set)

    for row in held(benchmark, "item_id", "text").toLocalIterator():
        words = item_words(row[1])
        for i in range(max(1, len(words) - width + 1)):
            for w in windows(words[i : i + width], width):
                size += 0 if w in owners else len(w)
                owners[w].update(() if row[0] is None else (str(row[0]),))
            if size > group_bytes:
                close()
    close()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, group_bytes: int = 64 << 20, keep_spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs`` (doc_id, text).

    ``keep_spans`` adds ``hit_words``, the positions of the hit words. ``keep`` names columns that come along in a struct ``row``.
    """
    groups = pattern_groups(benchmark, width, group_bytes)
    row = [F.struct(*[F.col(f"`{k}`").alias(k) for k in keep]).alias("row")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string" + ", hit_words array<long>" * keep_spans
    if keep:
        schema += f", row {rows.schema['row'].dataType.simpleString()}"
    return rows.mapInArrow(_matcher(groups, keep_spans, ("row",) if keep else ()), schema).withColumn("contaminated", F.col("n_hit") > 0)
