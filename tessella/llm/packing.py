"""Packing documents into sequences by order-preserving dynamic programming.

A partition's documents, in the order in which they are read, are one stream of tokens, handled in blocks of some
documents. A block may be cut where a document ends, where a sentence ends, and inside long sentences every ``step``
tokens. Of all ways to cut it into windows of at most ``size`` tokens, the one of least cost is taken: a window costs
its padding and ``window``, a cut costs ``sentence`` or ``inside`` unless a document ends there. A window is padded to
``size``, except where its length is a power of two, which pads nothing.

With f(j) the least cost of the stream up to cut j, windows that are padded give
f(j) = penalty(j) + window + size - j + min(f(i) + i) over the cuts i of the last ``size`` tokens, a sliding minimum
that a monotone queue keeps; windows of a power of two add one look-up for each power that has a cut so far back.

Token ids are those of a byte-level BPE file of the tokenizers library, with one end token after each document. Texts
are encoded by a rank encoder over the file's vocabulary, which gives the same ids several times faster; every
character that turns up is tried in both libraries first, and a text with a character that they treat differently, or
with an added token's string, goes to the tokenizers library. Long texts are encoded in parts, cut before a single
blank between other characters, where the pattern always splits.

Defined results. A null or empty text is the end token alone. Repeated rows and ids, and null ids, are documents of
their own. An empty table has no sequences. Only doc_id and text are read. A document longer than a block is a block
of its own, however long.

What moves: nothing, there is no shuffle. Sequences belong to a partition and are numbered in it, so a lost task makes
the same ones again. A task holds a block's tokens, about ``block`` of them or one document's.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .tokens import MAX_MODEL_BYTES

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Splits before the merges of a byte-level file, as that pre-tokenizer's own pattern has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are encoded at a time.
PART = 1 << 18
CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


@dataclass(frozen=True)
class PackParams:
    size: int = 1024
    end_id: int = 0
    #: Prices in tokens of padding: a cut where a sentence ends, one inside a sentence, one more sequence.
    sentence: int = 4
    inside: int = 16
    window: int = 4
    #: Places of cuts inside a sentence that is longer than this.
    step: int = 32
    block: int = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for a file's bytes without added special tokens."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(model)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        alphabet = byte_alphabet()
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and (spec.get("pre_tokenizer") or {}) | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranks, self.same, self.other = None, set(), set()
        if plain and spec["model"]["type"] == "BPE" and all(c in alphabet for t in vocab for c in t):
            import tiktoken

            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
            self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._try({chr(c) for c in range(128)})
        self.ascii = self.ranks is not None and not self.other
        self.cuttable = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        #: Whether a token ends with a sentence's mark, begins with white space, ends a line.
        self.closes, self.opens, self.lines = np.zeros((3, size), bool)
        for t, i in vocab.items():
            text = bytes(alphabet.get(c, 0x3F) for c in t).decode(errors="replace")
            self.closes[i] = text.rstrip("\"')]»”’").endswith((".", "!", "?", "…", "。", "！", "？"))
            self.opens[i] = text[:1].isspace()
            self.lines[i] = text.endswith("\n")

    def _slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _try(self, chars: set[str]) -> None:
        for c in chars - self.same - self.other:
            probe = f"a{c}a {c} {c}{c}1{c}1.{c}. {c}{c}  {c}\n{c}"
            (self.same if self.ranks.encode_ordinary(probe) == self._slow(probe) else self.other).add(c)

    def _trusted(self, text: str) -> bool:
        if self.ranks is None or any(a in text for a in self.added):
            return False
        if text.isascii() and self.ascii:
            return True
        chars = set(text)
        self._try(chars)
        return not chars & self.other

    def ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        whole = self.ranks is None or not self.cuttable and any(a in text for a in self.added)
        while len(text) - at > PART and not whole:
            if (cut := CUT.search(text, at + PART)) is None:
                break
            out.append(self._part(text[at : cut.start()]))
            at = cut.start()
        out.append(self._part(text[at:]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _part(self, text: str) -> np.ndarray:
        return np.array(self.ranks.encode_ordinary(text) if self._trusted(text) else self._slow(text), np.uint32)


def places(ids: np.ndarray, ends: np.ndarray, enc: Encoder, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, from 0 to its length, and the price of each cut. ``ends``: where documents end."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    price[1:n][enc.closes[ids[:-1]] & enc.opens[ids[1:]] | enc.lines[ids[:-1]]] = p.sentence
    price[0] = price[ends] = 0
    at = np.flatnonzero(price >= 0)
    long = np.flatnonzero(np.diff(at) > p.step)
    for lo, hi in zip(at[long], at[long + 1], strict=True):
        price[lo + p.step : hi : p.step] = p.inside
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def cuts(at: np.ndarray, price: np.ndarray, p: PackParams) -> np.ndarray:
    """Places of the cheapest windows' bounds, first and last included. Two places in a row are at most ``size`` apart."""
    n = int(at[-1])
    known = np.full(n + 1, -1, np.int64)
    known[at] = np.arange(len(at))
    # (j, i): cut i lies a power of two before cut j
    pairs = [(j, known[at[j] - (1 << k)]) for k in range(p.size.bit_length()) if 1 << k <= p.size for j in [np.flatnonzero(at >= 1 << k)]]
    j, i = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
    j, i = j[i >= 0], i[i >= 0]
    order = np.argsort(j, kind="stable")
    exact, bound = i[order].tolist(), np.searchsorted(j[order], np.arange(len(at) + 1)).tolist()
    place, cost = at.tolist(), price.tolist()
    f, back = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, i), rising in both
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0][1]] < here - p.size:
            queue.popleft()
        least, best = queue[0]
        least += p.size - here
        for i in exact[bound[j] : bound[j + 1]]:
            if f[i] <= least:
                least, best = f[i], i
        f[j], back[j] = least + p.window + cost[j], best
        least = f[j] + here
        while queue and queue[-1][0] >= least:
            queue.pop()
        queue.append((least, j))
    out = [len(place) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return at[np.array(out[::-1])]


def pieces(doc_ids: list, streams: list[np.ndarray], enc: Encoder, p: PackParams, first: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block, and the next sequence's number. ``streams``: each document's ids, its end included."""
    ids = np.concatenate(streams)
    ends = np.cumsum([len(s) for s in streams])
    bounds = cuts(*places(ids, ends, enc, p), p)
    lo = np.union1d(bounds[:-1], ends[:-1])
    hi = np.append(lo[1:], len(ids))
    doc, seq = np.searchsorted(ends, lo, side="right"), np.searchsorted(bounds, lo, side="right") - 1
    starts = ends - np.array([len(s) for s in streams])
    raw = memoryview(ids.astype("<u4").tobytes())
    sums = np.array([crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)
    out = [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), lo - starts[doc], hi - lo, sums, (ends - starts)[doc], first + seq, lo - bounds[seq]]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], [f.split()[0] for f in PIECES.split(", ")]), first + len(bounds) - 1


def packed(docs: DataFrame, model_path: str, p: PackParams = PackParams()) -> DataFrame:
    """PIECES: one row for each stretch of a document inside a sequence."""
    with open(model_path, "rb") as f:  # a tokenizer file on the driver, not an input table
        model = f.read()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} has more than {MAX_MODEL_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = None, np.array([p.end_id], np.uint32)
        number = TaskContext.get().partitionId() << 40
        names, streams, size = [], [], 0
        for b in batches:
            enc = enc or Encoder(shared.value)
            for k in range(b.num_rows):
                names.append(b.column(0)[k].as_py())
                streams.append(np.append(enc.ids(b.column(1)[k].as_py() or ""), end))
                size += len(streams[-1])
                if size >= p.block:
                    out, number = pieces(names, streams, enc, p, number)
                    yield out
                    names, streams, size = [], [], 0
        if names:
            yield pieces(names, streams, enc, p, number)[0]

    rows = held(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES)
