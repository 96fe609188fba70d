"""Language identification by a linear-chain conditional random field over words.

Every word (maximal run of letters, lower-cased) gets an emission score for each language from its affixes,
character n-grams (hashed, blanks at the word's ends included) and the lexicon's entry; learned transitions join
neighbours. Training maximises the conditional likelihood of code-switched sequences, spliced from spans of
labelled documents, by AdaGrad on forward-backward gradients. A text's words are labelled by the posterior of
forward-backward; the text's language has the largest sum of posteriors and its share is the score.

The classifier is fitted on a bounded sample: at most ``per_lang`` documents of each language, fewer where there are
so many languages that ``max_docs`` in all would be exceeded, but one of each at least; of a text of more than ``max_chars``
code points a stretch of so many, drawn like the documents by hash of the row. No language is left out: with many, the
hash tables of each get fewer bits, so that the model stays within ``weights``. Prediction reads whole texts.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Without any labelled
document every text is ``und``. Repeated rows: each has its own result; repeated ids share a place in the draw, and no
more of them are drawn than the language's quota. Empty tables are fine. Only doc_id and text are read for
predictions, and lang for training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import forward_backward
from .common import Scratch, crc_mod

BITS = 15
GRAMS = (2, 3)
PIECES = ("gram2", "gram3", "prefix", "suffix")
#: Bytes of letters: a-z and whatever is no ASCII; all other bytes separate words.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
MUL = np.uint64(0x9E3779B97F4A7C15)


def bits_for(langs: int, weights: int) -> int:
    """Bits of each hash table, so that all languages' tables have at most so many weights, but 8 bits at least."""
    return max(8, min(BITS, (max(1, weights // (langs * len(PIECES)))).bit_length() - 1))


@dataclass(frozen=True)
class CrfParams:
    per_lang: int = 150
    max_docs: int = 3000
    max_chars: int = 20_000
    lexicon: int = 20_000
    weights: int = 16 << 20  # of all tables
    span: int = 12
    length: int = 32
    epochs: int = 4
    rate: float = 0.2
    batch: int = 256
    seed: int = 7


class Words:
    """The words of a column of texts, as bytes with one blank around each, and where their features are hashed."""

    def __init__(self, column: pa.Array):
        column = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        size = np.diff(off)
        start = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.full(start[-1] + 1, 32, np.uint8)  # a blank before every text and one at the end
        inside = np.ones(start[-1] + 1, bool)
        inside[start] = False
        text[inside] = np.where(LETTER[raw], raw, 32)
        blank = text == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[0] = True
        # words begin where a letter follows a blank; each text's count tells where its words stand
        first = ~blank[1:] & blank[:-1]
        self.upto = np.concatenate(([0], np.cumsum(first)))[start]
        text = text[keep]
        if text[-1] != 32:
            text = np.append(text, np.uint8(32))
        self.text, n = text, len(text)
        lead = np.flatnonzero(text == 32)
        self.lead, self.trail = lead[:-1], lead[1:]
        self.n = len(self.lead)
        self.ints = np.ndarray((n,), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), 0, (1,))

    def features(self, bits: int = BITS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """name -> (hash, word) of each occurrence."""
        at = np.arange(self.lead[0], self.trail[-1]) if self.n else np.empty(0, np.int64)
        word = np.repeat(np.arange(self.n), self.trail - self.lead)
        out = {}
        for n in GRAMS:
            ok = at + n - 1 <= self.trail[word]
            x = self.ints[at[ok]] & np.uint64((1 << 8 * n) - 1)
            out[f"gram{n}"] = ((x * MUL >> np.uint64(64 - bits)).astype(np.int64), word[ok])
        every = np.arange(self.n)
        size = np.minimum(self.trail - self.lead - 1, 5).astype(np.uint64)
        mask = (np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1)
        for name, x in (("prefix", self.ints[self.lead + 1] & mask), ("suffix", self.ints[self.trail - size.astype(np.int64)] & mask)):
            out[name] = (((x + np.uint64(1)) * MUL >> np.uint64(64 - bits)).astype(np.int64), every)
        return out

    def hashes(self) -> np.ndarray:
        """64 bits of each whole word."""
        if not self.n:
            return np.empty(0, np.uint64)
        at = np.arange(self.lead[0], self.trail[-1])
        place = (at - np.repeat(self.lead, self.trail - self.lead)).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (self.text[at].astype(np.uint64) + np.uint64(1)) * ((place + np.uint64(1)) * MUL ^ (place + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.add.reduceat(x, self.lead - self.lead[0])


@dataclass
class Crf:
    langs: list[str]
    tables: dict[str, np.ndarray]  # (2 ** bits, L) weights of each kind of feature
    lex_keys: np.ndarray  # sorted
    lex: np.ndarray  # (entries + 1, L); the last row, of unknown words, is the bias
    trans: np.ndarray
    init: np.ndarray

    def look(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lex_keys):
            return np.zeros(len(hashes), np.int64)
        i = np.searchsorted(self.lex_keys, hashes)
        i[i == len(self.lex_keys)] = 0
        return np.where(self.lex_keys[i] == hashes, i, len(self.lex_keys))

    @property
    def bits(self) -> int:
        return len(self.tables[PIECES[0]]).bit_length() - 1

    def scores(self, w: Words) -> np.ndarray:
        e = self.lex[self.look(w.hashes())].astype(np.float64)
        for name, (h, word) in w.features(self.bits).items():
            t = self.tables[name]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            if len(word):
                e[word[first]] += np.add.reduceat(t[h], first)
        return e

    def label(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        w = Words(column)
        n = np.diff(w.upto)
        e = self.scores(w)
        e = np.exp(e - e.max(1, keepdims=True)) + 1e-30
        some = np.flatnonzero(n)
        total = np.zeros((len(n), len(self.langs)))
        if len(some):
            post, _, _ = forward_backward(e, np.exp(self.trans), np.exp(self.init), n[some])
            total[some] = np.add.reduceat(post, w.upto[:-1][some])
        # bytes beyond ASCII pass for letters in words; a text needs one that is
        lettered = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False) & (n > 0)
        best = total.argmax(1)
        score = np.where(lettered, total.max(1) / np.maximum(n, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, lettered, strict=True)], np.clip(score, 0.0, 1.0)


def fit(texts: list[str], labels: list[str], p: CrfParams = CrfParams()) -> Crf | None:
    """Conditional random field from labelled texts."""
    w = Words(pa.array(texts, pa.large_string()))
    langs = sorted({x for x, n in zip(labels, np.diff(w.upto), strict=True) if n})
    if not langs:
        return None
    rng = np.random.default_rng(p.seed)
    k = len(langs)
    number = {x: i for i, x in enumerate(langs)}
    # code-switched sequences: spans of random documents, languages alternating as drawn, every word used about once
    spans = []
    for d in range(len(texts)):
        lo, hi = w.upto[d], w.upto[d + 1]
        while lo < hi:
            n = min(1 + rng.geometric(1 / p.span), hi - lo)
            spans.append((lo, lo + n, number.get(labels[d], -1)))
            lo += n
    rng.shuffle(spans)
    words = np.concatenate([np.arange(a, b) for a, b, _ in spans]) if spans else np.empty(0, np.int64)
    gold = np.concatenate([np.full(b - a, y) for a, b, y in spans])
    hashes = w.hashes()
    keys, counts = np.unique(hashes, return_counts=True)
    bits = bits_for(k, p.weights)
    keep = np.sort(np.argsort(-counts, kind="stable")[: min(p.lexicon, max(1, p.weights // k))])
    keys = keys[keep][counts[keep] > 1]
    crf = Crf(langs, {n: np.zeros((1 << bits, k), np.float32) for n in PIECES}, keys, np.zeros((len(keys) + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    feats = w.features(bits)
    lex = crf.look(hashes)
    # occurrences in the order of words, so that a batch of words finds its own
    bounds = {n: np.searchsorted(word, np.arange(w.n + 1)) for n, (h, word) in feats.items()}
    squares = {n: np.full(t.shape, 1e-2, np.float32) for n, t in crf.tables.items()}
    lex_sq, tr_sq, in_sq = np.full(crf.lex.shape, 1e-2, np.float32), np.full((k, k), 1.0), np.full(k, 1.0)
    full = len(words) // p.length * p.length
    step = p.batch * p.length
    for _ in range(p.epochs):
        for lo in range(0, full or len(words), step):
            at = words[lo : min(lo + step, full) if full else len(words)]
            y = gold[lo : lo + len(at)]
            lengths = np.full(len(at) // p.length, p.length) if full else np.array([len(at)])
            e = crf.lex[lex[at]].astype(np.float64)
            own = {}
            for n, (h, _) in feats.items():
                b = bounds[n]
                count = b[at + 1] - b[at]
                who = np.repeat(np.arange(len(at)), count)
                occ = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(b[at], count)
                own[n] = (h[occ], who)
                for j in range(k):
                    e[:, j] += np.bincount(who, crf.tables[n][h[occ], j], len(at))
            x = np.exp(e - e.max(1, keepdims=True)) + 1e-30
            post, moves, _ = forward_backward(x, np.exp(crf.trans), np.exp(crf.init), lengths)
            g = -post
            g[np.arange(len(at)), y] += 1
            seq_first = np.cumsum(lengths) - lengths
            true = np.zeros((k, k))
            pair = np.ones(len(at) - 1, bool)
            pair[seq_first[1:] - 1] = False
            np.add.at(true, (y[:-1][pair], y[1:][pair]), 1)
            scale = p.rate
            for n, (h, who) in own.items():
                t, s = crf.tables[n], squares[n]
                for j in range(k):
                    d = np.bincount(h, g[who, j], 1 << bits)
                    s[:, j] += d * d
                    t[:, j] += scale * d / np.sqrt(s[:, j])
            for j in range(k):
                d = np.bincount(lex[at], g[:, j], len(crf.lex))
                lex_sq[:, j] += d * d
                crf.lex[:, j] += scale * d / np.sqrt(lex_sq[:, j])
            d = true - moves
            tr_sq += d * d
            crf.trans += scale * d / np.sqrt(tr_sq)
            d = g[seq_first].sum(0)
            in_sq += d * d
            crf.init += scale * d / np.sqrt(in_sq)
    return crf


def sample(docs: DataFrame, p: CrfParams = CrfParams()) -> tuple[list[str], list[str]]:
    """Texts and labels to fit on: a bounded number for each language, drawn by hash of id and text, whether ids are null or repeated."""
    d = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1) & F.col("text").rlike(r"\p{L}"))
    scratch = Scratch(docs.sparkSession, "language")
    sizes = scratch.small(d.groupBy("lang").agg(F.count("*").alias("n")))
    quota = max(1, min(p.per_lang, p.max_docs // max(1, sizes.count())))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(p.seed)), F.lit(1 << 40)) / float(1 << 40)
    # a text of more than max_chars: a stretch of it, from anywhere
    begin = F.when(F.length("text") > p.max_chars, F.pmod(F.xxhash64("doc_id", "text", F.lit(p.seed + 1)), F.length("text") - p.max_chars + 1)).otherwise(0)
    # about twice as many as needed, then the first of each language by hash; tasks hand on no more than the quota of each
    placed = d.join(sizes, "lang").withColumn("place", place)

    def first(drawn: DataFrame) -> list:
        """``quota`` rows of each language at most."""
        drawn = drawn.select("lang", "place", "doc_id", F.expr("text").substr((begin + 1).cast("int"), F.lit(p.max_chars)).alias("text"))
        return drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "text"))).where(F.col("rank") <= quota).select("lang", "rank", "text").collect()

    rows = first(placed.where(F.col("place") * F.col("n") <= 2.0 * quota + 20))
    # rows that are all alike stand or fall together: a language that is left short is taken without thinning
    got = Counter(r["lang"] for r in rows)
    lacking = [r["lang"] for r in sizes.collect() if got[r["lang"]] < min(quota, r["n"])]
    if lacking:
        rows = [r for r in rows if r["lang"] not in lacking] + first(placed.where(F.col("lang").isin(lacking)))
    scratch.drop(sizes)
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, crf: Crf | None, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(crf) if crf else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Crf(**shared.value) if shared.value else None
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), batch_bytes, "right")))
                text = b.column(1).slice(lo, hi - lo)
                lang, score = model.label(text) if model else (["und"] * len(text), np.zeros(len(text)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
