"""Hidden Markov language model: Baum-Welch counts aggregated over partitions, exact scores by scaled forward recursion.

Tokens are words (A-Z lowered, cut at ASCII white space) and one end for each text. The head vocabulary (a bounded
number of words, the most frequent of all training texts, ties by bytes) and the end have emission weights of their
own in every latent state. All other words are one symbol to the chain, and within it a word has its share of the base
distribution, the same in all states; so the probabilities of all V + 1 base symbols add up to 1.

    P(text) = P_hmm(symbols) * product over other words of base(w) / base(other)

Training starts from expectation-maximisation on the sample and then runs ``passes`` Baum-Welch steps over all
training texts: every task adds up expected transitions and emissions, which are summed by symbol. Emissions are
smoothed towards the base distribution. Recursions, in training in single precision, and scores are of whole texts
of any length.

Words of all training texts are counted once, summed in the tasks before they are shuffled. The tasks hold the counts
of the ``listed`` most frequent words, a bounded number. Of the other words each row sends one record a distinct word,
which is joined with the counts; a counted word beyond the listed has less than 1 / ``listed`` of all words, so none of
them is a hot key, and the skew join splits what no training text has.

Defined results. A null text is an empty one: only the end. Repeated rows: each has its own result and counts in
training. Without training texts all counts and known counts are zero, base scores too, and scores are those of a model
to which all symbols are alike. An empty table gives an empty result. Only doc_id and text are read. Tables at rest are deleted but for the result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import forward_backward, likelihood
from .common import Scratch

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
OTHER, END = 0, 1  # symbols; head words follow
TEXT_BYTES = 2 << 20
COUNTED = 1 << 15  # distinct words that a task holds before it hands its counts on


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    head: int = 20_000  # fits 16 bits with OTHER and END
    listed: int = 200_000  # words whose counts the tasks hold, of at most 64 bytes each
    sample_docs: int = 1500
    sample_chars: int = 20_000
    sample_steps: int = 12
    passes: int = 2
    lane: int = 256  # tokens of a text that are stepped on their own; sums don't depend on it
    smooth: float = 2.0  # pseudo-counts of the base distribution in each state
    seed: int = 11


@dataclass
class Hmm:
    init: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # (symbols, states): P(symbol | state)


def tokens(text: bytes | None, long: int = 64) -> list[bytes]:
    """Words; a very long one stands as its SHA-256 after a byte that no text has, so that words are of bounded size."""
    words = (text or b"").translate(LOWER).split()
    if words and len(max(words, key=len)) > long:
        return [w if len(w) <= long else b"\xff" + hashlib.sha256(w).digest() for w in words]
    return words


def expected(ids: np.ndarray, lengths: np.ndarray, m: Hmm, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected initial states, transitions and emissions (symbols, states) of whole texts."""
    post, moves, _ = forward_backward(m.emit.astype(np.float32)[ids], m.trans, m.init, lengths, lane)
    emit = np.stack([np.bincount(ids, post[:, k], len(m.emit)) for k in range(post.shape[1])], 1)
    return post[np.cumsum(lengths) - lengths].sum(0), moves, emit


def maximised(init: np.ndarray, moves: np.ndarray, emit: np.ndarray, base: np.ndarray, p: HmmParams) -> Hmm:
    """Parameters from expected counts; ``base`` has the base probability of each symbol."""
    k = len(init)
    e = emit + p.smooth * 100 * base[:, None]
    a = moves + 0.1
    i = init + 0.1
    return Hmm(i / i.sum(), a / a.sum(1, keepdims=True), e / e.sum(0, keepdims=True)) if k else Hmm(init, moves, emit)


def first_model(ids: np.ndarray, lengths: np.ndarray, symbols: int, p: HmmParams) -> Hmm:
    """Expectation-maximisation on the sample, from states that begin as groups of texts alike in their symbols."""
    rng = np.random.default_rng(p.seed)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(ids, minlength=symbols) + 0.1
    base = counts / counts.sum()
    if not len(lengths):
        return Hmm(np.full(p.states, 1 / p.states), np.full((p.states, p.states), 1 / p.states), np.tile(base[:, None], (1, p.states)))
    # mixture of unigrams: a soft group for each text
    emit = base[:, None] * rng.gamma(2.0, 0.5, (symbols, p.states))
    emit /= emit.sum(0)
    for _ in range(8):
        log = np.zeros((len(lengths), p.states))
        le = np.log(emit)
        for k in range(p.states):
            log[:, k] = np.bincount(owner, le[ids, k], len(lengths)) / np.sqrt(lengths)
        w = np.exp(log - log.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        emit = np.stack([np.bincount(ids, w[owner, k], symbols) for k in range(p.states)], 1) + p.smooth * 100 * base[:, None]
        emit /= emit.sum(0)
    trans = np.full((p.states, p.states), 0.1 / max(1, p.states - 1))
    np.fill_diagonal(trans, 0.9)
    emit *= rng.gamma(20.0, 1 / 20, emit.shape)
    m = Hmm(np.full(p.states, 1 / p.states), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))
    for _ in range(p.sample_steps):
        m = maximised(*expected(ids, lengths, m, p.lane), base, p)
    return m


def _encoder(number: dict[bytes, int], symbols: int, logs: np.ndarray):
    """Of a text: symbols with the end, sum of logs of head words and the end, sum and number of other listed words, the remaining words."""
    get = number.get

    def encode(text: bytes | None) -> tuple[np.ndarray, float, float, int, Counter]:
        words = tokens(text)
        rank = np.fromiter((get(w, OTHER) for w in words), np.int32, len(words))
        ids = np.append(np.where(rank < symbols, rank, OTHER), END).astype("<u2")
        mid = rank[rank >= symbols]
        return ids, float(logs[ids[ids != OTHER]].sum()), float(logs[mid].sum()), len(mid), Counter(words[i] for i in np.flatnonzero(rank == OTHER))

    return encode


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """(w, n) of all words of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])
        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_buffer().to_pybytes()))
                if len(seen) >= COUNTED:
                    yield handed()
                    seen.clear()
        yield handed()

    texts = docs.where(~held_out & F.col("text").isNotNull()).select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def top_words(words: DataFrame, k: int) -> list[tuple[bytes, int]]:
    """The ``k`` most frequent, ties by bytes. ``words``: (w, n) at rest."""
    # the least count among them, from the counts' own counts, which are few: different counts add up to no more than all words
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = sizes.agg(F.max(F.when(F.col("above") >= k, F.col("n")))).first()[0] or 0
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(k)
    return [(bytes(r["w"]), r["n"]) for r in top.collect()]  # ``k`` rows at most


def sample_texts(docs: DataFrame, held_out: Column, p: HmmParams) -> list[bytes]:
    """For the first model only: at most ``sample_docs`` training texts, by hash of doc_id, of at most ``sample_chars`` code points."""
    d = docs.where(~held_out & F.col("text").isNotNull() & (F.length("text") <= p.sample_chars)).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", F.lit(p.seed)).alias("h"))
    # ids by hash first, so that only the sample's texts move
    top = d.select("h", "doc_id").orderBy("h", "doc_id").limit(p.sample_docs)
    last = top.agg(F.max("h")).first()[0]
    rows = d.where(F.col("h") <= last).orderBy("h", "doc_id", "text").limit(p.sample_docs).collect() if last is not None else []
    return [bytes(r["text"]) for r in rows]


@dataclass
class Trained:
    """What training leaves: the model, and the base distribution of all tokens."""

    model: Hmm
    number: dict[bytes, int]  # symbols of head words, then numbers of the other listed words
    base: np.ndarray  # of each symbol
    total: int  # training tokens
    whole: float  # total + 0.1 (distinct + 1)
    rows: DataFrame  # every row's symbols and sums, at rest
    words: DataFrame  # counts, at rest


def train(docs: DataFrame, held_out: Column, p: HmmParams, scratch: Scratch) -> Trained:
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = sample_texts(docs, held_out, p)
    words = scratch.write(word_counts(docs, held_out), "words")
    sums = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = docs.where(~held_out).count()
    total, distinct = int(sums[1]) + ends, int(sums[0]) + (ends > 0)
    whole = total + 0.1 * (distinct + 1)
    top = top_words(words, max(p.head, p.listed))
    number = {w: i + 2 for i, (w, _) in enumerate(top)}
    symbols = min(p.head, len(top)) + 2
    counts = np.array([0, ends, *[n for _, n in top]], np.float64)
    shared = sc.broadcast((number, symbols, np.log10(counts + 0.1)))

    # each row's symbols (two bytes each, with the end) stay at rest, with what is known of its other words
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _encoder(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [run(t.as_buffer().to_pybytes() if t.is_valid else None) for t in part.column(3)]
                ids = pa.array([x[0].tobytes() for x in found], pa.binary())
                other = pa.array([list(x[4].items()) for x in found], pa.map_(pa.binary(), pa.int64()))
                columns = [pa.array([len(x[0]) for x in found], pa.int64()), *[pa.array([x[k] for x in found], kind) for k, kind in ((1, pa.float64()), (2, pa.float64()), (3, pa.int64()))]]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids, *columns, other], ["rid", "doc_id", "held_out", "ids", "n_tokens", "head_logs", "mid_logs", "n_mid", "other"])

    flat = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    rows = scratch.write(flat.mapInArrow(encode, "rid long, doc_id long, held_out boolean, ids binary, n_tokens long, head_logs double, mid_logs double, n_mid long, other map<binary,bigint>"), "symbols")

    # base probability of each symbol; OTHER has what head words and the end have left
    base = (counts[:symbols] + 0.1) / whole
    base[OTHER] = max(1.0 - base[1:].sum(), 0.1 / whole)
    run = _encoder(*shared.value)
    sample_ids = [run(t)[0] for t in texts]
    ids = np.concatenate(sample_ids).astype(np.int64) if sample_ids else np.empty(0, np.int64)
    model = first_model(ids, np.array([len(x) for x in sample_ids], np.int64), symbols, p)
    model = maximised(model.init * 0 + 1, model.trans * 100, model.emit * 1e5, base, p)
    for _ in range(p.passes):
        model = maximised(*_expected_sums(rows, model, p), base, p)
    return Trained(model, number, base, total, whole, rows, words)


def _expected_sums(rows: DataFrame, model: Hmm, p: HmmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected initial states, transitions and emissions over all training rows; what comes back has a row for each symbol at most."""
    symbols, k = model.emit.shape
    given = rows.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        init, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
        for x, lengths in _blocks(batches):
            a, b, c = expected(x, lengths, given.value, p.lane)
            init += a
            moves += b
            emit += c
        some = np.flatnonzero(emit.any(1))
        # rows below zero: initial states (-1) and transitions from each state (-2, -3, ...)
        key = np.concatenate((some, [-1], -2 - np.arange(k)))
        value = np.concatenate((emit[some], init[None], moves)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(value[:, j]) for j in range(k)]], ["id", *[f"s{j}" for j in range(k)]])

    schema = "id long, " + ", ".join(f"s{j} float" for j in range(k))
    sums = rows.where("NOT held_out").select("ids").mapInArrow(gather, schema).groupBy("id").agg(*[F.sum(F.col(f"s{j}").cast("double")).alias(f"s{j}") for j in range(k)])
    init, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for r in sums.collect():  # head symbols and states only
        v = np.array(r[1:])
        if r["id"] >= 0:
            emit[r["id"]] = v
        elif r["id"] == -1:
            init = v
        else:
            moves[-2 - r["id"]] = v
    return init, moves, emit


def score(docs: DataFrame, held_out: Column, p: HmmParams = HmmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    scratch = Scratch(docs.sparkSession, "hmm")
    t = train(docs, held_out, p, scratch)
    given = docs.sparkSession.sparkContext.broadcast(t.model)

    # words that aren't listed: one record for each of a row, joined with the counts
    other = t.rows.select("rid", F.explode("other").alias("w", "k")).join(t.words, "w", "left")
    tail = other.groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_logs"), F.sum("k").alias("n_tail"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_tail_known")
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for b in batches:
            at = 0
            for x, lengths in _blocks([b.select(["ids"])]):
                log = likelihood(m.emit[x], m.trans, m.init, lengths) / np.log(10)
                some = b.slice(at, len(lengths))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keep], pa.array(log)], [*keep, "chain"])
                at += len(lengths)

    keep = ["rid", "doc_id", "held_out", "n_tokens", "head_logs", "mid_logs", "n_mid"]
    chained = t.rows.select(*keep, "ids").mapInArrow(chain, "rid long, doc_id long, held_out boolean, n_tokens long, head_logs double, mid_logs double, n_mid long, chain double")
    out = chained.join(tail, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_other, other_logs = F.col("n_mid") + zero("n_tail"), F.col("mid_logs") + zero("tail_logs")
    log_whole, other_log = float(np.log10(t.whole)), float(np.log10(t.base[OTHER]))
    # the end is a known token once there is a training text
    unknown = zero("n_tail") - zero("n_tail_known") + F.lit(0 if t.total else 1)
    result = out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - unknown).cast("long").alias("n_known"),
        F.lit(t.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + other_logs - F.col("n_tokens") * log_whole).alias("base_score"),
        (F.col("chain") + other_logs - n_other * (log_whole + other_log)).alias("score"),
    )
    return scratch.settle(result)


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols end to end and the lengths of whole texts, a bounded number of bytes at a time; a longer text stands alone."""
    for b in batches:
        held, size = [], 0
        for x in b.column(b.schema.get_field_index("ids")):
            x = np.frombuffer(x.as_buffer(), "<u2")
            if held and size + len(x) > TEXT_BYTES // 8:
                yield np.concatenate(held).astype(np.int64), np.array([len(y) for y in held])
                held, size = [], 0
            held.append(x)
            size += len(x)
        if held:
            yield np.concatenate(held).astype(np.int64), np.array([len(y) for y in held])
