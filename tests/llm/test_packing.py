"""Packing: every document is rebuilt from its pieces, ids are the library's, costs are the least of all ways to cut."""

import functools
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing
from tessella.llm.op12_packing import op12_packing
from tessella.llm.packing import Encoder, PackParams, cuts, packed, places

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length long, start string, sequence_id int, offset long"
SENTENCES = ["The river runs past the mill. ", "Who knows?\n", "He said: “Stop!” ", "Zwölf Boxkämpfer jagen Viktor. ", "数学は楽しい。", "a b c d ", "3.14 is not a sentence end ", "<|endoftext|>", " \n\n", "x" * 90 + " "]


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n", "word", "x" * 50_000, " " * 3000 + "q", "<|endoftext|>", "no end " * 3000, "\x1c\x85  ​　 end", "é \U0001f600 \U00010400"]
    out += ["".join(rng.choice(SENTENCES) for _ in range(rng.choice((1, 5, 40, 400)))) for _ in range(60)]
    return out + [out[12], out[12], out[20]]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return Encoder(f.read())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], SCHEMA)


def check(rows, library, want):
    """Every id in exactly one piece, sequences without gaps; returns the sequences' lengths."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert {k: None for k in docs} == {k: None for k in want}
    for k, text in want.items():
        ids, at = ids_of(library, text), 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for part in seqs.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return [sum(r.length for r in part) for part in seqs.values()]


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)


def test_documents_are_rebuilt(spark, library):
    want = dict(enumerate(texts()))
    for parts in (1, 5):
        lengths = check(packed(frame(spark, want.items()).repartition(parts), PATH).collect(), library, want)
        assert padding(lengths) <= 0.02 * sum(lengths) + 64 * parts
    # small blocks, each with an end of its own, and a document longer than one
    lengths = check(packed(frame(spark, want.items()).repartition(2), PATH, PackParams(block=2000)).collect(), library, want)
    assert padding(lengths) <= 0.02 * sum(lengths) + 64 * sum(lengths) / 2000


def test_null_and_repeated_ids(spark):
    out = packed(frame(spark, [(None, "one two"), (None, None), (7, "same"), (7, "same")]), PATH).collect()
    assert len(out) >= 4 and sum(r.length for r in out) == 3 + 1 + 2 + 2
    assert sum(r.length for r in out if r.doc_id == 7) == 4


def test_rank_encoder_is_the_library(library, encoder):
    assert encoder.ranks is not None and encoder.ascii
    rng = random.Random(2)
    chars = [chr(c) for c in [*range(32, 1500), *range(0x1E00, 0x1F00), *range(0x2000, 0x2100), *range(0x3000, 0x3100), *range(0xAC00, 0xAC40), 0x85, 0x180E, 0x1F600, 0x10400, 0xFFFD]]
    more = ["".join(rng.choice(chars) if rng.random() < 0.3 else rng.choice("ab 1.'\n ") for _ in range(200)) for _ in range(400)]
    for t in [*(t or "" for t in texts()), *more]:
        assert encoder.ids(t).tolist() == ids_of(library, t)[:-1]
    # a character that the two would treat differently sends its text to the library
    other = Encoder(open(PATH, "rb").read())
    other.other.add("ß")
    assert not other._trusted("Straße") and other.ids("Straße").tolist() == ids_of(library, "Straße")[:-1]


def test_long_texts_are_cut_at_safe_places(library, encoder, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    for t in texts():
        assert encoder.ids(t or "").tolist() == ids_of(library, t)[:-1]


def test_other_tokenizer_file(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packed(frame(spark, [(1, "The river runs. " * 200)]), path).collect()
    ids = [*Tokenizer.from_file(path).encode("The river runs. " * 200, add_special_tokens=False).ids, 0]
    assert sum(r.length for r in out) == len(ids)
    assert all(r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in out)


def test_cuts_cost_the_least(encoder):
    rng = np.random.default_rng(4)
    for trial in range(60):
        p = PackParams(size=int(rng.choice([8, 13, 16])), sentence=int(rng.integers(0, 4)), inside=int(rng.integers(2, 9)), window=int(rng.integers(0, 3)), step=5)
        ids = rng.choice(encoder.library.encode("One two. Three\n four? Five six", add_special_tokens=False).ids, int(rng.integers(1, 70))).astype(np.uint32)
        ends = np.append(np.flatnonzero(rng.random(len(ids) - 1) < 0.1) + 1, len(ids))
        at, price = places(ids, ends, encoder, p)
        assert at[0] == 0 and at[-1] == len(ids) and np.diff(at).max() <= p.step
        by = dict(zip(at.tolist(), price.tolist(), strict=True))

        def window(n, p=p):
            return p.window + (0 if n & (n - 1) == 0 else p.size - n)

        @functools.cache
        def least(j, by=by, p=p, window=window):
            return 0 if j == 0 else by[j] + min(least(i) + window(j - i) for i in by if j - p.size <= i < j)

        bounds = cuts(at, price, p).tolist()
        assert bounds[0] == 0 and bounds[-1] == len(ids)
        assert sum(by[b] for b in bounds[1:]) + sum(window(b - a) for a, b in zip(bounds, bounds[1:], strict=False)) == least(len(ids))


def test_query_reads_its_whole_table(spark, library, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_packing(spark, f"{tmp_path}/none").count() == 0
    want = dict(enumerate(texts()))
    frame(spark, want.items()).repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    first, second = (sorted(map(tuple, op12_packing(spark, f"{tmp_path}/some").collect()), key=str) for _ in range(2))
    assert first == second
