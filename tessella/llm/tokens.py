"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

The vocabulary file is read on the driver and broadcast (its size is checked). For a SentencePiece model whose
pieces hold the blank mark only at their start, no merge crosses from a character to a following single blank, so a
long text is cut there, the blank becomes the next part's dummy prefix, and the parts' lengths add up. Other
tokenizers get whole texts.

Defined results. Null texts count as empty: no bytes, no tokens. Repeated rows: each has its own result. Empty
tables are fine. Texts are whole, however long. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 15
MAX_MODEL_BYTES = 64 << 20
MARK = "▁"


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cuts at single blanks between other characters; a stretch without one stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and not (cut + 1 < len(text) and text[cut - 1] not in " " + MARK and text[cut + 1] not in " " + MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    out.append(text[at:])
    return out


class Counter:
    """Lengths of encoded texts, for a model's bytes; ``kind`` is the file's ending."""

    def __init__(self, model: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.encode = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            self.safe = all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())) and sp.encode("a b") == sp.encode("a") + sp.encode("b")
        elif kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(model.decode())
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
            self.safe = False
        else:
            raise ValueError(f"unknown kind of tokenizer file: {kind}")

    def lengths(self, texts: list[str]) -> list[int]:
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for p in parts(t) if self.safe and len(t) > PART_CHARS else [t]:
                pieces.append(p)
                owner.append(i)
        out, lo = [0] * len(texts), 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= BATCH_BYTES):
                size += len(pieces[hi])
                hi += 1
            for i, n in zip(owner[lo:hi], self.encode(pieces[lo:hi]), strict=True):
                out[i] += n
            lo = hi
        return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    with open(model_path, "rb") as f:  # a tokenizer file on the driver, not an input table
        model = f.read()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} has more than {MAX_MODEL_BYTES} bytes")
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), model_path.rpartition(".")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(shared.value, kind)
            lo = 0
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]
            while lo < b.num_rows:  # no more than some batches' texts are Python strings at a time
                hi, total = lo, 0
                while hi < b.num_rows and (hi == lo or total + sizes[hi] <= 4 * BATCH_BYTES):
                    total += sizes[hi]
                    hi += 1
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                n = counter.lengths(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
