"""Token counts by a SentencePiece BPE, computed batch by batch in Arrow functions that return lengths only.

Texts are packed into batches of about equal bytes. They are split where no
piece of the vocabulary can reach across: before a word, at a single space
that follows a character other than a space (the encoder puts its own word
mark in place of that space), and in long stretches without such spaces between
two characters that stand together in no piece, if the word mark and the second
one do not either. (There the encoder's mark is a token of its own, which is
taken off again.) Short words that a batch has not seen are encoded together,
and their lengths are remembered within a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A space after a character other than a space or mark, before another than a space. The mark
#: itself may follow, and the end may not: an empty rest would lose its own mark.
_SAFE = re.compile(r" (?=[^ ])(?<=[^ ▁] )")
#: Words up to this length are remembered; longer ones are cut into parts of at least as much.
_WORD = 64


def _pairs(text: str) -> np.ndarray:
    """Each two neighbouring characters as one number; spaces count as marks."""
    codes = np.frombuffer(text.replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return codes[:-1] << np.uint64(32) | codes[1:]


class PieceCounter:
    """Numbers of tokens of whole texts, as ``processor.encode`` gives them.

    Splitting needs a model that neither rewrites its input nor has pieces
    with a word mark after another character; otherwise texts are encoded whole.
    """

    def __init__(self, processor, memory_bytes: int = 96 << 20) -> None:
        self.processor, self.limit = processor, memory_bytes
        self.lengths: dict[str, int] = {}
        self.used = 0
        pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        probe = "AÄﬁ ①  x\t\ny "
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and processor.decode(processor.encode(probe)) == probe and processor.encode(" x", out_type=str)[0].startswith(MARK)
        # Without bytes for unknown characters, several in a row would be one token.
        self.cuts = MARK in pieces and any(processor.is_byte(i) for i in range(len(pieces)))
        self.together = np.unique(np.concatenate([_pairs(p) for p in pieces]))

    def _parts(self, word: str) -> list[str]:
        """A long word cut where no piece reaches across."""
        if not self.cuts:
            return [word]
        pairs = _pairs(word)
        marked = np.uint64(ord(MARK) << 32) | (pairs & np.uint64(0xFFFFFFFF))
        safe = np.flatnonzero(~np.isin(pairs, self.together) & ~np.isin(marked, self.together)) + 1
        edges = [0]
        for at in safe.tolist():
            if at - edges[-1] >= _WORD:
                edges.append(at)
        return [word[p:q] for p, q in zip(edges, [*edges[1:], len(word)])]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]
        if self.used > self.limit:  # bounds the memory; results do not depend on it
            self.lengths, self.used = {}, 0
        known, counts, new = self.lengths, [], {}
        words = [_SAFE.split(t) for t in texts]
        for text_words in words:
            total = 0
            for w in text_words:
                if len(w) > _WORD:
                    parts = self._parts(w)
                    total += sum(map(len, self.processor.encode(parts, num_threads=1))) - len(parts) + 1
                elif w not in known:
                    new[w] = 0
            counts.append(total)
        fresh = list(new)
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            known.update(zip(part, map(len, self.processor.encode(part, num_threads=1))))
        self.used += sum(4 * len(w) + 150 for w in fresh)
        return [total + sum(known[w] for w in text_words if len(w) <= _WORD) for total, text_words in zip(counts, words)]


def count_tokens(documents: DataFrame, model_path: str, *, limit: int = 4096, batch_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Null counts as the empty text (no bytes, no tokens); texts of any length
    are counted whole; repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        counter = PieceCounter(SentencePieceProcessor(model_file=model_path))
        for batch in it:
            texts, sizes, at = batch.column(1), batch.column(2).to_pylist(), 0
            while at < batch.num_rows:
                part, size, begin = [], 0, at
                while at < batch.num_rows and (not part or size + sizes[at] <= batch_bytes):
                    part.append(texts[at].as_py() or "")
                    size += sizes[at]
                    at += 1
                counts = pa.array(counter.count(part), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:at], batch.column(2)[begin:at], counts], names=["doc_id", "n_bytes", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = docs.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
