"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the text's bytes picks cut points, so a passage that
recurs in another document falls into the same chunks there. A chunk is
encoded once per Python worker, which lives for many tasks, and remembered
(within a bounded memory). Words are remembered for the length of a task.

Encodings of chunks do not simply concatenate. But the BPE first splits a text
into words, and at some positions a word begins whatever stands around: at a
single space or line end between two plain characters, at a comma or full
stop after an ASCII letter, and on both sides of an East Asian comma or full
stop beside an East Asian letter. No token crosses such a sure position. A
chunk keeps the tokens between its first and its last one; at each join, the
text from the last sure position of one chunk to the first of the next is
encoded anew (further, if a chunk has none), from where on the joined encoding
agrees exactly with that of the whole text.

A long run of letters has no sure position inside. Its chunks are encoded and
joined by their tokens: the characters around a join are encoded anew, more on
both sides each time, until the new tokens begin and end with the old ones.
Then all neighbouring tokens are such as the BPE itself leaves side by side,
which makes the whole sequence the encoding of the whole run.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 1  # printable ASCII
_KIND[[32, 10]] = 2  # space, line end
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[44, 46]] = True  # comma, full stop
#: Runs of characters that are letters by any version of Unicode in use. Fixed values.
_RUN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcc\uac00-\ud7a3]+")
#: Context in bytes on either side that decides whether a position is sure.
_CONTEXT = 3


def _east_asian(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter, and a comma or full stop, of three bytes begins at each byte but the last two."""
    a, b, c = x[:-2], x[1:-1], x[2:]
    letter = ((a >= 0xE5) & (a <= 0xE8)) | (a == 0xEB) | (a == 0xEC) | ((a == 0xE4) & (b >= 0xB8)) | ((a == 0xE9) & (b < 0xBF))
    letter |= (a == 0xE3) & (((b == 0x81) & (c >= 0x81)) | ((b == 0x83) & (c <= 0xBA)))
    stop = ((a == 0xE3) & (b == 0x80) & ((c == 0x81) | (c == 0x82))) | ((a == 0xEF) & (b == 0xBC) & (c == 0x8C))
    return letter, stop


def sure_positions(data: bytes) -> list[int]:
    """Positions where a word starts given just ``_CONTEXT`` bytes on either side.

    Plain characters are printable ASCII and those of two bytes from U+00C0 on:
    none of them is white space by any definition.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    if len(x) < 4:
        return []
    kind = _KIND[x]
    lead = (x >= 0xC3) & (x <= 0xDF)
    before = kind[1:-2] == 1
    before |= lead[:-3] & (x[1:-2] >= 0x80) & (x[1:-2] < 0xC0)
    after = (kind[3:] == 1) | lead[3:]
    at = (kind[2:-1] == 2) & before & after
    at |= _STOP[x[2:-1]] & _LETTER[x[1:-2]]
    sure = np.flatnonzero(at) + 2
    if len(x) >= 6 and x.max() >= 0xE3:
        letter, stop = _east_asian(x)
        wide = (letter[:-3] & stop[3:]) | (stop[:-3] & letter[3:])
        sure = np.union1d(sure, np.flatnonzero(wide) + 3)
    return sure.tolist()


def cut_points(data: bytes, mean: int, window: int = 16, low: int = 64) -> list[int]:
    """Ends of the chunks: where the rolling hash of the last ``window`` bytes is low, on character borders."""
    n = len(data)
    if n <= low:
        return [n]
    x = np.frombuffer(data, dtype=np.uint8)
    h = x.astype(np.uint32) * np.uint32(2654435761) ^ np.uint32(0x9E3779B9)
    reach = 1
    while reach < window:  # hashes of twice as many bytes from two of half as many
        h = h[:-reach] * np.uint32(0x85EBCA6B) + (h[reach:] ^ (h[reach:] >> np.uint32(15)))
        reach *= 2
    at = np.flatnonzero(h < np.uint32(0xFFFFFFFF // mean)) + reach
    at = at[(at < n)]
    at = at[(x[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


def _slices(data: bytes, bounds: list[int], begin: int, end: int) -> list[bytes]:
    """The bytes from ``begin`` to ``end``, cut at the bounds between."""
    edges = [begin, *bounds[bisect_right(bounds, begin) : bisect_left(bounds, end)], end]
    return [data[p:q] for p, q in zip(edges, edges[1:]) if p < q]


class ChunkEncoder:
    """Encodes whole texts exactly as ``tokenizer`` does, remembering chunks and words.

    ``tokenizer`` needs a byte-level BPE with the usual word pattern (optional
    space, then letters, digits or others), which the sure positions follow.
    """

    def __init__(self, tokenizer, mean_chunk: int = 512, word_bytes: int = 160 << 20, chunk_bytes: int = 24 << 20, long_run: int = 2048) -> None:
        self.tokenizer, self.mean, self.word_limit, self.chunk_limit, self.long_run = tokenizer, mean_chunk, word_bytes, chunk_bytes, long_run
        self.words: dict[bytes, bytes] = {}  # word -> ids, as comma-joined decimals
        self.chunks: dict[bytes, bytes] = {}  # chunk -> ids between its first and last sure position
        self.runs: dict[bytes, list[int]] = {}  # chunk of a run of letters -> its ids
        self.lossy: dict[bytes, bytes] = {}  # words that decode to other bytes than their own
        self.word_used = self.chunk_used = 0
        added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}  # the usual printable form of each byte
        self.token_bytes = {i: added[i].encode() if i in added else bytes(letter[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}

    def rest(self, keep: int = 16 << 20) -> None:
        """Forgets words beyond ``keep`` bytes between tasks: a worker that waits leaves the memory to others. Chunks stay."""
        if self.word_used > keep:
            self.words, self.lossy, self.word_used = {}, {}, 0
            gc.collect()

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words not yet remembered, in one batch of the library, and decodes them again."""
        new = []
        for w in words:
            if w in self.words:
                continue
            if len(w) > self.long_run and _RUN.fullmatch(w.decode()):
                self.words[w] = ids = ",".join(map(str, self._encode_run(w))).encode()
                self.word_used += len(w) + len(ids) + 190
            else:
                new.append(w)
        for word, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            self.words[word] = ids = ",".join(map(str, e.ids)).encode()
            if (back := b"".join(map(self.token_bytes.__getitem__, e.ids))) != word:
                self.lossy[word] = back
            self.word_used += len(word) + len(ids) + 190

    def _encode_run(self, run: bytes) -> list[int]:
        """Ids of a long run of letters, from those of its chunks."""
        joined: list[int] = []
        start = 0
        for end in cut_points(run, self.mean):
            chunk = run[start:end]
            if chunk and chunk not in self.runs:
                self.runs[chunk] = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
                self.chunk_used += 40 * len(self.runs[chunk]) + len(chunk) + 200
            if chunk:
                self._join(joined, self.runs[chunk])
            start = end
        return joined

    def _join(self, left: list[int], right: list[int]) -> None:
        """Appends ``right`` to ``left``, encoding anew around the join until both ends agree."""
        starts = lambda i: (self.token_bytes[i][0] & 0xC0) != 0x80  # noqa: E731  (the token begins with a character)
        low, high = len(left), 0
        while True:
            was_low, was_high = low, high
            if low > 0:
                low -= 1
                while low > 0 and not starts(left[low]):
                    low -= 1
            if high < len(right):
                high += 1
                while high < len(right) and not starts(right[high]):
                    high += 1
            around = b"".join(map(self.token_bytes.__getitem__, left[low:] + right[:high])).decode()
            new = self.tokenizer.encode(around, add_special_tokens=False).ids
            head, tail = left[low:was_low], right[was_high:high]
            if (low == 0 or new[: len(head)] == head) and (high == len(right) or new[len(new) - len(tail) :] == tail):
                left[low:] = new
                left += right[high:]
                return

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, comma-joined, and its decoded bytes."""
        # A fresh start bounds the memory; results do not depend on it.
        if self.word_used > self.word_limit:
            self.words, self.lossy, self.word_used = {}, {}, 0
            self.chunks, self.runs, self.chunk_used = {}, {}, 0
        if self.chunk_used > self.chunk_limit:
            self.chunks, self.runs, self.chunk_used = {}, {}, 0
        plans: list[tuple[bytes, list[bytes | list[bytes]]]] = []
        bodies: dict[bytes, list[bytes]] = {}
        needed: set[bytes] = set()
        for text in texts:
            data = text.encode()
            bounds, plan, start, open_from = sure_positions(data), [], 0, 0
            for end in cut_points(data, self.mean):
                low, high = bisect_left(bounds, start + _CONTEXT), bisect_right(bounds, end - _CONTEXT)
                if high - low > 1:
                    first, last, chunk = bounds[low], bounds[high - 1], data[start:end]
                    plan += [seam := _slices(data, bounds, open_from, first), chunk]
                    needed.update(seam)
                    if chunk not in self.chunks and chunk not in bodies:
                        bodies[chunk] = body = _slices(data, bounds, first, last)
                        needed.update(body)
                    open_from = last
                start = end
            plan.append(seam := _slices(data, bounds, open_from, len(data)))
            needed.update(seam)
            plans.append((data, plan))
        self._learn(needed)
        word = self.words.__getitem__
        for chunk, body in bodies.items():
            self.chunks[chunk] = ids = b",".join(map(word, body))
            self.chunk_used += len(chunk) + len(ids) + 200
        results = []
        for data, plan in plans:
            parts: list[bytes] = []
            for x in plan:
                parts += map(word, x) if isinstance(x, list) else (self.chunks[x],)
            back = data if not self.lossy else b"".join(self.lossy.get(w, w) for w in _slices(data, sure_positions(data), 0, len(data)))
            results.append((b",".join(parts), back))
        return results


def load_byte_bpe(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoder(path: str, mean_chunk: int) -> ChunkEncoder:
    """The encoder of this Python worker, which keeps what it has learned from one task to the next.

    This package travels to the workers by value, so its own globals are new in
    every task; the tokenizer library's module lives as long as the worker.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_chunk_encoders", {})
    if (path, mean_chunk) not in kept:
        kept.clear()
        kept[path, mean_chunk] = ChunkEncoder(load_byte_bpe(path), mean_chunk)
    return kept[path, mean_chunk]


def forget_encoders() -> None:
    """Frees the encoders that this Python worker keeps, for tasks of other operators that follow in it."""
    library = sys.modules.get("tokenizers")
    if library is not None and vars(library).pop("_kept_chunk_encoders", None):
        gc.collect()
        pa.default_memory_pool().release_unused()
        # What the library has freed returns to the system only so, where the C library can.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def encode_documents(documents: DataFrame, tokenizer_path: str, *, mean_chunk: int = 512, batch_bytes: int = 2 << 20, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, an array, on request) of every row.

    Null counts as the empty text, which has no token; texts of any length are
    encoded whole; repeated rows stay; an empty table gives an empty result;
    other columns are ignored. Ids are hashed as decimals joined by commas. If
    decoded bytes are not UTF-8, each faulty part is replaced by U+FFFD before
    hashing, as the tokenizer's own decoder does.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer_path, mean_chunk)
        try:
            for batch in it:
                doc_ids, texts = batch.column(0), batch.column(1)
                at = 0
                while at < batch.num_rows:
                    part, size, begin = [], 0, at
                    while at < batch.num_rows and (not part or size < batch_bytes):
                        part.append(texts[at].as_py() or "")
                        size += len(part[-1])
                        at += 1
                    rows = encoder.encode(part)
                    counts = [ids.count(b",") + 1 if ids else 0 for ids, _ in rows]
                    arrays = [doc_ids[begin:at], pa.array(counts, pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in rows]), pa.array([hashlib.sha256(body.decode("utf-8", "replace").encode()).hexdigest() for _, body in rows])]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        arrays.append(pa.array([[int(i) for i in ids.split(b",")] if ids else [] for ids, _ in rows], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            encoder.rest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, schema)
