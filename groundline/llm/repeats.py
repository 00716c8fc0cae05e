"""Removal of repeated byte strings by external sorting of sampled suffixes.

Every string of ``span`` bytes that also starts earlier is removed. A full
suffix array would need a tuple for each byte of the corpus, several times the
input; instead only sampled suffixes become tuples, and what holds at their
starts is induced for all other starts:

1.  Sampling. The hash of ``gram`` bytes that is least within a string of
    ``span`` bytes marks the string's sample. Equal strings have their sample
    at the same place, so it is enough to compare strings with equal samples.
    Consecutive starts with the same sample form a run; the bytes that the
    run's strings cover are its block. A run becomes one tuple: the sample's
    name (hash of its bytes), the block's name, and where it stands.
2.  Sorting. Tuples are sorted by names and place, first those of a bounded
    part within each task, then all of them by Spark's external sort. Of
    equal blocks all but the first are repeated whole.
3.  Induction. Where one sample stands in different blocks (they share the
    sample but end to share bytes before a block's end), the strings of these
    blocks become tuples themselves and are sorted in the same way; strings
    after the first of their name are repeated.

Names are pairs of 64-bit hashes. Within each task, equal tuples are merged
before the shuffle, so a passage that a third of all documents share costs one
tuple per part, not one per document. A short passage with another surrounding
in every document is one sample in many different blocks: samples that a first
look at a part of the documents finds in many blocks are dealt out by block as
well, and all their blocks go on to step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, most_frequent, numbered

_TUPLE = "k long, b long, doc long, row long, start long, size long"
_NAMES = ["k", "b", "doc", "row", "start", "size"]
_LOW = np.uint64(0xFFFFFF)
_U = np.uint64
#: Marks the size of a run whose sample is known to stand in many blocks.
_MANY = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hasher:
    """Hashes of any byte ranges of a buffer, equal for equal bytes: polynomial sums modulo 2**64."""

    def __init__(self, seed: int, base: int, longest: int) -> None:
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._powers(longest)

    def _powers(self, longest: int) -> None:
        grow = lambda b: np.concatenate([[_U(1)], np.cumprod(np.full(longest, _U(b)), dtype=np.uint64)])
        self.up, self.down = grow(self.base), grow(self.inverse)

    def sums(self, x: np.ndarray) -> np.ndarray:
        if len(x) >= len(self.up):
            self._powers(2 * len(x))
        out = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(self.table[x] * self.up[: len(x)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[begin]) * self.down[begin])

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` bytes."""
        n = max(0, len(sums) - width)
        return _mix((sums[width:] - sums[:n]) * self.down[:n])


def _hashers(longest: int) -> tuple[Hasher, Hasher]:
    return Hasher(11, 0xD6E8FEB86659FD93 | 5, longest), Hasher(23, 0xA0761D6478BD642F, longest)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - reach : len(x) - reach + 1]) if reach < width else out


def runs(x: np.ndarray, ends: np.ndarray, names: tuple[Hasher, Hasher], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Name of the sample, name of the block, start and number of starts of each run in a buffer of texts.

    ``ends`` are the ends of the texts in the buffer (under 2**24 bytes); runs never cross them.
    """
    empty = np.zeros(0, dtype=np.uint64)
    if len(x) < span:
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second = names[0].sums(x), names[1].sums(x)
    gram_names = names[0].grams(first, gram)
    keyed = (gram_names & ~_LOW) | np.arange(len(gram_names), dtype=np.uint64)
    sample = (sliding_min(keyed, span - gram + 1) & _LOW).astype(np.int64)
    inside = np.ones(len(sample), dtype=bool)
    for end in ends[:-1].tolist():  # strings that would reach over the end of a text
        inside[max(0, end - span + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(sample[at]) != 0)
    place = np.flatnonzero(new)
    start, count = at[place], np.diff(np.append(place, len(at)))
    return gram_names[sample[start]], names[1].ranges(second, start, start + count - 1 + span), start, count


def _merge_intervals(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins intervals of one row that overlap or touch."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    new_row = np.append(True, row[1:] != row[:-1])
    group = np.cumsum(new_row) - 1
    # Ends of earlier rows must not reach into later ones: shift each row's coordinates apart.
    far = np.int64(end.max() + 2)
    reach = np.maximum.accumulate(end + group * far)
    new = new_row.copy()
    new[1:] |= (begin + group * far)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], begin[at], reach[last] - group[at] * far


def keep_first(k: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, span: int) -> pa.RecordBatch:
    """Of equal tuples the earliest; of the others, what they remove, as tuples of negative size."""
    _, rank = np.unique(np.stack([doc, row]), axis=1, return_inverse=True) if len(doc) else (None, np.zeros(0, np.int64))
    place = (rank.reshape(-1).astype(np.uint64) << _U(40)) | start.astype(np.uint64)
    order = np.lexsort((place, b, k))
    k, b, doc, row, start, size = (a[order] for a in (k, b, doc, row, start, size))
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    gone_row, begin, end = _merge_intervals(row[~new], start[~new], start[~new] + (size[~new] & (_MANY - 1)) + span - 1)
    spread = _mix(gone_row.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + begin.astype(np.uint64))
    both = [
        np.concatenate([k[new], spread]).view(np.int64),
        np.concatenate([b[new], np.zeros(len(spread), np.uint64)]).view(np.int64),
        np.concatenate([doc[new], np.zeros(len(spread), np.int64)]),
        np.concatenate([row[new], gone_row]),
        np.concatenate([start[new], begin]),
        np.concatenate([size[new], begin - end]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in both], names=_NAMES)


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], span: int, most: int) -> Iterator[pa.RecordBatch]:
    """keep_first over parts of at most about ``most`` tuples: memory stays bounded."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= most:
            yield keep_first(*map(np.concatenate, zip(*held)), span)
            held, count = [], 0
    if held:
        yield keep_first(*map(np.concatenate, zip(*held)), span)


def _buffers(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows ``from, to`` of a batch with their texts in one buffer and the ends of the texts."""
    at, texts = 0, batch.column(2)
    while at < batch.num_rows:
        begin, data, size = at, [], 0
        while at < batch.num_rows and (not data or size < most):
            data.append(texts[at].as_py())
            size += len(data[-1])
            at += 1
        yield begin, at, b"".join(data), np.cumsum([len(x) for x in data])


def _run_tuples(span: int, gram: int, buffer_bytes: int, most: int, longest: int = (1 << 24) - 1, frequent: np.ndarray | None = None) -> Callable:
    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        names = _hashers(2 * buffer_bytes)
        for batch in it:
            docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, _, data, ends in _buffers(batch, buffer_bytes):
                x = np.frombuffer(data, dtype=np.uint8)
                # A longer text is cut into overlapping sections; each string starts in one of them.
                step = longest - span + 1
                for offset in range(0, max(1, len(x) - span + 1), step):
                    section = x[offset : offset + longest]
                    k, b, start, size = runs(section, np.minimum(ends[ends > offset] - offset, len(section)), names, span, gram)
                    if frequent is not None and len(frequent):
                        many = np.isin(k, frequent)
                        k, size = np.where(many, _mix(k ^ b * _U(0x9E3779B97F4A7C15)), k), size + many * _MANY
                    start = start + offset
                    text = np.searchsorted(ends, start, side="right")
                    yield k, b, docs[begin + text], rows[begin + text], start - (ends - np.diff(ends, prepend=0))[text], size

    return lambda it: _gathered(parts(it), span, most)


def _string_tuples(span: int, most: int) -> Callable:
    """Tuples of all strings in the candidate runs of each text (columns doc, row, text, starts, sizes)."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        names = _hashers(1 << 16)
        for batch in it:
            for doc, row, text, starts, sizes in zip(*(batch.column(i) for i in range(5))):
                x = np.frombuffer(text.as_py(), dtype=np.uint8)
                sums = names[0].sums(x), names[1].sums(x)
                size = sizes.values.to_numpy()
                at = np.repeat(starts.values.to_numpy() - np.cumsum(size) + size, size) + np.arange(size.sum())
                for begin in range(0, len(at), most):
                    s = at[begin : begin + most]
                    yield names[0].ranges(sums[0], s, s + span), names[1].ranges(sums[1], s, s + span), np.full(len(s), doc.as_py()), np.full(len(s), row.as_py()), s, np.ones(len(s), np.int64)

    return lambda it: _gathered(parts(it), span, most)


def _scan(span: int) -> Callable:
    """Reads tuples in sorted order. Size 0 and less: an interval to remove; more: a run with an ambiguous sample."""

    def scanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_k = last_b = None
        waiting: tuple[np.ndarray, ...] | None = None  # the only block so far of the last sample
        for batch in it:
            if not batch.num_rows:
                continue
            k, b, doc, row, start, size = (batch.column(i).to_numpy() for i in range(6))
            gone = size < 0
            whole = np.flatnonzero(~gone)
            out = [(doc[gone], row[gone], start[gone], size[gone])]
            k, b, doc, row, start, size = (a[whole] for a in (k, b, doc, row, start, size))
            if len(k):
                new_k = np.append(k[0] != last_k, k[1:] != k[:-1])
                new_b = new_k | np.append(b[0] != last_b, b[1:] != b[:-1])
                out.append((doc[~new_b], row[~new_b], start[~new_b], -((size[~new_b] & (_MANY - 1)) + span - 1)))
                group = np.cumsum(new_k) - new_k[0]
                blocks = np.bincount(group, weights=new_b)
                carried = not new_k[0]
                if carried and blocks[0]:
                    if waiting is not None:
                        out.append(waiting)
                        waiting = None
                    blocks[0] += 1
                elif not carried:
                    waiting = None
                known = size >= _MANY
                many = new_b & ((blocks[group] > 1) | known)
                size = size & (_MANY - 1)
                out.append((doc[many], row[many], start[many], size[many]))
                if group[-1] > 0 or not carried:
                    waiting = None
                    if blocks[-1] == 1 and not known[-1]:
                        at = np.flatnonzero(new_b)[-1:]
                        waiting = doc[at], row[at], start[at], size[at]
                last_k, last_b = k[-1], b[-1]
            columns = list(map(np.concatenate, zip(*out)))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names=["doc", "row", "start", "size"])

    return scanned


def _sorted_scan(tuples: DataFrame, span: int) -> DataFrame:
    """Deals tuples out by the sample's name and scans each part in sorted order."""
    dealt = tuples.repartition(F.col("k")).sortWithinPartitions("k", "b", "doc", "row", "start")
    return dealt.mapInArrow(_scan(span), "doc long, row long, start long, size long")


_WORDS = 1 << 16


def _bits(row: Column) -> list[tuple[Column, Column]]:
    """Word and bit of a row in a Bloom filter of _WORDS longs, for two hashes."""
    return [(F.pmod(F.xxhash64(row, F.lit(s)), F.lit(_WORDS)).cast("int"), F.pmod(F.shiftright(F.xxhash64(row, F.lit(s)), 20), F.lit(64)).cast("int")) for s in (1, 2)]


def _among(row: Column, rows: DataFrame) -> Column:
    """True for all rows of ``rows`` and few others: a Bloom filter of fixed size (0.5 MB), whatever the input.

    It saves most of a shuffle; where it is full, it lets all rows pass.
    """
    hits = rows.select(F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("row"))))).alias("x"))
    words = hits.groupBy(F.col("x.w").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.b"))).alias("bits"))
    full = rows.sparkSession.range(_WORDS, numPartitions=1).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    # Sorting by word puts word w at place w of the array.
    filter_ = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("f")).scalar()
    test = F.lit(True)
    for w, b in _bits(row):
        test = test & (F.call_function("shiftright", F.get(filter_, w), b).bitwiseAND(F.lit(1).cast("long")) == 1)
    return test


def _frequent_samples(docs: DataFrame, span: int, gram: int, one_in: int, times: int, most: int = 50_000) -> np.ndarray:
    """Samples that stand in ``times`` or more blocks of one document in ``one_in``; at most ``most``, so that they fit the closure.

    The list decides only how tuples are dealt out: any list gives the same result.
    """
    part = docs.filter(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0)
    counts = part.mapInArrow(_run_tuples(span, gram, 1 << 19, 400_000), _TUPLE).filter("size > 0").groupBy(F.col("k").alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    return most_frequent(counts, most)[0].view(np.uint64)


def removed_intervals(docs: DataFrame, span: int, gram: int, one_in: int = 64, times: int = 64) -> DataFrame:
    """``row, begin, stop`` of bytes to remove (overlapping) from ``doc, row, data``."""
    frequent = _frequent_samples(docs, span, gram, one_in, times)
    tuples = docs.mapInArrow(_run_tuples(span, gram, 1 << 19, 400_000, frequent=frequent), _TUPLE)
    first = cut(_sorted_scan(tuples, span))
    runs_left = first.filter("size > 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("runs"))
    texts = docs.filter(_among(F.col("row"), first.filter("size > 0").select("row")))
    ambiguous = texts.join(runs_left, "row").select("doc", "row", "data", "runs.start", "runs.size")
    strings = _sorted_scan(ambiguous.mapInArrow(_string_tuples(span, 400_000), _TUPLE), span)
    gone = first.filter("size < 0").union(strings.filter("size < 0"))
    return gone.select("row", F.col("start").alias("begin"), (F.col("start") - F.col("size")).alias("stop"))


def _cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        removed, spans, digests = [], [], []
        for text, begins, stops in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = text.as_py()
            if begins.is_valid and len(begins.values):
                b, e = begins.values.to_numpy(), stops.values.to_numpy()
                _, b, e = _merge_intervals(np.zeros(len(b), np.int64), b, e)
                kept = b"".join(data[p:q] for p, q in zip([0, *e.tolist()], [*b.tolist(), len(data)]))
            else:
                b, kept = (), data
            removed.append(len(data) - len(kept))
            spans.append(len(b))
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.as_py()) for t in batch.column(1)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame, *, span: int = 100, gram: int = 40, one_in: int = 64, times: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Removes each byte covered by a string of ``span`` bytes that also starts
    earlier: in a smaller doc_id (null ids come first, repeated ids in the order
    of the rows) or earlier in the same text. Strings are judged on the input.
    Null counts as the empty text; texts of any length are treated whole; an
    empty table gives an empty result; other columns are ignored.
    """
    if not 0 < gram < span:
        raise ValueError("gram must be shorter than span")
    least = F.lit(-(1 << 63)).cast("long")
    rows = numbered(documents.select("doc_id", "text")).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), "row")
    docs = rows.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), "row", "data")
    gone = cut(removed_intervals(docs, span, gram, one_in, times))
    touched = _among(F.col("row"), gone.select("row"))
    spans = gone.groupBy("row").agg(F.collect_list("begin").alias("begins"), F.collect_list("stop").alias("stops"))
    marked = rows.withColumn("touched", touched)
    changed = marked.filter("touched").join(spans, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "data", "begins", "stops")
    zero = F.lit(0).cast("long")
    whole = marked.filter("NOT touched").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
    return changed.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").union(whole)
