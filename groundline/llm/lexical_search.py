"""Ranked lexical search over bit-sliced Bloom signatures: bounds exclude documents, the rest are rescored exactly.

*Index.* Documents of like size share a block. Each has a Bloom filter of the
block's width over pairs (term, level): level j says that the term occurs
``LEVELS[j]`` times or more. The filters are stored sliced: for every bit one
bitmap over the block's documents. One pass over the texts builds the blocks
and counts what the weights need (documents, terms, and the document frequency
of the searches' terms).

*Bounds.* The AND of a pair's slices is a bitmap of documents that overestimates
where the term stands, level by level, so it bounds its frequency from above;
the weighted sum of the gains of all of a search's slices bounds the score.

*Search.* The ten documents with the greatest bounds are rescored first. Their
scores give each search a threshold; every document whose bound cannot be
proved to lie behind the tenth of them is rescored from its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .repeats import _among

#: Frequencies that the signatures tell apart.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256, 512, 1024, 4096, 16384], dtype=np.int64)
PROBES = 4
#: Bits of a filter for each pair of the largest document of its block.
BITS = 10
#: Bits of a block's slices at most (a larger filter is a block of eight documents).
BLOCK_BITS = 1 << 23
#: Stands for a missing id; a row that has this id is rescored with those, which changes no result.
NO_ID = -(1 << 63)

_TERMS = bytes.maketrans(bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)))
_INDEX = "n_docs long, n_terms long, ids array<long>, lengths array<long>, width long, slices binary, dfs array<long>"


def terms(data: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII of a UTF-8 text, A-Z lower-cased."""
    return data.translate(_TERMS).split()


def length_norm(n: np.ndarray | int, n_docs: int, n_terms: int):
    """The part of a document's length in its scores."""
    return 25 + 75 * n * n_docs // max(1, n_terms)


def gain(tf, norm):
    """What a weight of one earns for ``tf`` occurrences; grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits (one row of PROBES per hash) of pairs (term, level) in a filter of ``width`` bits."""
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(width)


def sliced(docs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The slices (one row of packed bits per bit of the filters) of documents given as term hashes and counts."""
    plane = np.zeros((width, len(docs)), dtype=bool)
    hashes, counts = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    place = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    for level, least in enumerate(LEVELS):
        more = counts >= least
        hashes, counts, place = hashes[more], counts[more], place[more]
        if not len(hashes):
            break
        plane[positions(hashes, level, width), place[:, None]] = True
    return np.packbits(plane, axis=1)


def levels_of(slices: np.ndarray, n_docs: int, hashes: np.ndarray) -> np.ndarray:
    """For each term and document, how many levels the term may reach there (at least those that it does)."""
    out = np.zeros((len(hashes), n_docs), dtype=np.uint8)
    live, reached = np.arange(len(hashes)), None
    for level in range(len(LEVELS)):
        both = np.bitwise_and.reduce(slices[positions(hashes[live], level, len(slices))], axis=1)
        reached = both if reached is None else both & reached
        some = reached.any(axis=1)
        live, reached = live[some], reached[some]
        if not len(live):
            break
        out[live] += np.unpackbits(reached, axis=1, count=n_docs)
    return out


class Searches:
    """Items of one group: their terms with how often each is asked for and, once counted, weights."""

    def __init__(self, texts: list[str | None]) -> None:
        asked = [Counter(terms((t or "").encode())) for t in texts]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*asked)))}
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))
        order = [sorted((self.vocabulary[t], n) for t, n in x.items()) for x in asked]
        self.place = [np.array([k for k, _ in x], dtype=np.int64) for x in order]
        self.times = [np.array([n for _, n in x], dtype=np.int64) for x in order]

    def weigh(self, n_docs: int, n_terms: int, dfs: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs.get(k, 0) + 1))) for k in range(len(self.vocabulary))], dtype=np.int64)
        self.weights = [weight[p] * t for p, t in zip(self.place, self.times)]

    def score(self, data: bytes, items: list[int]) -> list[int]:
        """The exact scores of one text for some items."""
        words = terms(data)
        tf = np.zeros(len(self.vocabulary), dtype=np.int64)
        counts = Counter(words)
        for t in counts.keys() & self.vocabulary.keys():
            tf[self.vocabulary[t]] = counts[t]
        earned = gain(tf, length_norm(len(words), self.n_docs, self.n_terms))
        return [int(self.weights[i] @ earned[self.place[i]]) for i in items]

    def bounds(self, slices: np.ndarray, lengths: np.ndarray, chunk: int = 4096, part: int = 1024) -> np.ndarray:
        """No document of a block scores more than this (one row per item)."""
        total = np.zeros((len(self.place), len(lengths)), dtype=np.int64)
        norm = length_norm(lengths, self.n_docs, self.n_terms)
        for first in range(0, len(self.vocabulary), chunk):
            levels = levels_of(slices, len(lengths), self.hashes[first : first + chunk])
            # The greatest frequency that a number of reached levels leaves open.
            tops = range(int(levels.max(initial=0)) + 1)
            earned = np.stack([gain(np.minimum(LEVELS[k] - 1, lengths) if k < len(LEVELS) else lengths, norm) for k in tops])
            asked = [(i, slice(*np.searchsorted(p, (first, first + chunk)))) for i, p in enumerate(self.place)]
            for at in range(0, len(lengths), part):
                columns = np.arange(at, min(at + part, len(lengths)))
                each = earned[levels[:, columns], columns]
                for i, mine in asked:
                    if mine.start < mine.stop:
                        total[i, columns] += self.weights[i][mine] @ each[self.place[i][mine] - first]
        return total


def _indexed(searches: Searches):
    """Blocks of a task's documents (columns id, data), and in its last row the document frequencies of the searches' terms."""

    def row(docs=(), width=0, dfs=None) -> pa.RecordBatch:
        ids, lengths, filters = (list(x) for x in zip(*docs)) if docs else ([], [], [])
        packed = sliced(filters, width).tobytes() if docs else None
        values = [len(docs), sum(lengths), ids, lengths, width, packed, dfs]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["n_docs", "n_terms", "ids", "lengths", "width", "slices", "dfs"])

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known = xxhash.xxh64_intdigest, searches.vocabulary
        dfs, open_blocks = np.zeros(len(known), dtype=np.int64), {}
        for batch in it:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                words = terms(value.as_py() or b"")
                if not words:
                    continue
                tf = Counter(words)
                for t in tf.keys() & known.keys():
                    dfs[known[t]] += 1
                counts = np.fromiter(tf.values(), dtype=np.int64, count=len(tf))
                entry = np.fromiter(map(digest, tf), dtype=np.uint64, count=len(tf)), counts
                pairs = int(np.searchsorted(LEVELS, counts, side="right").sum())
                width = BITS * max(64, 1 << (pairs - 1).bit_length())
                block = open_blocks.setdefault(width, [])
                block.append((doc_id.as_py(), len(words), entry))
                if len(block) >= max(8, BLOCK_BITS // width // 8 * 8):
                    yield row(open_blocks.pop(width), width)
        for width in sorted(open_blocks):
            yield row(open_blocks[width], width)
        yield row(dfs=dfs.tolist())

    return build


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, lengths and slices of each block (columns ids, lengths, width, slices)."""
    for batch in it:
        for ids, lengths, width, packed in zip(*batch.columns):
            yield ids.values.to_numpy(), lengths.values.to_numpy(), np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(width.as_py(), -1)


def _greatest_bounds(searches: Searches, top: int):
    """``item, key, bound``: for each item, the ``top`` greatest bounds of a task's documents."""

    def seeds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in searches.place]
        least = np.zeros(len(best), dtype=np.int64)
        for ids, lengths, slices in _blocks(it):
            bounds = searches.bounds(slices, lengths)
            for i in np.flatnonzero(bounds.max(axis=1, initial=0) > least):
                more = np.flatnonzero(bounds[i] > least[i])
                b, k = np.concatenate([best[i][0], bounds[i, more]]), np.concatenate([best[i][1], ids[more]])
                keep = np.lexsort((k, -b))[:top]
                best[i] = b[keep], k[keep]
                if len(keep) == top:
                    least[i] = b[keep[-1]]
        sizes = [len(b) for b, _ in best]
        arrays = [np.repeat(np.arange(len(best), dtype=np.int32), sizes), np.concatenate([k for _, k in best] or [[]]), np.concatenate([b for b, _ in best] or [[]])]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "key", "bound"])

    return seeds


def _not_excluded(searches: Searches, scores: np.ndarray, keys: np.ndarray):
    """``item, key`` of every document that may come before the one with ``scores`` and ``keys`` of its item."""

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, slices in _blocks(it):
            bounds = searches.bounds(slices, lengths)
            order = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)
            item, place = np.nonzero((bounds > scores[:, None]) | ((bounds == scores[:, None]) & (bounds > 0) & (order[None, :] <= keys[:, None])))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids[place], pa.int64())], names=["item", "key"])

    return candidates


def _rescored(searches: Searches):
    """``item, doc_id, score`` of each text (columns key, data, items) for its items."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key, data, items in zip(*batch.columns):
                mine = items.as_py()
                doc_id = None if key.as_py() == NO_ID else key.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array([doc_id] * len(mine), pa.int64()), pa.array(searches.score(data.as_py() or b"", mine), pa.int64())], names=["item", "doc_id", "score"])

    return score


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)


def _search(docs: DataFrame, texts: list[str | None], top: int) -> DataFrame:
    """``item, rank, doc_id, score`` for one group of searches over ``docs`` (key, data)."""
    searches = Searches(texts)
    index = cut(docs.mapInArrow(_indexed(searches), _INDEX))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # One number per term of the group, whatever the documents are.
    dfs = index.filter("dfs IS NOT NULL").select(F.posexplode("dfs").alias("term", "df")).filter("df > 0").groupBy("term").agg(F.sum("df").alias("df"))
    searches.weigh(n_docs, n_terms, {r["term"]: r["df"] for r in dfs.collect()})
    blocks = index.filter("n_docs > 0").select("ids", "lengths", "width", "slices")

    def rescored(pairs: DataFrame, few: bool) -> DataFrame:
        asked = pairs.groupBy("key").agg(F.collect_set("item").alias("items"))
        if few:
            both = docs.join(F.broadcast(asked), "key")
        else:
            both = docs.filter(_among(F.col("key"), asked.select(F.col("key").alias("row")))).join(asked, "key")
        return both.select("key", "data", "items").mapInArrow(_rescored(searches), "item int, doc_id long, score long")

    greatest = blocks.mapInArrow(_greatest_bounds(searches, top), "item int, key long, bound long")
    first = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    # At most top ids per item of the group; equal ids give several rows, all of them real.
    seeds = greatest.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top).select("item", "key")
    tenth = _ranked(rescored(seeds, few=True), top).filter(F.col("rank") == top).collect()
    scores, keys = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), np.iinfo(np.int64).max)
    for r in tenth:
        scores[r["item"]] = r["score"]
        keys[r["item"]] = np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"]
    left = cut(blocks.mapInArrow(_not_excluded(searches, scores, keys), "item int, key long"))
    return _ranked(rescored(left, few=False), top)


def search(documents: DataFrame, items: DataFrame, *, top: int = 10, group_items: int = 500, group_bytes: int = 1 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents (``doc_id, text``) of every item (``item_id, text``), with scores above 0.

    Equal scores rank by ascending doc_id; rows without an id come last of
    these, with a null doc_id; rows that share an id are documents of their own.
    Null and empty texts have no terms: such documents are found by no item and
    such items find nothing. Texts of any length count whole. Equal rows of
    ``items`` are one item; rows with one item_id and different texts are ranked
    apart. Items are searched in groups of at most ``group_items`` that hold
    ``group_bytes`` (or one longer text), so that what is sent to the workers is
    bounded; each group makes its own pass. Other columns are ignored; an empty
    table on either side gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("text").cast("binary").alias("data"))
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().select(F.monotonically_increasing_id().alias("n"), "item_id", "text"))
    groups, size = [[]], 0
    # Rows come one partition at a time, only those of the group at hand are held with their texts.
    for r in asked.select("n", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).toLocalIterator():
        if groups[-1] and (len(groups[-1]) >= group_items or size + r["size"] > group_bytes):
            groups, size = [*groups, []], 0
        groups[-1].append(r["n"])
        size += r["size"]
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for numbers in groups:
        part = sorted((r["n"], r["item_id"], r["text"]) for r in asked.filter(F.col("n").isin(numbers)).collect())
        if part:
            ids = F.array(*(F.lit(i).cast("long") for _, i, _ in part))
            ranked = _search(docs, [t for _, _, t in part], top)
            found = found.union(ranked.select(F.get(ids, F.col("item")).alias("item_id"), "rank", "doc_id", "score"))
    return found
