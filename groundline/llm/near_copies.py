"""Near copies: all pairs of documents whose sets of word shingles have a Jaccard similarity of ``least`` or more.

SimHash comes first: 64-bit fingerprints of the same shingles, tables of their
two 32-bit segments looked up by balls, whole distance, then the whole sets
(``simhash_pairs``). That joins the nearest of the near copies. No radius reaches
all of them: at a similarity of 0.8 fingerprints lie about ten bits apart, and
tables that reach this far make candidates with the square of the corpus.

An exact join follows, for the pairs that are still in different components.
Every document's shingle hashes are put in one
global order: hash order, but those that a sample finds frequent come last, the
most frequent at the end. Of two sets A and B with |A & B| >= least |A or B|, the
first |A| - ceil(least |A|) + 1 shingles of A and the like of B share one (prefix
filter), so documents meet under the shingles of their prefixes; sizes must fit
(length filter), and they must meet often enough for what is left of the sets
(positional filter).

Frequent shingles need more care, as many documents may meet under one. A
document meets others there only if its rarer shingles do not fill its prefix.
Then its prefix has all of them, and what it shares with a document that has
none of these is frequent: of f frequent shingles, at most f. So such a pair
needs |A| + |B| <= f (1 + least) / least for the f of either: pages that hold a
common passage but more words of their own than the threshold allows meet
nobody, and the others only partners of sizes that fit, which are part of the
key. Each row carries a sketch there, too: the parities of how many of its
shingles fall on each of 512 bits. Sketches differ in no more bits than sets in
shingles, so most pairs that are too far apart are never formed.

The exact join takes pairs in two rounds, both verified by the whole sets. In the first,
each document under a shingle is compared with the smallest there and with the
one before it (for frequent shingles: with the one of its size band that has the
fewest rare shingles, and these band by band), which joins groups of near copies
at a cost linear in their size. In the second, documents under a shingle that are still in different
components are compared. So the components are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunk_encode import forget_encoders
from .common import connected_components, cut, most_frequent
from .repeats import _among
from .simhash import majority, wide_candidates

_ENTRY = "key long, row long, n int, f int, rest int"
#: Longs of a sketch.
_SKETCH = 8
_SKETCHED = _ENTRY + "".join(f", b{k} long" for k in range(_SKETCH))
_PRINT = "row long, fp long, n int" + "".join(f", b{k} long" for k in range(_SKETCH))
#: Edges in a part of the tables from round to round of the components.
_EDGES = 200_000
#: Sizes within this factor are one band.
_BAND = 1.05


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64).view(np.int64)
    digest = xxhash.xxh64_intdigest
    joined = (b" ".join(x) for x in zip(*(words[k:] for k in range(width))))
    return np.unique(np.fromiter((digest(x, seed) for x in joined), dtype=np.uint64, count=len(words) - width + 1).view(np.int64))


def is_near(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _in_batches(parts: Iterator[tuple[np.ndarray, ...]], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*held)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SKETCHED.split(", ")][: len(columns)])

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _all_shingles(width: int) -> Callable:
    """``key`` of every shingle of each text (columns row, text)."""

    def of_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in it:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width))], names=["key"])

    return of_texts


def prefixes(keys: np.ndarray, rank: np.ndarray, places: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The rare and the frequent shingles of a set's prefix, and how many frequent ones the set has.

    ``rank`` holds the frequent shingles, sorted, ``places`` their places in the global order.
    """
    size = len(keys) - math.ceil(least * len(keys) - 1e-9) + 1
    at = np.searchsorted(rank, keys)
    late = (at < len(rank)) & (rank[np.minimum(at, max(0, len(rank) - 1))] == keys) if len(rank) else np.zeros(len(keys), dtype=bool)
    rare, frequent = keys[~late], keys[late][np.argsort(places[at[late]], kind="stable")]
    return rare[:size], frequent[: max(0, size - len(rare))], len(frequent)


def sketch(keys: np.ndarray) -> np.ndarray:
    """The parities of how many of ``keys`` fall on each bit of ``_SKETCH`` longs."""
    odd = np.bincount((keys & (64 * _SKETCH - 1)).astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _entries(width: int, least: float, order: tuple[np.ndarray, np.ndarray], frequent: bool) -> Callable:
    """``key, row, n, f, rest`` of the rare or the frequent prefix shingles of each text (columns row, text).

    ``f`` counts the set's frequent shingles, ``rest`` those behind its prefix. Sets of which too little
    is frequent to be near another by that alone have no frequent entries; those of the others have a sketch.
    """

    def of_texts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        forget_encoders()
        for batch in it:
            for row, text in zip(batch.column(0), batch.column(1)):
                keys = shingle_set(text.as_py(), width)
                n = len(keys)
                rare, late, f = prefixes(keys, *order, least)
                mine, behind = (late, n - len(rare) - len(late)) if frequent else (rare, n - len(rare))
                if frequent and f < least * n - 1e-9:
                    continue
                bits = [(b, np.int64) for b in sketch(keys)] if frequent and len(mine) else []
                if len(mine):
                    yield mine, *(np.full(len(mine), x, kind) for x, kind in ((row.as_py(), np.int64), (n, np.int32), (f, np.int32), (behind, np.int32), *bits))

    return lambda it: _in_batches(of_texts(it))


def _frequent(docs: DataFrame, width: int, one_in: int, times: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``times`` or more of a sample of the documents have (sorted), and their places in the order of frequency.

    At most ``most``, so that they fit the closure. They decide only what is compared first: any list gives the same result.
    """
    sample = docs.filter(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0)
    counts = sample.mapInArrow(_all_shingles(width), "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    keys, n = most_frequent(counts, most)
    places = np.empty(len(keys), dtype=np.int64)
    places[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys, places


def _verified(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are near."""

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in it:
            near, last = [], (None, None)
            for a, left, right in zip(batch.column(0), batch.column(2), batch.column(3)):
                if last[0] != a.as_py():
                    last = a.as_py(), shingle_set(left.as_py(), width)
                near.append(is_near(last[1], shingle_set(right.as_py(), width), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    rows = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    texts = docs.filter(_among(F.col("row"), rows))
    left = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("row").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _sized(least: float) -> Column:
    """Whether the sizes of ``s`` and ``l`` (structs with n) fit."""
    return F.least("s.n", "l.n") >= least * F.greatest("s.n", "l.n") - 1e-9


def _most_apart(together: Column, least: float) -> Column:
    """In how many shingles two near sets of ``together`` shingles can differ."""
    return together - 2 * F.ceil(least / (1 + least) * together - 1e-9)


def _differing(s: list[Column], l: list[Column]) -> Column:  # noqa: E741
    """The bits in which two sketches differ."""
    each = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(s, l)]
    return sum(each[1:], each[0])


def _prints(width: int) -> Callable:
    """``row, fp, n, b0 ...`` of each text (columns row, text): its set's SimHash fingerprint, size and sketch."""

    def of_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in it:
            fps, sizes = np.empty(batch.num_rows, dtype=np.uint64), np.empty(batch.num_rows, dtype=np.int32)
            bits = np.empty((_SKETCH, batch.num_rows), dtype=np.int64)
            for k, text in enumerate(batch.column(1)):
                keys = shingle_set(text.as_py(), width)
                fps[k], sizes[k], bits[:, k] = majority(keys), len(keys), sketch(keys)
            columns = [batch.column(0), *(pa.array(x) for x in (fps.view(np.int64), sizes, *bits))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PRINT.split(", ")])

    return of_texts


def simhash_pairs(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs ``a, b`` of rows (``row, text``) that SimHash proposes: of equal fingerprints, each with the first; of near ones, the first rows.

    Left out are those whose sizes or sketches show that their sets are too far apart.
    """
    prints = cut(docs.select("row", "text").mapInArrow(_prints(width), _PRINT))
    side = F.struct("row", "n", *(f"b{k}" for k in range(_SKETCH)))
    unique = cut(prints.groupBy("fp").agg(F.min(side).alias("head"), F.count("*").alias("rows")))
    equal = prints.join(unique.filter("rows > 1"), "fp").filter(F.col("row") != F.col("head.row")).select(F.col("head").alias("s"), side.alias("l"))
    near = wide_candidates(unique.select("fp"))
    for end, name in (("a", "s"), ("b", "l")):
        near = near.join(unique.select(F.col("fp").alias(end), F.col("head").alias(name)), end)
    bits = [[F.col(f"{name}.b{k}") for k in range(_SKETCH)] for name in ("s", "l")]
    could = _sized(least) & (_differing(*bits) <= _most_apart(F.col("s.n") + F.col("l.n"), least))
    return equal.union(near.select("s", "l")).filter(could).select(F.col("s.row").alias("a"), F.col("l.row").alias("b"))


def _further(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the components that ``edges`` (a, b) join made one."""
    if edges.isEmpty():
        return labels
    # Only the components that the new pairs join are joined, not their rows anew.
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
    joined = connected_components(edges, _EDGES).select(F.col("node").alias("label"), F.col("label").alias("further"))
    # A row without a pair before is a component of its own.
    alone = joined.select(F.col("label").alias("node")).join(labels.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    return labels.unionByName(alone).join(joined, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return pairs.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(_BAND)).cast("int")


def near_components(docs: DataFrame, *, width: int = 5, least: float = 0.8, one_in: int = 16, times: int = 4, most: int = 50_000) -> DataFrame:
    """``node, label``: the components of all pairs of rows (``row, text``) at ``least`` or more; rows without a pair have none.

    Each row must have the same number whenever ``docs`` is read. Null and empty
    texts are one (empty) shingle and so are copies of each other; texts of any
    length count whole; other columns are ignored; an empty table has no pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    docs = docs.select("row", "text")
    by_simhash = connected_components(cut(_verified(cut(simhash_pairs(docs, width, least)), docs, width, least)), _EDGES)
    order = _frequent(docs, width, one_in, times, most)
    side = lambda: F.struct(F.col("n").alias("n"), F.col("row").alias("row"), F.col("rest").alias("rest"))
    reach = lambda f: (1 + least) / least * f + 1e-6  # noqa: E731  (the most that the sizes of a pair may sum to)

    place = Window.partitionBy("key").orderBy("n", "row")
    rare = docs.mapInArrow(_entries(width, least, order, False), _ENTRY).drop("f")
    rare = rare.withColumn("first", F.first(side()).over(place)).withColumn("before", F.lag(side()).over(place)).withColumn("after", F.lead("row").over(place))
    rare = cut(rare.filter("before IS NOT NULL OR after IS NOT NULL").drop("after"))
    # Of these there may be any number under a key, so none is dealt to one task by it: heads are combined before they meet.
    late = cut(docs.mapInArrow(_entries(width, least, order, True), _SKETCHED).withColumn("band", _band(F.col("n"))))
    # The head is the row with the fewest shingles of its own: in a group of near copies the one that differs least from the others.
    heads = late.groupBy("key", "band").agg(F.min_by(side(), F.struct(F.col("n") - F.col("f"), F.col("n"), F.col("row"))).alias("head"))
    steps = heads.select("key", (F.col("band") + 1).alias("band"), F.col("head").alias("lower"))

    def enough(pairs: DataFrame, part: float = 1.0) -> DataFrame:
        """Pairs of structs ``s`` and ``l`` (n, row, rest) that meet often enough: a common shingle that is not met lies behind one of the prefixes."""
        sized = pairs.groupBy(F.col("s.row").alias("a"), F.col("l.row").alias("b")).agg(F.count("*").alias("met"), F.first(F.col("s.n") + F.col("l.n")).alias("sum"), F.first(F.greatest("s.rest", "l.rest")).alias("rest"))
        need = F.ceil(least / (1 + least) * F.col("sum") - 1e-9) - F.col("rest")
        return sized.filter(F.col("met") >= part * need).select("a", "b")

    fits = _sized(least) & (F.col("s.row") != F.col("l.row"))
    by_rare = rare.select(F.explode(F.array_distinct(F.array("first", "before"))).alias("s"), side().alias("l")).filter("s IS NOT NULL")
    by_head = late.join(heads, ["key", "band"]).select(F.col("head").alias("s"), side().alias("l"))
    by_step = heads.join(steps, ["key", "band"]).select(F.col("lower").alias("s"), F.col("head").alias("l"))
    # Not all common shingles are counted here: what is left out is taken in the second round.
    tried = cut(_apart(enough(by_rare.union(by_head).union(by_step).filter(fits), 1 / 3), by_simhash))
    labels = cut(_further(by_simhash, cut(_verified(tried, docs, width, least))))

    def parted(entries: DataFrame) -> DataFrame:
        return entries.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("label", "row")).drop("label")

    across = (F.col("s_part") != F.col("l_part")) & ((F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.row") < F.col("l.row")))) & fits
    role = lambda name, *more: (*more, side().alias(name), F.col("part").alias(f"{name}_part"))
    left = parted(rare.select("key", "row", "n", "rest"))
    mixed = left.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    left = left.join(mixed, "key")
    rest = enough(left.select(*role("s", "key")).join(left.select(*role("l", "key")), "key").filter(across))
    # Under frequent shingles, a row looks for smaller ones in the bands that its frequent shingles leave open.
    most_small = F.least(F.col("n").cast("double"), reach(F.col("f")) - F.col("n"))
    able = parted(late)
    bits = lambda name: [F.col(f"b{k}").alias(f"{name}{k}") for k in range(_SKETCH)]
    small = able.filter(reach(F.col("f")) >= 2 * F.col("n")).select(*role("s", "key", "band", F.col("f").alias("s_f"), *bits("s")))
    large = able.filter(most_small >= F.ceil(least * F.col("n") - 1e-9)).withColumn("open", F.sequence(_band(F.ceil(least * F.col("n") - 1e-9)), _band(F.floor(most_small))))
    large = large.select(*role("l", "key", F.explode("open").alias("band"), F.col("f").alias("l_f"), *bits("l")))
    together = F.col("s.n") + F.col("l.n")
    apart = _differing(*([F.col(f"{name}{k}") for k in range(_SKETCH)] for name in ("s", "l")))
    few = across & (together <= reach(F.least("s_f", "l_f"))) & (apart <= _most_apart(together, least))
    rest = rest.union(enough(small.join(large, ["key", "band"]).filter(few))).distinct().join(tried, ["a", "b"], "left_anti")
    return _further(labels, cut(_verified(cut(rest), docs, width, least)))


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """``row`` of all but one of each group of near copies: all but the one with the least doc_id (null ids last), then row.

    ``docs`` has ``doc_id, row, text``.
    """
    labels = near_components(docs, **how).withColumnRenamed("node", "row")
    # Only rows that have a pair: the rest of the documents is not shuffled.
    named = labels.join(docs.select("row", "doc_id"), "row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    kept = named.groupBy("label").agg(F.min(first).alias("kept"))
    return named.join(kept, "label").filter(F.col("row") != F.col("kept.row")).select("row")
