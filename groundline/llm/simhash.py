"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits from the XXH64 hashes of a document's word shingles.
A fingerprint is two segments of 32 bits, and there is a table for each. Two
fingerprints at distance 2 or less differ by one bit at most in one of the
segments; so each fingerprint is entered in a segment's table under its value
there, and looks that value and its ball up: the values with one bit more. (Of
two values at one bit, one has the bit more, so half the ball is enough.) What
meets under a key is a candidate, whose complete distance is verified.

Many different fingerprints may agree in one segment. Keys under which more
than ``most`` entries meet are counted first, and their fingerprints are linked
in another exact way: by balls of radius 1 around whole fingerprints. Two that
are at distance 2 or less share a point there, and no point is shared by more
than 65, so no group is unbounded. Equal fingerprints are merged before the
search: copies cost one entry.

``wide_candidates`` looks further with the same two tables, for callers that
verify texts: see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut

_BLOCK = 65536


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; zero if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(x) for x in zip(*(words[k:] for k in range(width)))]
    return majority(np.fromiter((digest(x, seed) for x in joined), dtype=np.uint64, count=len(joined)))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of hashes (64 bits each): a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, row, fp`` of every row: fp is the fingerprint as a signed long, row numbers the rows of this run."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return docs.mapInArrow(batches, "doc_id long, row long, fp long")


def _entries(unique: DataFrame) -> DataFrame:
    """``segment, value, own, fp``: each fingerprint under its own value in both tables, and under the values with one bit more."""
    low = F.lit(0xFFFFFFFF).cast("long")

    def keys(segment: int, value: Column) -> Column:
        more = F.transform(F.filter(F.array(*(F.lit(1 << k).cast("long") for k in range(32))), lambda bit: value.bitwiseAND(bit) == 0), lambda bit: value.bitwiseOR(bit))
        point = lambda own: lambda v: F.struct(F.lit(segment).alias("segment"), v.alias("value"), F.lit(own).alias("own"))
        return F.concat(F.transform(F.array(value), point(True)), F.transform(more, point(False)))

    high = F.shiftrightunsigned("fp", 32)
    both = F.concat(keys(0, high), keys(1, F.col("fp").bitwiseAND(low)))
    return unique.select("fp", F.explode(both).alias("k")).select("k.segment", "k.value", "k.own", "fp")


def _ball_links(unique: DataFrame) -> DataFrame:
    """Fingerprints that share a point within one bit, each with the least one there."""
    flips = F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)))
    ball = F.concat(F.array(F.col("fp")), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    met = unique.select("fp", F.explode(ball).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("met")).filter(F.size("met") > 1)
    return met.select(F.array_min("met").alias("a"), F.explode("met").alias("b"))


def links(unique: DataFrame, max_distance: int = 2, most: int = 256) -> DataFrame:
    """Links ``a, b`` whose connected components are those of all pairs at ``max_distance`` or less of the fingerprints (column ``fp``, distinct)."""
    if not 0 <= max_distance <= 2:
        raise ValueError("two segments and radius 1 cover distances up to 2")
    entries = _entries(unique)
    crowded = cut(entries.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("segment", "value"))
    n_crowded = crowded.count()
    if n_crowded:
        # Thousands of keys are small enough to broadcast; more are left to Spark.
        known = F.broadcast(crowded) if n_crowded <= 100_000 else crowded
        whole = _ball_links(entries.join(known, ["segment", "value"], "left_semi").select("fp").distinct())
        entries = entries.join(known, ["segment", "value"], "left_anti")
    tables = entries.groupBy("segment", "value").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("near"))
    each = tables.filter((F.size("own") > 0) & (F.size("own") + F.size("near") > 1)).select(F.explode("own").alias("a"), F.concat("own", "near").alias("others"))
    found = each.select("a", F.explode("others").alias("b"))
    if n_crowded:
        found = found.union(whole)
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return found.filter((F.col("a") != F.col("b")) & (distance <= max_distance)).distinct()


def wide_candidates(unique: DataFrame, max_distance: int = 11) -> DataFrame:
    """Candidates ``a, b`` among distinct fingerprints (column ``fp``): at most 2 bits apart in one of the segments, ``max_distance`` as a whole.

    A fingerprint is entered in a segment's table at the 33 points within one
    bit of its value: two values share a point if they are 2 bits apart at
    most, which holds in a segment for every pair at distance 5 or less and for
    a part of those further apart. At a point each fingerprint meets the least
    there and the one before it, and is proposed with the nearest and the least
    that it met anywhere: so candidates are linear in the fingerprints, however
    many meet at a point. These are proposals: what they miss is for the caller
    to find.
    """
    bits = F.array(*(F.lit(b).cast("long") for b in [0, *(1 << k for k in range(32))]))
    values = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    # The segment in the bit above its values: one key for both tables.
    points = F.flatten(F.transform(values, lambda v, segment: F.transform(bits, lambda bit: v.bitwiseXOR(bit).bitwiseOR(F.shiftleft(segment.cast("long"), 32)))))
    at = Window.partitionBy("point").orderBy("fp")
    entries = unique.select("fp", F.explode(points).alias("point")).select("fp", F.first("fp").over(at).alias("first"), F.lag("fp").over(at).alias("before"))
    met = entries.filter("before IS NOT NULL").select(F.col("fp").alias("b"), F.explode(F.array("first", "before")).alias("a"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    best = met.filter(distance <= max_distance).groupBy("b").agg(F.min(F.struct(distance.alias("d"), F.col("a"))).alias("nearest"), F.min("a").alias("least"))
    return best.select(F.explode(F.array_distinct(F.array("nearest.a", "least"))).alias("a"), "b")


def near_duplicates(documents: DataFrame, *, width: int = 3, seed: int = 42, max_distance: int = 2) -> DataFrame:
    """``doc_id, row, fp, component_id, kept`` of every row of ``documents``.

    component_id is the least doc_id that the row reaches over links, itself
    included; the first row with that id is the one of the group to keep. Null
    and empty texts have fingerprint zero and are linked like any other; texts
    of any length count whole; repeated rows stay; other columns are ignored; null ids come after all others (a group of null ids
    only has a null id); an empty table gives an empty result.
    """
    docs = cut(fingerprints(documents, width, seed))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    unique = cut(docs.groupBy("fp").agg(F.min(first).alias("least")))
    labels = connected_components(links(unique, max_distance))
    rooted = unique.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("group"))
    component = rooted.join(roots, "root").select("fp", "group")
    return docs.join(component, "fp").select("doc_id", "row", "fp", F.col("group.doc_id").alias("component_id"), (F.col("row") == F.col("group.row")).alias("kept"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
