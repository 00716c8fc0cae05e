"""Exact de-duplication through cuckoo-filter indexes of live digests.

Each text is reduced to its SHA-256. A first pass runs one index after the
other over an input partition and leaves one record per different digest of
each; the records are then dealt out by digest and a second index per shard
merges them. So copies, however many, cost one record per index, and no index
has more than a bounded number of digests: ``most`` in the first pass, and
about as many in the second, where the number of shards follows from the rows.

An index keeps a short tag of each live digest in one of two buckets. A
lookup that finds the tag verifies against the whole digests stored with that
bucket before it counts as a copy; of equal texts the row that stays is
replaced by deleting its entry and inserting the newer one. When an insertion
runs out of displacements, the index doubles and refills from the stored
digests, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered


class CuckooIndex:
    """A cuckoo filter over 32-byte digests with the live entries beside it.

    Slot ``s`` of bucket ``b`` holds a 16-bit tag; ``stored`` holds the digest
    and its value for the same slot, which verifies hits and feeds resizing.
    """

    SLOTS = 4
    MAX_MOVES = 200

    def __init__(self, buckets: int = 1024) -> None:
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.tags = [0] * (buckets * self.SLOTS)
        self.stored: list[tuple[bytes, object] | None] = [None] * (buckets * self.SLOTS)

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def _tag(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little") & self.mask

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995 >> 3)) & self.mask

    def _find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1: tag hits count only if the stored digest is the same."""
        tag, bucket = self._tag(digest), self._first(digest)
        for at in (bucket, self._other(bucket, tag)):
            for slot in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
                if self.tags[slot] == tag and self.stored[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> object | None:
        return self.stored[slot][1] if (slot := self._find(digest)) >= 0 else None

    def delete(self, digest: bytes) -> bool:
        if (slot := self._find(digest)) < 0:
            return False
        self.tags[slot], self.stored[slot] = 0, None
        self.size -= 1
        return True

    def insert(self, digest: bytes, value: object) -> None:
        """Enters a digest that is not live yet."""
        if (left_over := self._place((digest, value))) is not None:
            self._grow(left_over)

    def _place(self, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """Puts an entry into a free slot, moving others; returns the one left over if none is free."""
        tag = self._tag(entry[0])
        bucket = self._first(entry[0])
        self.size += 1
        for at in (bucket, self._other(bucket, tag)):
            for slot in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.stored[slot] = tag, entry
                    return None
        for move in range(self.MAX_MOVES):
            slot = bucket * self.SLOTS + (move + tag) % self.SLOTS
            self.tags[slot], tag = tag, self.tags[slot]
            self.stored[slot], entry = entry, self.stored[slot]
            bucket = self._other(bucket, tag)
            for slot in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.stored[slot] = tag, entry
                    return None
        return entry

    def _grow(self, left_over: tuple[bytes, object]) -> None:
        """Doubles the index and refills it from the stored digests."""
        entries = [x for x in self.stored if x is not None] + [left_over]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(x) is None for x in entries):
                return

    def entries(self) -> Iterator[tuple[bytes, object]]:
        return (x for x in self.stored if x is not None)


def _records(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    found, step = list(index.entries()), 100_000
    for at in range(0, len(found), step):
        part = found[at : at + step]
        ids = pa.array([v[0][1] if v[0][0] else None for _, v in part], pa.int64())
        rows = pa.array([v[0][2] for _, v in part], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), ids, rows, pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "doc_id", "row", "size"])


def _merge(it: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """One record per live digest: the greatest row and the sum of sizes. A full index is emptied where ``most`` is given."""
    index = CuckooIndex()
    for batch in it:
        if most is not None and len(index) >= most:
            yield from _records(index)
            index = CuckooIndex()
        digests, sizes = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        for digest, doc_id, row, size in zip(digests, batch.column(1).to_pylist(), batch.column(2).to_pylist(), sizes):
            # A null id is below any other; the row number settles ties.
            new = (doc_id is not None, doc_id or 0, row)
            live = index.get(digest)
            if live is None:
                index.insert(digest, (new, size))
            else:
                index.delete(digest)
                index.insert(digest, (max(new, live[0]), size + live[1]))
    yield from _records(index)


def digest_groups(digests: DataFrame, most: int = 400_000) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` from rows ``digest, doc_id, row``."""
    schema = "digest binary, doc_id bigint, row bigint, size bigint"
    local = digests.select("digest", "doc_id", "row", F.lit(1).cast("long").alias("size")).mapInArrow(lambda it: _merge(it, most), schema)
    n_shards = max(digests.sparkSession.sparkContext.defaultParallelism, -(-digests.count() // most))
    shards = local.repartition(n_shards, F.col("digest")).mapInArrow(_merge, schema)
    return shards.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, row, keep_id, group_size, kept, text_sha256``.

    Null counts as the empty text. Of equal texts the row with the greatest
    doc_id stays (null ids are below all others); of repeated rows with that id
    just one stays, so each group keeps exactly one row. Texts of any length are
    hashed whole. Empty tables give an empty result; other columns are ignored. ``row`` is the number that ``numbered`` gives.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = cut(numbered(documents.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), "row"))
    groups = cut(digest_groups(rows))
    several = groups.filter("group_size > 1").withColumnRenamed("digest", "group_digest")
    joined = rows.join(several, rows["digest"] == several["group_digest"], "left")
    return joined.select(
        "doc_id",
        "row",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
