"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.sources.checkpoints import cut, ensure_checkpoint_dir  # noqa: F401  (shared with the rest of this subpackage)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda, Spark evaluates an outer expression anew for every
    element; a lambda variable over a one-element array pins it.
    """
    return F.transform(F.array(value), body)[0]


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank give an empty one.

    Plain replacements and a split at one literal character cost a fraction
    of a split by a pattern.
    """
    for control in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(control), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def _scanned(documents: DataFrame) -> bool:
    """Whether every row is one row of a file: a plain scan, with columns and rows left out at most."""
    plan = documents._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.children().isEmpty() and plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(documents: DataFrame, name: str = "row") -> DataFrame:
    """Adds a number to every row that is the same whenever the result is read.

    Rows of stored tables are numbered by file and place in the file, which do
    not depend on how Spark packs files into partitions. Other rows are written
    to the checkpoint folder with their numbers.
    """
    if _scanned(documents):
        try:
            places = documents.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_at"))
        except AnalysisException:  # a format that does not number its rows
            places = None
        if places is not None:
            # From Arrow, as rows of Python objects would pass through Python workers of their own, which stay on every executor.
            files = sorted(r[0] for r in places.select(f"{name}_file").distinct().collect())
            index = documents.sparkSession.createDataFrame(pa.table({f"{name}_file_index": pa.array(range(len(files)), pa.int64()), f"{name}_file": pa.array(files, pa.string())}))
            number = F.shiftleft(f"{name}_file_index", 40).bitwiseOR(F.col(f"{name}_at")).alias(name)
            return places.join(F.broadcast(index), f"{name}_file").select(*(F.col(f"`{c}`") for c in documents.columns if c != name), number)
    return cut(documents.select(*(F.col(f"`{c}`") for c in documents.columns if c != name), F.monotonically_increasing_id().alias(name)))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``counts`` (``key, n``) with the greatest n, ``most`` or fewer, sorted by key; and their n.

    Keys with equal n are all in or all out, so that nothing has to be sorted on the driver.
    """
    counts = cut(counts)
    sizes = sorted(((r["n"], r["keys"]) for r in counts.groupBy("n").agg(F.count("*").alias("keys")).collect()), reverse=True)
    least, taken = None, 0
    for n, keys in sizes:
        if taken + keys > most:
            break
        least, taken = n, taken + keys
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = counts.filter(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, in_a_part: int | None = None) -> DataFrame:
    """Labels the nodes of an undirected graph with the smallest node they reach.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns
    ``node, label``, one row per node that has an edge to another. Every edge
    carries the places where its ends are now. In each round places are ordered
    by a hash that is new in every round; each is hooked to the least of itself
    and its neighbours, and on to where that one goes, and the edges move along.
    Whatever the graph looks like, only a part of the places is expected to be
    left, so the rounds grow with the logarithm of the largest component. A
    round is one query; its table is checkpointed and replaces the last one's,
    so a lost executor costs one round at most. With ``in_a_part``, that table
    has no more parts than its rows need at so many a part, however many
    partitions shuffles have: rounds of few edges are not hundreds of tiny files.
    """
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")))
    rounds, parts = 0, in_a_part and -(-live.count() // in_a_part)
    while not live.filter("x <> y").isEmpty():
        order = lambda c, k=rounds: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        ends = live.filter("x <> y").select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))).alias("e")).select("e.*")
        hook = ends.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least("m", order("node"))["v"].alias("to"))
        moves = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", "on")
        for end in ("x", "y"):
            # A place without a move is settled.
            live = live.join(moves.select(F.col("node").alias(end), F.col("on").alias(f"{end}_on")), end, "left").withColumn(end, F.coalesce(f"{end}_on", end)).drop(f"{end}_on")
        live = live.select("a", "b", "x", "y")
        live = cut(live.coalesce(parts) if parts else live)
        rounds += 1
    # The ends of an edge are at one place now; it stands for the least node there.
    found = live.select(F.explode(F.array("a", "b")).alias("node"), F.col("x").alias("place")).distinct()
    least = live.groupBy(F.col("x").alias("place")).agg(F.min(F.least("a", "b")).alias("label"))
    found = found.join(least, "place").select("node", "label")
    return cut(found.coalesce(parts) if parts else found)
