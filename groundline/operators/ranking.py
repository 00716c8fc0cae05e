"""Ranking: BM25, exact cosine, reciprocal-rank fusion, positional lane, Pareto layers, metrics.

Scores are rounded to 9 places before they decide an order, and every order
ends in an identity, so results do not depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import tokens
from groundline.sources.checkpoints import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NO_RANK = 2**31 - 1


def top_k(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``. Spark cuts each task's rows to k before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, *, query_key: str, eligible: Column | None = None) -> DataFrame:
    """``query_key, doc_id, score`` (lower is better) of every document that shares a term with a query.

    ``queries`` has ``query_key, term``; a repeated term counts again. Statistics
    are those of all ``documents``; ``eligible`` restricts only what is returned.
    Every text is tokenised once: what is kept are its length, under an empty
    term, and its occurrences of the queries' terms, counted.
    """
    return bm25_sums(documents, queries, query_key=query_key, eligible=eligible).select(query_key, "doc_id", F.round(-F.col("sum"), 9).alias("score"))


def bm25_sums(documents: DataFrame, queries: DataFrame, *, query_key: str, eligible: Column | None = None) -> DataFrame:
    """``query_key, doc_id, sum``: the scores of ``bm25`` before their sign and rounding, so that sums over parts of a query can be added."""
    return counted_sums(counted(documents, queries.select("term"), eligible=eligible), queries, query_key=query_key)


def counted(documents: DataFrame, terms: DataFrame, *, eligible: Column | None = None) -> DataFrame:
    """``term, doc_id, tf, dl, eligible``: how often each document has each of ``terms``, and a row with an empty term for every document."""
    docs = documents.select("doc_id", (F.lit(True) if eligible is None else eligible).alias("eligible"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    vocabulary = terms.select("term").filter("term <> ''").distinct()
    vocabulary = vocabulary.union(documents.sparkSession.range(1).select(F.lit("").alias("term")))
    # An outer explode: for an inner one, Spark would add a filter that tokenises every text once more.
    each = docs.select("doc_id", "eligible", F.size("t").alias("dl"), F.explode_outer(F.concat(F.array(F.lit("")), F.col("t"))).alias("term"))
    found = each.join(vocabulary, "term", "left_semi")
    return cut(found.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("eligible").alias("eligible")))


def counted_sums(tf: DataFrame, queries: DataFrame, *, query_key: str) -> DataFrame:
    """The sums of BM25 from ``counted``, whose terms include those of ``queries``."""
    sizes = tf.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("mean"))
    n, mean = sizes.select(F.col("n").cast("double")).scalar(), sizes.select("mean").scalar()
    return posting_sums(tf.filter("term <> ''"), queries, n, mean, query_key=query_key)


def posting_sums(tf: DataFrame, queries: DataFrame, n: Column, mean: Column, *, query_key: str) -> DataFrame:
    """The sums of BM25 from counted occurrences (``term, doc_id, tf, dl, eligible``: all documents of each term) of ``n`` documents of ``mean`` length."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    return tf.filter("eligible").join(idf, "term").join(queries, "term").groupBy(query_key, "doc_id").agg(F.sum(part).alias("sum"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors packed into rows ``ids, data``: up to ``size`` ids, and their numbers as bytes. Rows without a vector are left out."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["ids", "data"])

    whole = vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return whole.mapInArrow(packed, "ids array<bigint>, data binary")


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest finite scores of each row, and of those as great as the last of them."""
    score = np.where(np.isfinite(score), score, -np.inf)
    least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
    return np.nonzero((score >= least[:, None]) & (score > -np.inf))


def cosine_best(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 4096) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` best vectors for every vector of a stated query set.

    All have ``vec_id, embedding`` of one dimension; vectors have unit length,
    queries any but zero. Blocks of queries meet blocks of vectors; each pair of
    blocks is one matrix product, of which the k best rows per query go on (and
    rows as good as the last of them). Equal scores go by vec_id. A score that is
    no finite number (as of a vector with NaN) ranks nowhere; null vectors are
    left out.
    """
    q = _blocks(queries, block).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = _blocks(vectors, block).crossJoin(q)

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, data, q_ids, q_data in zip(*(batch.column(i) for i in range(4))):
                v_ids, c_ids = ids.values.to_numpy(), q_ids.values.to_numpy()
                v, c = (np.frombuffer(x.as_py(), dtype=np.float64).reshape(n, -1) for x, n in ((data, len(v_ids)), (q_data, len(c_ids))))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round(c @ v.T / np.linalg.norm(c, axis=1)[:, None], 9) + 0.0
                row, column = best_columns(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(c_ids[row]), pa.array(v_ids[column]), pa.array(score[row, column])], names=["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(best, "query_id bigint, vec_id bigint, score double")
    return top_k(scored, "query_id", [F.desc("score"), F.col("vec_id")], k)


def fuse(lexical: DataFrame, semantic: DataFrame, keys: list[str], *, offset: int = 40) -> DataFrame:
    """Reciprocal-rank fusion of two channels (``keys, rank``) with each row's place in the whole fusion.

    The score of two ranks is one division of exact integers, so equal
    fractions are equal doubles.
    """
    both = lexical.select(*keys, F.col("rank").alias("lexical_rank")).join(semantic.select(*keys, F.col("rank").alias("semantic_rank")), keys, "full_outer")
    a, b = F.col("lexical_rank") + offset, F.col("semantic_rank") + offset
    score = F.when(F.col("semantic_rank").isNull(), 1 / a).when(F.col("lexical_rank").isNull(), 1 / b).otherwise((a + b) / (a * b))
    channels = F.col("lexical_rank").isNotNull().cast("int") + F.col("semantic_rank").isNotNull().cast("int")
    both = both.withColumn("score", score).withColumn("channels", channels)
    late = [F.coalesce(c, F.lit(NO_RANK)) for c in ("lexical_rank", "semantic_rank")]
    order = [F.desc("score"), F.least(*late), F.desc("channels"), *late, *(F.col(k) for k in keys[1:])]
    return both.withColumn("fused_rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)))


def pareto_layers(ranked: DataFrame, key: str) -> DataFrame:
    """``layer`` of each row of at most some hundred per key, by (semantic_rank, lexical_rank).

    A row's layer is one more than the deepest layer of a row that is at least
    as good in both ranks and better in one. In the order of the two ranks that
    is a single fold; it needs one array per key, so the rows must be few.
    """
    late = F.coalesce("lexical_rank", F.lit(NO_RANK))
    rows = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("semantic_rank").alias("s"), late.alias("l"), F.col("doc_id")))).alias("rows"))
    done = "array<struct<s:int,l:int,doc_id:bigint,layer:int>>"

    def step(acc: Column, r: Column) -> Column:
        above = F.filter(acc, lambda p: (p["s"] <= r["s"]) & (p["l"] <= r["l"]) & ((p["s"] < r["s"]) | (p["l"] < r["l"])))
        layer = F.coalesce(F.array_max(F.transform(above, lambda p: p["layer"])), F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(r["s"].cast("int").alias("s"), r["l"].cast("int").alias("l"), r["doc_id"].alias("doc_id"), layer.alias("layer"))))

    folded = rows.select(key, F.explode(F.aggregate("rows", F.array().cast(done), step)).alias("x"))
    return folded.select(key, F.col("x.doc_id").alias("doc_id"), F.col("x.layer").alias("layer"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, key: str, k: int, places: int = 6) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``k`` per key with binary relevance; null where nothing is relevant."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant, [key, "doc_id"]).groupBy(key).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    wanted = relevant.groupBy(key).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    all_keys = ranked.select(key).union(relevant.select(key)).distinct()
    joined = all_keys.join(wanted, key, "left").join(hits, key, "left")
    some = F.col("n").isNotNull()
    return joined.select(key, F.when(some, F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), places)).alias("recall"), F.when(some, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), places)).alias("reciprocal_rank"), F.when(some, F.round(F.coalesce("gain", F.lit(0.0)) / ideal, places)).alias("ndcg"))


def exact_percentiles(rows: DataFrame, key: str, value: str, parts: list[float], *, most: int = 100_000, knots: int = 256) -> DataFrame:
    """``key, part, percentile`` with linear interpolation between neighbours, as the exact percentile gives it.

    No task ever holds all values of a key. While more than ``most`` values could
    have the wanted rank, approximate percentiles (a sketch of fixed size) cut
    their range in zones, which are counted exactly; the zone that holds the rank
    is the next range. The last few are sorted.
    """
    values = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    whole = values.groupBy("key").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), (F.lit(p) * (F.col("m") - 1)).alias("at")) for p in parts))).alias("x")
    wanted = cut(whole.select("key", "m", "low", "high", at).select("key", "m", "low", "high", "x.*", F.explode(F.array_distinct(F.array(F.floor("x.at"), F.ceil("x.at")))).alias("rank")))
    # ``rest`` is the rank within the range from ``low`` to ``high``, which holds ``m`` values.
    ranges = cut(wanted.select("key", "rank", "m", "low", "high", F.col("rank").alias("rest")).distinct())
    wide = (F.col("m") > most) & (F.col("low") < F.col("high"))
    while ranges.filter(wide).limit(1).count():
        inside = values.join(ranges.filter(wide), "key").filter("v >= low AND v <= high")
        sketch = inside.groupBy("key", "rank", "rest", "m").agg(F.percentile_approx("v", [k / knots for k in range(knots + 1)], 100 * knots).alias("k"))
        near = F.col("rest") / (F.col("m") - 1) * knots
        ends = sketch.select("key", "rank", F.get("k", F.greatest(F.lit(0), F.floor(near).cast("int") - 1)).alias("a"), F.get("k", F.least(F.lit(knots), F.ceil(near).cast("int") + 1)).alias("b"))
        zone = F.when(F.col("v") < F.col("a"), 0).when(F.col("v") == F.col("a"), 1).when(F.col("v") < F.col("b"), 2).when(F.col("v") == F.col("b"), 3).otherwise(4)
        zones = inside.join(ends, ["key", "rank"]).groupBy("key", "rank", "rest", zone.alias("zone")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("m").over(Window.partitionBy("key", "rank").orderBy("zone")) - F.col("m")
        narrowed = zones.withColumn("before", before).filter("rest >= before AND rest < before + m")
        ranges = cut(ranges.filter(~wide).union(narrowed.select("key", "rank", "m", "low", "high", (F.col("rest") - F.col("before")).alias("rest"))))
    few = values.join(ranges.filter("low < high"), "key").filter("v >= low AND v <= high").groupBy("key", "rank", "rest").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    found = ranges.filter("low >= high").select("key", "rank", F.col("low").alias("x")).union(few.select("key", "rank", F.get("sorted", F.col("rest").cast("int"))))
    ends = wanted.join(found, ["key", "rank"]).groupBy("key", "part", "at").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    return ends.select(F.col("key").alias(key), "part", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("percentile"))


def numbered_by(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, ... in the order of ``order`` within each key, however many rows a key has.

    Rows are dealt out in ranges and sorted within them; only the number of
    rows of each key in each range meets in one place.
    """
    place = rows.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    place = cut(place.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = place.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).drop("_n")
    return place.join(offsets, [key, "_part"]).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
