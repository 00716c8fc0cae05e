"""Quality rules: base counts and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Unigrams and bigrams of whitespace words are hashed into ``buckets`` buckets.
Two smoothed multinomials over the buckets are counted: the
trusted target (a bounded sample of the documents labelled ``quality = 1`` and
not toxic) and the raw corpus (all documents). A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept when the score reaches ``threshold``.
The only thing that reaches the driver is the table of ``buckets`` ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, let

SYMBOLS = r"[#*$%&|<>]+"


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket_of(x: Column, buckets: int) -> Column:
    return F.pmod(x, F.lit(buckets)).cast("int")


def paired(left: Column, h: Column, width: int) -> Column:
    """Hashes of ``width`` words: those of ``width - 1`` words, each with the next word's hash."""
    n = F.greatest(F.lit(0), F.size(h) - (width - 1))
    return F.zip_with(F.slice(left, 1, n), F.slice(h, width, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(tri: Column, bits: int = 24) -> Column:
    """Words covered by the 3-word windows whose hash occurs twice or more in ``tri``.

    Window hashes and positions packed into longs are sorted first; only those
    whose upper 40 bits meet again are compared in full. Where there are more
    windows than ``bits`` can number, all are compared in full.
    """

    def covered(packed: Column) -> Column:
        near = F.filter(packed, lambda e, i: (F.shiftright(e, bits) == F.shiftright(F.get(packed, i - 1), bits)) | (F.shiftright(e, bits) == F.shiftright(F.get(packed, i + 1), bits)))
        at = F.transform(near, lambda e: e.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
        return in_full(at)

    def in_full(at: Column) -> Column:
        full = F.sort_array(F.transform(at, lambda i: F.struct(F.get(tri, i).alias("x"), i.alias("i"))))
        return let(let(full, marked), total)

    def marked(p: Column) -> Column:
        # A null neighbour (before the first, after the last) leaves the other comparison to decide.
        hit = F.filter(p, lambda e, i: (e["x"] == F.get(p, i - 1)["x"]) | (e["x"] == F.get(p, i + 1)["x"]))
        return F.sort_array(F.transform(hit, lambda e: e["i"]))

    def total(pos: Column) -> Column:
        return F.aggregate(F.transform(pos, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda acc, g: acc + g)

    packed = F.sort_array(F.transform(tri, lambda x, i: F.shiftleft(x, bits).bitwiseOR(i.cast("long"))))
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("long")).when(F.size(tri) > 1 << bits, in_full(F.sequence(F.lit(0), F.size(tri) - 1))).otherwise(let(packed, covered))


def fit_ratios(documents: DataFrame, labels: DataFrame, buckets: int, smoothing: float, target_documents: int) -> DataFrame:
    """One row, one array ``ratio`` of ``buckets`` log-likelihood ratios.

    A document is trusted if some label row calls it good and none calls it bad
    or toxic. The target is counted over the ``target_documents`` trusted ones
    whose id has the least hash, so that their ids can be broadcast and no text
    has to be shuffled. With no trusted document every ratio is zero.
    """
    trusted = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("good = 1 AND toxic = 0")
    trusted = F.broadcast(trusted.select("label_id").filter("label_id IS NOT NULL").orderBy(F.xxhash64("label_id"), "label_id").limit(target_documents))
    words = documents.join(trusted, documents["doc_id"] == trusted["label_id"], "left").select(F.col("label_id").isNotNull().cast("int").alias("t"), documents["text"])
    grams = words.select("t", F.explode(let(word_hashes(ascii_words(F.col("text"))), lambda h: F.concat(h, paired(h, h, 2)))).alias("h")).select("t", bucket_of(F.col("h"), buckets).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    # Every bucket has a row, so a document's bucket always finds its ratio.
    spark = documents.sparkSession
    full = spark.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    array = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = F.transform("c", lambda x: F.log((x["target"] + smoothing) / (F.col("n_target") + smoothing * buckets)) - F.log((x["raw"] + smoothing) / (F.col("n_raw") + smoothing * buckets)))
    return array.select(F.when(F.col("n_target") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratio"))


def quality_scores(documents: DataFrame, labels: DataFrame, *, carry: list[str] | None = None, buckets: int = 8192, smoothing: float = 1.0, threshold: float = -0.3, target_documents: int = 10_000, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds counts, score and verdict to every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept`` (one row per input row). Null and
    empty texts have zero words and so fail the base rule; texts of any length
    are counted whole; ties and repeated rows are judged alike; empty tables give empty results; other columns of
    the inputs are ignored, unless ``carry`` names those to return: they come in
    a struct ``carried`` in place of doc_id, so that their names cannot clash.
    """
    carry = ["doc_id"] if carry is None else carry
    ratio = fit_ratios(documents.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"), buckets, smoothing, target_documents).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(words: Column) -> Column:
        def from_hashes(h: Column) -> Column:
            return let(paired(h, h, 2), lambda pairs: from_pairs(h, pairs))

        def from_pairs(h: Column, pairs: Column) -> Column:
            add = lambda acc, x: acc + F.get(F.col("ratio"), bucket_of(x, buckets))
            total = F.aggregate(pairs, F.aggregate(h, F.lit(0.0), add), add)
            return F.struct(
                F.size(h).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                let(paired(pairs, h, 3), lambda tri: repeated_words(tri)).alias("n_repeat_words"),
                F.round(total / F.greatest(F.lit(1), F.size(h) + F.size(pairs)), 6).alias("score"),
            )

        return let(word_hashes(words), from_hashes)

    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    judged = F.struct(let(ascii_words(F.col("text")), measured).alias("m"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"))
    # The input's columns travel in a struct of their own, so none can clash with a name used here.
    out = documents.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in carry)).alias("carried"), "text").withColumn("ratio", ratio).select("carried", judged.alias("j"))
    out = out.select("carried", "j.m.n_words", "j.m.word_chars", "j.n_symbols", "j.n_dup_lines", "j.m.n_repeat_words", "j.m.score")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    results = [c for c in out.columns if c != "carried"]
    return out.select("carried.*", *results) if carry == ["doc_id"] else out.select("carried", *results)
