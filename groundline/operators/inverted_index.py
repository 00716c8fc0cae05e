"""A stored inverted index in generations: postings by bucket of terms, superseded documents left out.

Under a root folder, a generation is three tables and a manifest:

* ``postings``: ``term, doc_id, tf, dl``, in a folder for each bucket of terms;
* ``documents``: ``doc_id, dl, text_sha256`` of the documents that it brings;
* ``superseded``: ``doc_id, old_part`` of the documents of earlier generations that it replaces or removes;
* ``manifests``: one small file, moved in place last, with the live corpus' size.

A generation is there once its manifest is; a job that dies before leaves files
that nothing names. Two publishers who build on the same generation want the
same manifest name, so one of them fails and has changed nothing. A search reads
only the buckets of its terms and leaves out what later generations supersede.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import tokens
from groundline.operators.ranking import posting_sums
from groundline.sources.checkpoints import cut, tidy
from groundline.sources.publish import PublicationConflict, _files, write_once

POSTINGS = "term string, doc_id bigint, tf bigint, dl int"
DOCUMENTS = "doc_id bigint, dl int, text_sha256 string"
SUPERSEDED = "doc_id bigint, old_part string"
#: Postings that an audit compares at a time at least, and its rounds at most (each reads all stored postings).
_ROUND, _MOST_ROUNDS = 2_000_000, 4


@dataclass(frozen=True)
class Generation:
    """A manifest: number and folder of a generation, the buckets of the index, the live documents and their tokens.

    ``n_added`` is how many documents it brings, ``n_superseded`` how many it supersedes of each earlier folder.
    """

    number: int
    part: str
    n_buckets: int
    n_documents: int
    n_tokens: int
    n_added: int = 0
    n_superseded: dict[str, int] = field(default_factory=dict)


def generations(spark: SparkSession, root: str) -> list[Generation]:
    """The published generations in their order; one small file for each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not _files(spark, root).exists(folder):
        return []
    rows = spark.read.option("wholetext", "true").text(f"{root}/manifests/*.json").collect()
    return sorted((Generation(**json.loads(r["value"])) for r in rows), key=lambda g: g.number)


def bucket(term: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def _read(spark: SparkSession, root: str, name: str, schema: str, known: list[Generation]) -> DataFrame:
    """One table of the given generations, with ``part`` (and ``bucket``) from the folders' names."""
    paths = [f"{root}/{name}/part={g.part}" for g in known]
    keys = "part string" + (", bucket int" if name == "postings" else "")
    if not paths:
        return spark.createDataFrame([], f"{schema}, {keys}")
    return spark.read.schema(f"{schema}, {keys}").option("basePath", f"{root}/{name}").parquet(*paths)


def _live(spark: SparkSession, root: str, name: str, schema: str, known: list[Generation]) -> DataFrame:
    """One table of the given generations without the rows of superseded documents.

    A generation of which all documents are superseded is not read, and one of
    which none is, is read as it is.
    """
    gone = {g.part: sum(later.n_superseded.get(g.part, 0) for later in known) for g in known}
    whole = _read(spark, root, name, schema, [g for g in known if not gone[g.part]])
    some = [g for g in known if 0 < gone[g.part] < g.n_added]
    if not some:
        return whole
    left = _read(spark, root, "superseded", SUPERSEDED, [g for g in known if g.n_superseded]).select("doc_id", F.col("old_part").alias("part"))
    return whole.unionByName(_read(spark, root, name, schema, some).join(left.filter(F.col("part").isin([g.part for g in some])), ["doc_id", "part"], "left_anti"))


def live_documents(spark: SparkSession, root: str, known: list[Generation] | None = None) -> DataFrame:
    """``doc_id, dl, text_sha256, part`` of the documents that no later generation supersedes."""
    known = generations(spark, root) if known is None else known
    return _live(spark, root, "documents", DOCUMENTS, known).select("doc_id", "dl", "text_sha256", "part")


def live_postings(spark: SparkSession, root: str, known: list[Generation] | None = None, buckets: list[int] | None = None) -> DataFrame:
    """``term, doc_id, tf, dl`` of live documents, from some buckets or all."""
    known = generations(spark, root) if known is None else known
    found = _live(spark, root, "postings", POSTINGS, known)
    if buckets is not None:
        found = found.filter(F.col("bucket").isin(buckets))
    return found.select("term", "doc_id", "tf", "dl")


def document_postings(documents: DataFrame) -> DataFrame:
    """``term, doc_id, tf, dl``: the terms of each text with their counts, counted within its row as runs of its sorted tokens."""
    rows = documents.select("doc_id", F.sort_array(tokens(F.coalesce("text", F.lit("")))).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - 1)), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("doc_id", "t", begins.alias("s"))
    runs = F.transform("s", lambda at, k: F.struct(F.get("t", at).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("t")) - at).cast("long").alias("tf")))
    # The tokens end here: what stands beside an explode is copied into each of its rows.
    rows = rows.select("doc_id", F.size("t").alias("dl"), runs.alias("runs"))
    # An outer explode: for an inner one, Spark would add a filter that tokenises every text once more.
    return rows.select("doc_id", "dl", F.explode_outer("runs").alias("x")).select("x.term", "doc_id", "x.tf", "dl").filter("term IS NOT NULL")


def publish_generation(changed: DataFrame, root: str, *, removed: DataFrame | None = None, n_buckets: int = 64, expected: int | None = None) -> Generation:
    """Adds a generation with the ``changed`` documents (``doc_id, text``) and without the ``removed`` ones (``doc_id``).

    The index's first generation fixes the number of buckets. ``expected`` is
    the number of the generation that must be the last (0: none). Ids must be
    unique and not null. A null text counts as empty: a document without terms,
    which counts as one of the corpus.
    """
    spark = changed.sparkSession
    known = generations(spark, root)
    last = known[-1] if known else Generation(0, "", n_buckets, 0, 0)
    if expected is not None and last.number != expected:
        raise PublicationConflict(f"the index is at generation {last.number}, not at {expected}")
    part = f"{last.number + 1:08d}-{uuid.uuid4().hex}"
    changed = changed.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not changed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        raise ValueError("ids of documents must be unique and not null")
    postings = document_postings(changed).withColumn("bucket", bucket(F.col("term"), last.n_buckets))
    with tidy(spark):
        # Rebalancing splits a bucket with a very frequent term over several files.
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{root}/postings/part={part}")
        # Lengths come from the postings: each text is tokenised once.
        lengths = spark.read.schema(POSTINGS).parquet(f"{root}/postings/part={part}").groupBy("doc_id").agg(F.first("dl").alias("dl"))
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        sized = changed.select("doc_id", digest.alias("text_sha256")).join(lengths, "doc_id", "left")
        sized.select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), "text_sha256").write.parquet(f"{root}/documents/part={part}")
    added = spark.read.schema(DOCUMENTS).parquet(f"{root}/documents/part={part}")
    leaving = added.select("doc_id") if removed is None else added.select("doc_id").union(removed.select(F.col("doc_id").cast("long").alias("doc_id"))).distinct()
    old = cut(live_documents(spark, root, known).join(leaving, "doc_id", "left_semi").select("doc_id", "dl", F.col("part").alias("old_part")))
    old.select("doc_id", "old_part").write.parquet(f"{root}/superseded/part={part}")
    sizes = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0))).first()
    (n_new, t_new), (n_old, t_old) = sizes(added), sizes(old)
    # One number for each generation at most.
    by_part = {r["old_part"]: r["count"] for r in old.groupBy("old_part").count().collect()}
    made = Generation(last.number + 1, part, last.n_buckets, last.n_documents + n_new - n_old, last.n_tokens + t_new - t_old, n_new, by_part)
    if not write_once(spark, f"{root}/manifests/{made.number:08d}.json", json.dumps(asdict(made))):
        raise PublicationConflict(f"another publisher has added generation {made.number}")
    return made


def index_bm25(spark: SparkSession, root: str, queries: DataFrame, *, query_key: str) -> DataFrame:
    """``query_key, doc_id, score`` as ``bm25`` gives it for the live documents, read from the buckets of the queries' terms.

    ``queries`` has ``query_key, term``. All searches see the generation that is
    the last when the call is made.
    """
    known = generations(spark, root)
    if not known:
        return queries.limit(0).select(query_key, F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    last = known[-1]
    terms = queries.select("term").distinct()
    # At most one number for each bucket.
    buckets = sorted(r[0] for r in terms.select(bucket(F.col("term"), last.n_buckets)).distinct().collect())
    tf = live_postings(spark, root, known, buckets).join(terms, "term", "left_semi").withColumn("eligible", F.lit(True))
    sums = posting_sums(tf, queries, F.lit(float(last.n_documents)), F.lit(last.n_tokens / max(1, last.n_documents)), query_key=query_key)
    return sums.select(query_key, "doc_id", F.round(-F.col("sum"), 9).alias("score"))


def posting_faults(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """``term, doc_id, fault`` of postings against the texts they should be of: missing, unexpected, duplicated or different.

    A part of the documents is compared at a time, so that the disk holds a part
    of the postings in shuffles; each text is tokenised once.
    """
    rounds = min(_MOST_ROUNDS, 1 + stored.count() // _ROUND)
    faults = None
    for at in range(rounds):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == at
        found = cut(_faults(stored.filter(mine), documents.filter(mine)))
        faults = found if faults is None else faults.union(found)
    return faults


def _faults(stored: DataFrame, documents: DataFrame) -> DataFrame:
    # Where there is one, the least is it.
    have = stored.groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.min("tf").alias("tf"), F.min("dl").alias("dl"))
    want = document_postings(documents).select("term", "doc_id", F.struct("tf", "dl").alias("want"))
    both = have.join(want, ["term", "doc_id"], "full_outer")
    same = F.col("tf").eqNullSafe(F.col("want.tf")) & F.col("dl").eqNullSafe(F.col("want.dl"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("n") > 1, "duplicated").when(~same, "different")
    return both.select("term", "doc_id", fault.alias("fault")).filter("fault IS NOT NULL")
