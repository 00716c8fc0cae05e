"""Queries over a stored inverted index of ``documents``, built in three generations.

The first generation holds the first half of every text, the second the whole
text of every document with an odd id, the third that of the others without the
documents of source src7. So what is live is every other document, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import TOKEN
from groundline.operators.inverted_index import document_postings, generations, index_bm25, live_documents, live_postings, posting_faults, publish_generation
from groundline.operators.ranking import top_k
from groundline.plans.ranking import STOPPED, TOP, search_terms
from groundline.plans.registry import query
from groundline.sources.checkpoints import ensure_checkpoint_dir
from groundline.sources.tables import table

REMOVED = "src7"
_TEXTS = "SELECT doc_id, source, coalesce(text, '') AS text, left(coalesce(text, ''), length(coalesce(text, '')) // 2) AS half FROM documents"


def build(spark: SparkSession, sf_dir: str) -> str:
    """Writes the three generations to a new folder of the shared storage and returns it."""
    root = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    gone = F.coalesce(F.col("source") == REMOVED, F.lit(False))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    odd = F.pmod("doc_id", F.lit(2)) == 1
    publish_generation(docs.select("doc_id", half.alias("text")), root, expected=0)
    publish_generation(docs.filter(odd), root, expected=1)
    publish_generation(docs.filter(~odd & ~gone), root, removed=docs.filter(gone), expected=2)
    return root


_LIVE = f"live AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM ({_TEXTS}) WHERE source IS DISTINCT FROM '{REMOVED}')"


@query(
    f"""WITH {_LIVE}, q AS (SELECT item_id, unnest(list_distinct({STOPPED})) AS term FROM benchmark), s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM live),
    tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM live) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    idf AS (SELECT term, greatest(ln((any_value(s.n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, s GROUP BY term),
    scored AS (SELECT item_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / s.mean))), 9) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id)::INT AS rank FROM scored) WHERE rank <= {TOP}"""
)
def index_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the stored index: changed documents replace their postings, removed ones have none."""
    scored = index_bm25(spark, build(spark, sf_dir), search_terms(spark, sf_dir), query_key="item_id")
    return top_k(scored, "item_id", [F.col("score"), F.col("doc_id")], TOP).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH t AS (SELECT doc_id, source IS NOT DISTINCT FROM '{REMOVED}' AS gone, doc_id % 2 = 1 AS odd, len(regexp_extract_all(lower(text), '{TOKEN}')) AS whole, len(regexp_extract_all(lower(half), '{TOKEN}')) AS half FROM ({_TEXTS}))
    SELECT 1 AS number, count(*) AS n_added, 0::BIGINT AS n_superseded, count(*) AS n_documents, sum(half)::BIGINT AS n_tokens FROM t
    UNION ALL SELECT 2, count(*) FILTER (odd), count(*) FILTER (odd), count(*), sum(CASE WHEN odd THEN whole ELSE half END)::BIGINT FROM t
    UNION ALL SELECT 3, count(*) FILTER (NOT odd AND NOT gone), count(*) FILTER (gone OR NOT odd), count(*) FILTER (NOT gone), coalesce(sum(whole) FILTER (NOT gone), 0)::BIGINT FROM t"""
)
def index_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each generation adds and supersedes, and the live corpus that its manifest states."""
    root = build(spark, sf_dir)
    known = generations(spark, root)
    stated = spark.createDataFrame([(g.number, g.part, g.n_documents, g.n_tokens) for g in known], "number int, part string, n_documents long, n_tokens long")
    counts = None
    for name in ("documents", "superseded"):
        rows = spark.read.schema("doc_id bigint, part string").option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/part={g.part}" for g in known))
        n = rows.groupBy("part").agg(F.count("*").alias(name))
        counts = n if counts is None else counts.join(n, "part", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return stated.join(counts, "part", "left").select("number", zero("documents").alias("n_added"), zero("superseded").alias("n_superseded"), "n_documents", "n_tokens")


@query(
    f"""WITH {_LIVE}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM live) GROUP BY ALL)
    SELECT CASE WHEN doc_id % 50 = 3 THEN 'missing' WHEN doc_id % 50 = 4 THEN 'duplicated' WHEN tf > 1 THEN 'different' END AS fault, count(*) AS n_postings, count(DISTINCT doc_id) AS n_documents
    FROM p WHERE doc_id % 50 IN (3, 4) OR (doc_id % 50 = 5 AND tf > 1) GROUP BY ALL
    UNION ALL SELECT 'unexpected', count(*), count(DISTINCT doc_id) FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents WHERE source = '{REMOVED}')) HAVING count(*) > 0"""
)
def index_posting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings with planted faults against the texts: lost, repeated and miscounted ones, and those of removed documents."""
    root = build(spark, sf_dir)
    stored, docs = live_postings(spark, root), table(spark, sf_dir, "documents")
    place = F.pmod("doc_id", F.lit(50))
    kept = stored.filter(place != 3).withColumn("tf", F.when((place == 5) & (F.col("tf") > 1), F.lit(1).cast("long")).otherwise(F.col("tf")))
    again = stored.filter(place == 4)
    stale = document_postings(docs.filter(F.col("source") == REMOVED))
    faults = posting_faults(kept.union(again).unionByName(stale), docs.filter(F.coalesce(F.col("source") != REMOVED, F.lit(True))))
    return faults.groupBy("fault").agg(F.count("*").alias("n_postings"), F.count_distinct("doc_id").alias("n_documents"))


@query(f"SELECT 'documents' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids, count(DISTINCT sha256(text)) AS n_texts FROM ({_TEXTS}) WHERE source IS DISTINCT FROM '{REMOVED}'")
def index_live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are live: each once, with the digest of its last text."""
    live = live_documents(spark, build(spark, sf_dir))
    return live.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.count_distinct("text_sha256").alias("n_texts")).select(F.lit("documents").alias("part"), "n", "ids", "n_texts")
