"""The positional lane over true offsets: where the evidence of a hit starts in its whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.operators.ingest import placed_pages, starts_early
from groundline.operators.ranking import top_k
from groundline.plans.evidence import EVIDENCE_SQL, _evidence
from groundline.plans.ranking import TOP, _selected
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut
from groundline.sources.tables import table

#: Rows of the auxiliary lane of one search.
AUXILIARY = 32
_LANES = (
    EVIDENCE_SQL
    + f""", sized AS (SELECT doc_id, page_index, length(array_to_string(page_words, ' ')) AS len FROM pages_ WHERE doc_id IN (SELECT doc_id FROM evidence)),
placed AS (SELECT doc_id, page_index, coalesce(sum(len + 1) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  sum(len) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1 AS total FROM sized),
located AS (SELECT item_id, doc_id, rank, (base + start_offset)::BIGINT AS slot, total::BIGINT AS document_length FROM evidence JOIN placed USING (doc_id, page_index)),
aux AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank)::INT AS place FROM located WHERE rank > {TOP} AND 4 * slot < document_length)
"""
)


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, doc_id, rank, slot, document_length, lane, place``: the first ranks, and later hits whose evidence starts early.

    ``slot`` is the evidence's first character in the canonical document. Texts
    of hits alone are cut into pages, and only their places leave that plan.
    """
    evidence = cut(_evidence(spark, sf_dir).select("item_id", "doc_id", "rank", "page_index", "start_offset"))
    hit = table(spark, sf_dir, "documents").select("doc_id", "text").join(evidence.select("doc_id").distinct(), "doc_id", "left_semi")
    at = evidence.join(placed_pages(hit), ["doc_id", "page_index"]).withColumn("slot", F.col("page_base") + F.col("start_offset"))
    at = cut(at.select("item_id", "doc_id", "rank", "slot", "document_length"))
    later = at.filter((F.col("rank") > TOP) & starts_early(F.col("slot"), F.col("document_length")))
    auxiliary = top_k(later.withColumnRenamed("rank", "r"), "item_id", [F.col("r")], AUXILIARY).withColumnRenamed("rank", "place").withColumnRenamed("r", "rank")
    baseline = at.filter(F.col("rank") <= TOP).withColumn("lane", F.lit("baseline")).withColumn("place", F.col("rank"))
    return baseline.unionByName(auxiliary.withColumn("lane", F.lit("auxiliary")))


@query(_LANES + f"SELECT item_id, doc_id, rank, slot AS char_start, document_length, 'baseline' AS lane, rank AS place FROM located WHERE rank <= {TOP} UNION ALL SELECT item_id, doc_id, rank, slot, document_length, 'auxiliary', place FROM aux WHERE place <= {AUXILIARY}")
def evidence_position_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the first hits, and of later ones that starts in the first quarter of its document."""
    return _lanes(spark, sf_dir).withColumnRenamed("slot", "char_start").select("item_id", "doc_id", "rank", "char_start", "document_length", "lane", "place")


@query(
    _LANES
    + f""", early AS (SELECT item_id, arg_min(doc_id, (slot, rank, doc_id)) AS doc_id, arg_min(rank, (slot, rank, doc_id)) AS rank FROM aux WHERE place <= {AUXILIARY} GROUP BY item_id)
SELECT item_id, doc_id, rank, 'current' AS kind FROM located WHERE rank <= CASE WHEN item_id IN (SELECT item_id FROM early) THEN 7 ELSE 8 END UNION ALL SELECT item_id, doc_id, rank, 'earliest' FROM early"""
)
def evidence_position_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven current rows and the auxiliary one whose evidence starts earliest; eight current ones where there is none."""
    lanes = cut(_lanes(spark, sf_dir))
    current = lanes.filter("lane = 'baseline'").select("item_id", "doc_id", "place", "rank")
    return _selected(current, lanes).select("item_id", "doc_id", "rank", "kind")
