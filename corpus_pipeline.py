"""The corpus pipeline: quality rules, exact and near de-duplication, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and gives it, read again, to the next stage. All but the
last return the columns of ``docs``, whatever they are called. Nulls, empty
texts, repeated rows and texts of any length are whole rows for every stage; an
empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.chunk_encode import encode_documents
from groundline.llm.common import ensure_checkpoint_dir, numbered, table
from groundline.llm.exact_dedup import exact_duplicates
from groundline.llm.mixing import mix
from groundline.llm.near_copies import near_copies
from groundline.llm.quality import quality_scores



def _carried(docs: DataFrame) -> Column:
    """A row's columns in one struct, so that none of their names can clash with one used in a stage."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("carried")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts are rejected, repeated rows judged alike."""
    judged = quality_scores(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    # A filter does not pass a column that counts rows, so it cannot take a copy of the scores below them.
    counted = judged.withColumn("counted", F.monotonically_increasing_id())
    return counted.filter("kept AND counted >= 0").select("carried.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), the row with the greatest doc_id; of rows with that id, one."""
    kept = exact_duplicates(docs).filter("kept").select("row")
    return numbered(docs.select(_carried(docs))).join(kept, "row", "left_semi").select("carried.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more), the row with the least doc_id, then place.

    SimHash fingerprints find near copies first, an exact join those that they leave apart. Null ids come last; texts
    without words are copies of each other.
    """
    gone = near_copies(numbered(docs.select("doc_id", "text")))
    return numbered(docs.select(_carried(docs))).join(gone, "row", "left_anti").select("carried.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture uses it, once at least; null sources are one source."""
    copies = mix(docs).filter("n_copies > 0").select("row", "n_copies")
    joined = numbered(docs.select(_carried(docs))).join(copies, "row")
    return joined.select("carried", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("carried.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every row; null texts count as empty."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("temperature_mixing", mixed),
    ("bpe_encoding", encoded),
]

#: The n-gram hashes, the shingles and the BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder and read again.

    A stage's table is removed when the next one is written; the last one stays.
    """
    shared = ensure_checkpoint_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            _remove(spark, before)
        before = out
    return docs
