"""Table sources: Parquet tables of a folder, other file formats, and size-checked scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A read-only Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows ``path, modificationTime, length, content``, with the digest of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def inventory_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest ``path, length, sha256``."""
    have, want = files.select("path", "length", "sha256"), manifest.select("path", F.col("length").alias("want_length"), F.col("sha256").alias("want_sha256"))
    both = have.join(want, "path", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("want_sha256").isNull(), "unexpected").when((F.col("length") != F.col("want_length")) | (F.col("sha256") != F.col("want_sha256")), "changed")
    return both.select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def admit_vectors(vectors: DataFrame, column: str, *, max_rows: int, dimension: int) -> DataFrame:
    """``vectors`` if it has at most ``max_rows`` rows of ``dimension`` numbers; else the query fails."""
    sizes = vectors.agg(F.count("*").alias("n"), F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high"))
    ok = sizes.select(F.coalesce((F.col("n") <= max_rows) & (F.col("low") == dimension) & (F.col("high") == dimension), F.col("n") == 0).alias("ok")).scalar()
    return vectors.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("vectors exceed the admitted size"))))
