"""Canonical JSON of nested rows: fields and map keys in alphabetical order, nulls written out, a bound, and a seal that a reader recomputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from groundline.operators.evidence import MAX_JSON_BYTES

SEAL = "seal"


def ordered(value: Column, kind: DataType) -> Column:
    """``value`` with the fields of all its structs and the keys of all its maps in alphabetical order, at any depth.

    Numbers that are not finite fail the query, as JSON has none; so do maps
    whose keys are no strings.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise ValueError("keys of canonical maps are strings")
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, by_key))
    if isinstance(kind, (FloatType, DoubleType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit("a number is not finite")).cast(kind)).otherwise(value)
    return value


def canonical_json(rows: DataFrame, *, leave_out: tuple[str, ...] = (), most_bytes: int = MAX_JSON_BYTES) -> Column:
    """Each row of ``rows`` as canonical JSON without the columns ``leave_out``; null where it is over the bound: all or nothing."""
    fields = sorted((f for f in rows.schema.fields if f.name not in leave_out), key=lambda f: f.name)
    whole = F.struct(*(ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    body = F.to_json(whole, {"ignoreNullFields": "false"})
    return F.when(F.octet_length(body) <= most_bytes, body)


def seal(rows: DataFrame, *, most_bytes: int = MAX_JSON_BYTES) -> DataFrame:
    """Adds ``seal``: the digest of the row's canonical JSON without that field; null for rows over the bound."""
    return rows.withColumn(SEAL, F.sha2(canonical_json(rows, leave_out=(SEAL,), most_bytes=most_bytes), 256))


def write_sealed(rows: DataFrame, folder: str, *, most_bytes: int = MAX_JSON_BYTES) -> None:
    """Writes the rows within the bound as lines of canonical JSON, each with its seal as a field among the others."""
    sealed = seal(rows, most_bytes=most_bytes).filter(F.col(SEAL).isNotNull())
    sealed.select(canonical_json(sealed, most_bytes=most_bytes + 128).alias("value")).write.text(folder)


def read_sealed(spark: SparkSession, folder: str, schema: StructType, *, most_bytes: int = MAX_JSON_BYTES) -> DataFrame:
    """Sealed rows as they were written, with ``intact``: whether the seal, computed anew from the fields that were read, is the one stored.

    A line that is no JSON of the schema, or not canonical, is not intact either.
    """
    full = StructType([*schema.fields]).add(SEAL, StringType())
    lines = spark.read.text(folder)
    read = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r")).select("value", "r.*")
    again = canonical_json(read.drop("value"), most_bytes=most_bytes + 128)
    own = F.sha2(canonical_json(read.drop("value"), leave_out=(SEAL,), most_bytes=most_bytes), 256)
    intact = F.coalesce((own == F.col(SEAL)) & (again == F.col("value")), F.lit(False))
    return read.withColumn("intact", intact).drop("value")
