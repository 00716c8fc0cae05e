"""Sinks: staged, checked publication of generations, and the pointer that names the current one.

A generation is written to a staging folder, checked there by violation queries
and moved, complete, to a folder named by its key and content; it becomes current
by one pointer file, which is moved to a name that nobody has used. Moves never
replace anything: of two publishers who want one name, the store lets one win,
the other's files stay its own, and what a reader may hold is never rewritten. A
job that dies half-way changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "key string, generation_id string, sequence bigint, snapshot string"
#: Legal steps of a generation's state. Fixed values.
STEPS = (("DB_CANDIDATE", "FILES_FINALIZED"), ("DB_CANDIDATE", "STALE"), ("FILES_FINALIZED", "STALE"))
#: Stands for "whatever is current" where a publisher has no expectation.
ANY = object()


class PublicationConflict(RuntimeError):
    """Another publisher was first, or the source is not what the rows were made from."""


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns, types and rows in any order: the sums of two halves of their digests, and their number.

    Rows are hashed as JSON with nulls written out, so a null in one column is no null in another.
    """
    body = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    halves = [F.coalesce(F.sum(F.conv(F.substring(body, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for at in (1, 16)]
    n, *sums = df.agg(F.count("*"), *halves).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(f"{df.schema.simpleString()}:{n}:{':'.join(map(str, sums))}"), 256)).first()[0]


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def move_once(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder to a name that nobody has used; false if the name is taken (the source then stays)."""
    fs = spark._jvm.org.apache.hadoop.fs
    at, to = (_files(spark, p).makeQualified(fs.Path(p)) for p in (source, target))
    _files(spark, target).mkdirs(to.getParent())
    if _files(spark, target).exists(to):
        return False
    # Without options a move fails where the target exists, also if it came into being just now.
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(at, to, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    return True


def write_once(spark: SparkSession, path: str, body: str) -> bool:
    """Writes a small file under a name that nobody has used; false if the name is taken."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    out = _files(spark, path).create(spark._jvm.org.apache.hadoop.fs.Path(draft), False)
    out.write(bytearray(body.encode()))
    out.close()
    if move_once(spark, draft, path):
        return True
    _remove(spark, draft)
    return False


def _pointer_folder(root: str, key: str) -> str:
    return f"{root}/pointers/{hashlib.sha256(key.encode()).hexdigest()[:32]}"


def publish(df: DataFrame, root: str, key: str, checks: dict[str, Callable[[DataFrame], DataFrame]], sequence: int, *, snapshot: str | None = None, expected: object = ANY, still: Callable[[], str | None] | None = None) -> str:
    """Writes, checks and publishes a generation; returns its id. The same rows again reuse what is there.

    ``checks`` map a name to a function that returns the rows violating it.
    ``snapshot`` names the state of the source that the rows were made from;
    ``still`` tells the source's state at release. ``expected`` is the generation
    (or None for none) that must be current when this one is released. If either
    differs, or another publisher has taken ``sequence``, nothing is released
    and PublicationConflict raised. A table without rows is a generation like
    any other. The staging folder goes in any case.
    """
    spark = df.sparkSession
    staging = f"{root}/staging/{uuid.uuid4().hex}"
    try:
        df.write.parquet(staging)
        staged = spark.read.schema(df.schema).parquet(staging)
        for name, violations in checks.items():
            if not violations(staged).isEmpty():
                raise ValueError(f"generation {key}-{sequence} violates {name}")
        generation = f"{key}-{fingerprint(staged)}"
        # The same rows may be there, from before or from another publisher at this moment.
        move_once(spark, staging, f"{root}/generations/{generation}")
    finally:
        _remove(spark, staging)
    return release(spark, root, key, generation, sequence, snapshot=snapshot, expected=expected, still=still)


def release(spark: SparkSession, root: str, key: str, generation: str, sequence: int, *, snapshot: str | None = None, expected: object = ANY, still: Callable[[], str | None] | None = None) -> str:
    """Makes a written generation current by its pointer file, if what ``publish`` demands still holds."""
    last = _last_pointer(spark, root, key)
    current = last["generation_id"] if last else None
    if expected is not ANY and current != expected:
        raise PublicationConflict(f"{key} is at {current}, not at {expected}")
    if still is not None and still() != snapshot:
        raise PublicationConflict(f"the source of {key} has moved on from {snapshot}")
    if last is not None and (current, last["snapshot"]) == (generation, snapshot):
        return generation
    if last is not None and last["sequence"] >= sequence:
        raise PublicationConflict(f"{key} is at step {last['sequence']}, {sequence} comes too late")
    body = json.dumps({"key": key, "generation_id": generation, "sequence": sequence, "snapshot": snapshot})
    # A pointer is named by its place behind the one that was read: whoever else has read that one wants the same name.
    if not write_once(spark, f"{_pointer_folder(root, key)}/{0 if last is None else last['place'] + 1:012d}.json", body):
        raise PublicationConflict(f"another publisher has released a generation of {key}")
    return generation


def _last_pointer(spark: SparkSession, root: str, key: str) -> dict | None:
    """The last pointer of one key, from the names in its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_pointer_folder(root, key))
    files = _files(spark, root)
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    places = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
    if not places:
        return None
    row = spark.read.schema(POINTER).json(f"{_pointer_folder(root, key)}/{places[-1]:012d}.json").first()
    return row.asDict() | {"place": places[-1]}


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The last pointer of each key; none before the first publication."""
    try:
        log = spark.read.schema(POINTER).json(f"{root}/pointers/*/*.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], POINTER)
    return log.groupBy("key").agg(F.max_by("generation_id", "sequence").alias("generation_id"), F.max_by("snapshot", "sequence").alias("snapshot"))


def current_generation(spark: SparkSession, root: str, key: str) -> str | None:
    row = pointers(spark, root).filter(F.col("key") == key).first()
    return row["generation_id"] if row else None


def read_current(spark: SparkSession, root: str, key: str, *, snapshot: str | None = None) -> DataFrame | None:
    """The current generation; none if there is none or, where ``snapshot`` is given, if the source has moved on since."""
    row = pointers(spark, root).filter(F.col("key") == key).first()
    if row is None or (snapshot is not None and row["snapshot"] != snapshot):
        return None
    return spark.read.parquet(f"{root}/generations/{row['generation_id']}")


def is_current(spark: SparkSession, root: str, key: str, generation: str, snapshot: str) -> bool:
    """Whether a generation is still the published one of a source that has not moved on."""
    return pointers(spark, root).filter((F.col("key") == key) & (F.col("generation_id") == generation) & (F.col("snapshot") == snapshot)).limit(1).count() == 1


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` against ``right`` by keys, nulls equal to nulls."""
    other = right.select(*(F.col(f"`{k}`").alias(f"{k}_other") for k in keys))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}_other`"))
    return left.join(other, match, how)


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys it lacks, one per key; a null in a key equals a null."""
    return existing.unionByName(_same(new.dropDuplicates(keys), existing, keys, "left_anti"))


def register(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the rows of ``new`` that it lacks; a row of ``new`` with a known key and other facts is an error.

    Two rows of ``new`` with one key and other facts are an error, too.
    """
    facts = [c for c in existing.columns if c not in keys]
    both = existing.select(*keys, F.struct(*facts).alias("facts")).union(new.select(*keys, F.struct(*facts).alias("facts")))
    conflicts = both.distinct().groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    if not conflicts.isEmpty():
        raise ValueError(f"conflicting rows for {', '.join(keys)}")
    return insert_absent(new.select(*existing.columns), existing, keys)


def create(new: DataFrame, existing: DataFrame, keys: list[str], parents: dict[str, DataFrame]) -> DataFrame:
    """``existing`` and all rows of ``new``; a key that is there already, or twice, or null, or without its parent is an error.

    ``parents`` map a column of ``new`` to the table (one column) that must have its values.
    """
    if not new.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).isEmpty():
        raise ValueError(f"rows without {', '.join(keys)}")
    repeated = new.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    if not repeated.union(_same(new.select(*keys), existing, keys, "left_semi")).isEmpty():
        raise ValueError(f"rows with known {', '.join(keys)}")
    for column, parent in parents.items():
        known = parent.toDF(column)
        if not new.select(column).filter(F.col(column).isNotNull()).join(known, column, "left_anti").isEmpty():
            raise ValueError(f"rows without their {column}")
    return existing.unionByName(new.select(*existing.columns))


def illegal_steps(log: DataFrame) -> DataFrame:
    """Steps ``before, state`` of a log that are not legal."""
    legal = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("state")) for a, b in STEPS))
    return log.filter(~F.array_contains(legal, F.struct("before", "state")))
