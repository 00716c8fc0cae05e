"""Tables that are computed once: written to the shared checkpoint folder and read from there."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the cluster names in spark.checkpoint.dir, or that was set on the context.

    Where there is none, a local master gets a temporary folder; on a cluster
    executors could not share it, so that is an error.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="groundline-checkpoint-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: While a table is cut, Spark removes the shuffle files behind it at the end, and infers no constraints,
#: which the table would pass on: from one round of a loop to the next they would grow without bound.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.constraintPropagation.enabled": "false"}


_SWITCHED = threading.RLock()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is computed or written meanwhile leaves no shuffle files behind.

    The settings for that are the session's, so threads of one session go one
    after the other; a session that has them from the start needs no switch.
    """
    with _SWITCHED:
        before = {key: old for key, value in _SETTINGS.items() if (old := spark.conf.get(key)) != value}
        for key in before:
            spark.conf.set(key, _SETTINGS[key])
        try:
            yield
        finally:
            for key, old in before.items():
                spark.conf.set(key, old)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage.

    Nothing reads the shuffle files behind it any more, so they are removed at
    once: the disk holds what is in use, not what was.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
