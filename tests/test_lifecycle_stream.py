"""The lifecycle of generations as a stream with state against the audit of the whole log."""

import datetime as dt
import itertools

from groundline.streaming.lifecycle import checked_steps, steps_in_batch

SCHEMA = "generation_id long, ts timestamp, event_id long, state string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def run(spark, tmp_path, **how):
    log = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    query = checked_steps(log, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema("generation_id long, event_id long, before string, state string, outcome string").parquet(str(tmp_path / "out")).collect()), key=repr)


def add(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"log/{name}"))


def slow(rows):
    """Each generation's steps one after the other."""
    steps = {(None, "DB_CANDIDATE"), ("DB_CANDIDATE", "FILES_FINALIZED"), ("DB_CANDIDATE", "STALE"), ("FILES_FINALIZED", "STALE")}
    held, out = {}, []
    for g, _, e, state in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        legal = (held.get(g), state) in steps
        out.append((g, e, held.get(g), state, "legal" if legal else "illegal"))
        if legal:
            held[g] = state
    return sorted(out, key=repr)


def test_stream_equals_the_batch_audit_also_after_a_restart(spark, tmp_path):
    states = ("DB_CANDIDATE", "FILES_FINALIZED", "STALE")
    number, rows = itertools.count(), []
    for g, path in enumerate(itertools.product(states, repeat=3)):  # all paths of three steps
        rows += [(g, at(k), next(number), s) for k, s in enumerate(path)]
    assert sorted((tuple(r) for r in steps_in_batch(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == slow(rows)
    add(spark, tmp_path, [r for r in rows if r[1] < at(1)], "a")
    assert run(spark, tmp_path) == slow([r for r in rows if r[1] < at(1)])
    add(spark, tmp_path, [r for r in rows if r[1] >= at(1)], "b")
    assert run(spark, tmp_path) == slow(rows)  # a new query goes on from the checkpoint and repeats nothing
    assert run(spark, tmp_path) == slow(rows)


def test_candidates_that_nobody_finishes_are_abandoned(spark, tmp_path):
    hour = 3_600_000
    add(spark, tmp_path, [(1, at(0), 1, "DB_CANDIDATE"), (2, at(0), 2, "DB_CANDIDATE"), (2, at(1), 3, "FILES_FINALIZED")], "a")
    assert len(run(spark, tmp_path, patience_ms=5 * hour, delay="1 hour")) == 3
    add(spark, tmp_path, [(3, at(20), 4, "DB_CANDIDATE")], "b")
    rows = run(spark, tmp_path, patience_ms=5 * hour, delay="1 hour")
    assert [r for r in rows if r[4] == "abandoned"] == [(1, None, "DB_CANDIDATE", "ABANDONED", "abandoned")]
    add(spark, tmp_path, [(1, at(21), 5, "FILES_FINALIZED")], "c")  # too late
    assert (1, 5, "ABANDONED", "FILES_FINALIZED", "illegal") in run(spark, tmp_path, patience_ms=5 * hour, delay="1 hour")
