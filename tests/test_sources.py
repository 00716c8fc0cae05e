import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundline.sources.publish import PublicationConflict, create, current_generation, fingerprint, illegal_steps, insert_absent, is_current, move_once, pointers, publish, read_current, register, release, write_once
from groundline.sources.tables import admit_vectors, binary_files, inventory_violations, strict_json
from groundline.streaming.publications import current_pointers, distinct_publications, keep_pointers, read_log, windowed_counts


def test_publication_is_checked_and_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    positive = {"positive": lambda d: d.filter("v <= 0")}
    assert read_current(spark, root, "k") is None
    first = publish(spark.createDataFrame([(1,), (2,)], "v int"), root, "k", positive, 1)
    with pytest.raises(ValueError, match="positive"):
        publish(spark.createDataFrame([(0,)], "v int"), root, "k", positive, 2)
    assert current_generation(spark, root, "k") == first
    assert publish(spark.createDataFrame([(2,), (1,)], "v int"), root, "k", positive, 3) == first
    second = publish(spark.createDataFrame([(5,)], "v int"), root, "k", positive, 4)
    assert second != first and read_current(spark, root, "k").collect()[0]["v"] == 5


def test_fingerprints_tell_nulls_types_and_columns_apart(spark):
    rows = [([(1, None)], "a int, b int"), ([(None, 1)], "a int, b int"), ([(1, None)], "a long, b int"), ([(1, None)], "b int, a int"), ([], "a int, b int"), ([(1, None)] * 2, "a int, b int"), ([("1", None)], "a string, b int")]
    assert len({fingerprint(spark.createDataFrame(r, s)) for r, s in rows}) == len(rows)
    mixed = spark.createDataFrame([(k, k % 3) for k in range(50)], "a int, b int")
    assert fingerprint(mixed) == fingerprint(mixed.repartition(7).orderBy("b"))


def test_folders_are_written_once(spark, tmp_path):
    root = str(tmp_path / "store")
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,)], "v int")
    first = publish(a, root, "k", {}, 1)
    held = read_current(spark, root, "k")
    files = sorted(p.name for p in (tmp_path / f"store/generations/{first}").iterdir())
    assert publish(b, root, "k", {}, 2) != first
    assert publish(a, root, "k", {}, 3) == first and current_generation(spark, root, "k") == first
    assert sorted(p.name for p in (tmp_path / f"store/generations/{first}").iterdir()) == files
    other = publish(a, root, "other", {}, 1)
    assert other != first and held.collect()[0]["v"] == 1
    none = publish(a.limit(0), root, "k", {}, 4)
    assert none != first and read_current(spark, root, "k").count() == 0


def test_reads_stop_when_the_source_has_moved(spark, tmp_path):
    root = str(tmp_path / "store")
    g = publish(spark.createDataFrame([(1,)], "v int"), root, "k", {}, 1, snapshot="s1")
    assert read_current(spark, root, "k", snapshot="s1").count() == 1 and read_current(spark, root, "k", snapshot="s2") is None
    assert is_current(spark, root, "k", g, "s1") and not is_current(spark, root, "k", g, "s2")
    assert publish(spark.createDataFrame([(1,)], "v int"), root, "k", {}, 2, snapshot="s2") == g
    assert is_current(spark, root, "k", g, "s2") and not is_current(spark, root, "k", g, "s1")


def test_registered_facts_do_not_change(spark):
    old = spark.createDataFrame([("p", 384, None)], "profile string, dim int, note string")
    same = spark.createDataFrame([("p", 384, None), ("q", 768, "x"), ("q", 768, "x")], "profile string, dim int, note string")
    assert sorted(r["profile"] for r in register(same, old, ["profile"]).collect()) == ["p", "q"]
    for rows in ([("p", 385, None)], [("q", 1, None), ("q", 2, None)], [("p", 384, "now")]):
        with pytest.raises(ValueError, match="conflicting"):
            register(spark.createDataFrame(rows, "profile string, dim int, note string"), old, ["profile"])


def test_created_rows_need_new_keys_and_parents(spark):
    projects = spark.createDataFrame([("a",)], "project string")
    papers = spark.createDataFrame([("x", "a")], "paper string, project string")
    new = lambda *rows: spark.createDataFrame(rows, "paper string, project string")
    assert create(new(("y", "a"), ("z", None)), papers, ["paper"], {"project": projects}).count() == 3
    for rows, why in (([("x", "a")], "known"), ([("y", "a"), ("y", "a")], "known"), ([("y", "b")], "without")):
        with pytest.raises(ValueError, match=why):
            create(new(*rows), papers, ["paper"], {"project": projects})


def test_insert_absent_and_steps(spark):
    old = spark.createDataFrame([("p", "a", 1)], "paper string, sha string, n int")
    new = spark.createDataFrame([("p", "a", 2), ("p", "b", 3), ("p", "b", 3)], "paper string, sha string, n int")
    assert sorted(map(tuple, insert_absent(new, old, ["paper", "sha"]).collect())) == [("p", "a", 1), ("p", "b", 3)]
    log = spark.createDataFrame([("DB_CANDIDATE", "FILES_FINALIZED"), ("STALE", "FILES_FINALIZED")], "before string, state string")
    assert [tuple(r) for r in illegal_steps(log).collect()] == [("STALE", "FILES_FINALIZED")]


def test_json_binary_and_bounded_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n')
    (tmp_path / "b.json").write_text('{"x": \n')
    assert strict_json(spark, str(tmp_path / "a.json"), "x int").first()["x"] == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        strict_json(spark, str(tmp_path / "b.json"), "x int").collect()
    files = binary_files(spark, str(tmp_path), "*.json")
    manifest = files.select("path", "length", "sha256").filter(F.col("path").endswith("a.json")).union(spark.createDataFrame([("gone", 1, "x")], "path string, length long, sha256 string"))
    assert sorted(r["fault"] for r in inventory_violations(files, manifest).collect()) == ["missing", "unexpected"]
    vectors = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    assert admit_vectors(vectors, "v", max_rows=3, dimension=2).count() == 3
    with pytest.raises(Exception, match="admitted"):
        admit_vectors(vectors, "v", max_rows=2, dimension=2).collect()


def test_streamed_log(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for k, rows in enumerate([[(1, at(1), 7, "a", 1.0), (2, at(2), 8, "b", 2.0)], [(2, at(2), 8, "b", 2.0), (3, at(30), 7, "a", 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"log/part{k}"))
    log = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    q = windowed_counts(distinct_publications(log)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("counts").collect()) == [("a", 1, 1.0), ("a", 1, 4.0), ("b", 1, 2.0)]
    flat = read_log(spark, str(tmp_path / "log/part1"), spark.table("counts").sparkSession.createDataFrame([], schema).schema)
    keep_pointers(flat, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["user_id"]: r["generation_id"] for r in current_pointers(spark, str(tmp_path / "out")).collect()} == {8: 2, 7: 3}


def test_of_two_interleaved_publishers_one_wins(spark, tmp_path):
    """Both have read the same pointer; the loser changes nothing, its files and the winner's stay whole."""
    root = str(tmp_path / "store")
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    first = publish(frame(1), root, "k", {}, 1, expected=None)
    won = []

    def between():  # the other publisher acts after this one's rows are written and checked
        won.append(publish(frame(3), root, "k", {}, 2, expected=first))
        return "s"

    with pytest.raises(PublicationConflict):
        publish(frame(2), root, "k", {}, 2, snapshot="s", expected=first, still=between)
    assert current_generation(spark, root, "k") == won[0] and read_current(spark, root, "k").first()["v"] == 3
    assert len(list((tmp_path / "store/pointers").glob("*/*.json"))) == 2
    folders = {p.name for p in (tmp_path / "store/generations").iterdir()}
    assert len(folders) == 3 and {first, won[0]} < folders
    # What has lost may be released later, on top of the winner.
    lost = (folders - {first, won[0]}).pop()
    assert release(spark, root, "k", lost, 3, expected=won[0]) == lost and read_current(spark, root, "k").first()["v"] == 2
    with pytest.raises(PublicationConflict, match="not at"):
        publish(frame(9), root, "k", {}, 4, expected=first)
    with pytest.raises(PublicationConflict, match="too late"):
        publish(frame(9), root, "k", {}, 3)
    assert {r["key"]: r["generation_id"] for r in pointers(spark, root).collect()} == {"k": lost}


def test_release_checks_the_source_again_and_leaves_no_staging(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(PublicationConflict, match="moved on"):
        publish(frame, root, "k", {}, 1, snapshot="s1", still=lambda: "s2")
    assert current_generation(spark, root, "k") is None
    publish(frame, root, "k", {}, 1, snapshot="s2", still=lambda: "s2")
    with pytest.raises(ValueError):
        publish(frame, root, "k", {"never": lambda d: d}, 2)
    assert list((tmp_path / "store/staging").iterdir()) == []


def test_names_are_taken_once_and_half_written_folders_stay(spark, tmp_path):
    assert write_once(spark, str(tmp_path / "a/x.json"), "1") and not write_once(spark, str(tmp_path / "a/x.json"), "2")
    assert (tmp_path / "a/x.json").read_text() == "1" and [p.name for p in (tmp_path / "a").glob("*.draft")] == []
    other = tmp_path / "other"  # another job is writing here: no mark of success yet
    other.mkdir()
    (other / "part").write_text("half")
    (tmp_path / "mine").mkdir()
    assert not move_once(spark, str(tmp_path / "mine"), str(other)) and (other / "part").read_text() == "half" and (tmp_path / "mine").exists()


def test_null_keys(spark):
    old = spark.createDataFrame([("p", None, 1), (None, "a", 2)], "paper string, sha string, n int")
    new = spark.createDataFrame([("p", None, 3), (None, "a", 4), (None, None, 5), (None, None, 6)], "paper string, sha string, n int")
    rows = insert_absent(new, old, ["paper", "sha"]).collect()
    assert sorted((r["paper"] or "", r["sha"] or "") for r in rows) == [("", ""), ("", "a"), ("p", "")]
    with pytest.raises(ValueError, match="without"):
        create(new, old, ["paper", "sha"], {})
    with pytest.raises(ValueError, match="conflicting"):
        register(new.limit(1), old, ["paper", "sha"])
