"""Lateral joins' plans, and canonical JSON under seals."""

import json

import pytest
from pyspark.sql import functions as F

from groundline.operators.canonical import canonical_json, read_sealed, seal, write_sealed
from groundline.plans import registry

SCHEMA = "z struct<b:int,a:array<struct<y:string,x:map<string,double>>>>, a string, m map<string,struct<q:int,p:string>>, n long"
ROWS = [
    ((1, [("s", {"k": 1.5, "B": -2.0}), None, (None, None)]), "größe \"x\"\n", {"b": (1, None), "a": None, "Z": (2, "é")}, 5),
    (None, None, None, None),
    ((None, []), "", {}, 0),
]


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, list) else value


def test_canonical_json_is_sorted_at_every_depth(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = [r[0] for r in rows.select(canonical_json(rows)).collect()]
    want = [json.dumps(plain(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows.collect()]
    assert got == want
    # The order of columns, fields and map entries does not matter.
    other = rows.select("n", F.struct("z.a", "z.b").alias("z2"), "m", "a", F.col("z").isNull().alias("none"))
    other = other.select("n", F.when(~F.col("none"), F.struct("z2.a", "z2.b")).alias("z"), F.map_from_entries(F.reverse(F.map_entries("m"))).alias("m"), "a")
    assert [r[0] for r in other.select(canonical_json(other)).collect()] == want


def test_bounds_and_numbers(spark):
    rows = spark.createDataFrame([("x" * 10,), ("é" * 10,)], "a string")
    assert [r[0] is None for r in rows.select(canonical_json(rows, most_bytes=20)).collect()] == [False, True]
    for bad in (float("nan"), float("inf")):
        odd = spark.createDataFrame([([bad],)], "a array<double>")
        with pytest.raises(Exception, match="finite"):
            odd.select(canonical_json(odd)).collect()
    keys = spark.createDataFrame([({1: 2},)], "m map<int,int>")
    with pytest.raises(ValueError, match="strings"):
        canonical_json(keys)


def test_a_changed_byte_is_found(spark, tmp_path):
    rows = spark.createDataFrame(ROWS + [((9, []), "x" * 500, {}, 7)], SCHEMA)
    folder = str(tmp_path / "sealed")
    write_sealed(rows.coalesce(1), folder, most_bytes=400)
    back = read_sealed(spark, folder, rows.schema, most_bytes=400)
    assert back.count() == 3 and back.filter("NOT intact").count() == 0
    whole = lambda df: sorted(json.dumps(plain(r), sort_keys=True) for r in df.collect())
    assert whole(back.drop("seal", "intact")) == whole(rows.filter("n IS NULL OR n <> 7"))
    line = next(r[0] for r in spark.read.text(folder).collect() if '"n":5' in r[0])
    changes = [line.replace('"n":5', '"n":6'), line.replace("größe", "grösse"), line.replace(":1.5", ":1.50"), line.replace('{"a":', '{ "a":', 1), line[:-1], "", line.replace('"seal":"', '"seal":"0')]
    for k, changed in enumerate(changes):
        assert changed != line
        spark.createDataFrame([(changed or "x",)], "value string").write.text(str(tmp_path / f"c{k}"))
        assert [r["intact"] for r in read_sealed(spark, str(tmp_path / f"c{k}"), rows.schema, most_bytes=400).collect()] == [False], k
    assert seal(rows, most_bytes=400).filter("seal IS NULL").count() == 1


@pytest.mark.parametrize("name", ["lateral_top_children", "lateral_counts"])
def test_lateral_joins_become_joins_by_key(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name != "lateral_top_children" or "WindowGroupLimit" in plan
