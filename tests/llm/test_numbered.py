import pytest

from groundline.llm.common import numbered


@pytest.fixture
def packed(spark, tmp_path):
    """A table of files of many sizes, and a switch of how they are packed into partitions."""
    for k in range(6):
        rows = [(100 * k + i, f"text {100 * k + i} " * (40 * k + 1), "a") for i in range(10 + k)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    keys = {"spark.sql.files.openCostInBytes": str(200 << 20)}

    def switch(on):
        for key, value in keys.items():
            spark.conf.set(key, value) if on else spark.conf.unset(key)

    yield spark.read.parquet(str(tmp_path / "t")), switch
    switch(False)


def test_numbers_do_not_depend_on_packing(packed):
    docs, switch = packed
    one = {r["doc_id"]: r["row"] for r in numbered(docs).collect()}
    parts = docs.rdd.getNumPartitions()
    switch(True)
    assert docs.select("*").rdd.getNumPartitions() != parts
    assert {r["doc_id"]: r["row"] for r in numbered(docs).collect()} == one
    assert len(set(one.values())) == len(one) == docs.count()


@pytest.mark.parametrize("stage", ["exact", "near", "mixed"])
def test_stages_keep_all_rows_when_files_are_packed_anew(spark, packed, stage):
    import corpus_pipeline

    docs, switch = packed
    want = sorted(r[0] for r in getattr(corpus_pipeline, stage)(spark, docs, "").collect())
    out = getattr(corpus_pipeline, stage)(spark, docs, "")
    switch(True)
    assert sorted(r[0] for r in out.collect()) == want


def test_rows_that_are_no_scan_keep_their_numbers(spark, packed):
    docs, _ = packed
    twice = numbered(docs.union(docs))
    assert sorted(map(tuple, twice.select("row", "doc_id").collect())) == sorted(map(tuple, twice.select("row", "doc_id").collect()))
    assert twice.select("row").distinct().count() == 2 * docs.count()


def test_file_numbers_need_no_python_worker(packed):
    """The list of files is a local table of Spark's, not rows that Python workers deserialise."""
    docs, _ = packed
    plan = numbered(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
