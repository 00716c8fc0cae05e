import importlib.util
import re

import pytest
from test_near_copies import brute_force

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


@pytest.fixture(scope="module")
def folder(spark, sf_dir, odd, labels, tmp_path_factory):
    """The small documents with some odd rows, as the pipeline finds them."""
    path = tmp_path_factory.mktemp("pipeline")
    extra = odd.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL").withColumn("doc_id", odd["doc_id"] + 100_000)
    spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(extra).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_does_what_brute_force_says(spark, folder, tmp_path):
    import corpus_pipeline
    from groundline.llm.chunk_encode import load_byte_bpe
    from groundline.llm.quality import quality_scores

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        after = [tuple(r) for r in docs.collect()]
        if name == "quality_rules":
            want = [r for r in before if verdict[r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))]]
            assert sorted(after) == sorted(want) and len(want) < len(before)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[r[1]] = max(last.get(r[1], r), r)
            assert sorted(after) == sorted(last.values()) and len(after) < len(before)
        elif name == "simhash_near_dedup":
            gone = set(brute_force([(r[0], r[1]) for r in before]))
            assert sorted(after) == sorted(r for r in before if r[0] not in gone)
        elif name == "temperature_mixing":
            assert set(after) == set(before) and len(after) >= len(before)
        else:
            bpe = load_byte_bpe(__import__("public_tokenizers").path("byte_bpe_50k.json"))
            assert sorted(r[:2] for r in after) == sorted((r[0], len(bpe.encode(r[1] or "", add_special_tokens=False).ids)) for r in before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before = after


def test_run_gives_the_last_stage(spark, folder):
    import corpus_pipeline

    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() > 0


def test_quality_stage_scores_each_document_once(spark, folder):
    import corpus_pipeline
    from groundline.llm.quality import quality_scores

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("zip_with")
    assert count(corpus_pipeline.quality(spark, docs, folder)) == count(quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def test_stages_on_an_empty_table_and_clashing_columns(spark, folder, odd, empty, tmp_path):
    import corpus_pipeline

    for name, table in (("odd", odd), ("empty", empty)):
        docs = table
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, folder).write.parquet(out := str(tmp_path / f"{name}-{k}"))
            docs = spark.read.schema(table.schema).parquet(out)
            assert spark.read.parquet(out).columns == table.columns, stage_name
        assert corpus_pipeline.encoded(spark, docs, folder).count() == docs.count()
        assert name == "odd" or docs.count() == 0


def test_stages_keep_columns_of_any_name(spark, folder, tmp_path):
    import corpus_pipeline

    names = ["a.b", "pipeline_row", "row", "ROWS", "carried", "key", "n_copies", "col", "back`tick", "TEXT2"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + k)
    docs.write.parquet(str(tmp_path / "start"))
    docs = spark.read.parquet(str(tmp_path / "start"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all([r[c] for c in names] == [r["doc_id"] * 100 + k for k in range(len(names))] for r in rows), name
