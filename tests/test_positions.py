"""Places of pages and evidence in whole documents, by hand and by plain Python."""

import random

from pyspark.sql import functions as F

from groundline.operators.ingest import PAGE_WORDS, pages, placed_pages, starts_early


def test_places_are_those_of_the_joined_pages(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "one", "a " * PAGE_WORDS, "bb " * (PAGE_WORDS + 1)]
    texts += [" ".join("w" * rng.randint(1, 9) for _ in range(n)) for n in (299, 600, 601, 12_345)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("a"))
    page_texts = {}
    for r in pages(docs).orderBy("doc_id", "page_index").collect():
        page_texts.setdefault(r["doc_id"], []).append(r["page_text"])
    want = set()
    for doc, parts in page_texts.items():
        whole, at = "\n".join(parts), 0
        for k, part in enumerate(parts):
            assert whole[at : at + len(part)] == part
            want.add((doc, k, at, len(whole)))
            at += len(part) + 1
    found = placed_pages(docs)
    assert found.columns == ["doc_id", "page_index", "page_base", "document_length"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_places_need_no_shuffle_and_one_scan(spark, sf_dir):
    plan = placed_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1


def test_the_first_quarter_ends_before_its_bound(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (24, 100), (25, 100), (25, 101), (1, 4)], "start long, length long")
    assert [r[0] for r in rows.select(starts_early(F.col("start"), F.col("length"))).collect()] == [False, True, True, False, True, False]
