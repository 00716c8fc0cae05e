"""The stored inverted index against a search that tokenises everything, and its generations."""

import pytest
from pyspark.sql import functions as F

from groundline.operators.inverted_index import document_postings, generations, index_bm25, live_documents, live_postings, posting_faults, publish_generation
from groundline.operators.ranking import bm25
from groundline.sources.publish import PublicationConflict

TEXTS = [(1, "alpha beta beta gamma"), (2, "alpha"), (3, ""), (4, None), (5, "Größe alpha-beta; delta"), (6, "the the the the")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def searches(spark):
    return spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "größe"), (3, "nowhere"), (4, "the"), (4, "the")], "q int, term string")


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_search_equals_bm25_after_every_generation(spark, tmp_path, searches):
    root = str(tmp_path / "index")
    assert index_bm25(spark, root, searches, query_key="q").collect() == []
    publish_generation(frame(spark, TEXTS), root, n_buckets=8)
    assert rows(index_bm25(spark, root, searches, query_key="q")) == rows(bm25(frame(spark, TEXTS), searches, query_key="q"))
    publish_generation(frame(spark, [(2, "beta the"), (7, "alpha delta")]), root, removed=spark.createDataFrame([(1,), (99,)], "doc_id long"))
    live = [(2, "beta the"), *TEXTS[2:], (7, "alpha delta")]
    assert rows(index_bm25(spark, root, searches, query_key="q")) == rows(bm25(frame(spark, live), searches, query_key="q"))
    assert rows(live_documents(spark, root).select("doc_id")) == [(k,) for k in (2, 3, 4, 5, 6, 7)]
    assert [(g.number, g.n_buckets, g.n_documents, g.n_tokens) for g in generations(spark, root)] == [(1, 8, 6, 13), (2, 8, 6, 12)]
    assert rows(posting_faults(live_postings(spark, root), frame(spark, live))) == []
    # A document that was removed may come back.
    publish_generation(frame(spark, [(1, "gamma")]), root)
    assert rows(live_documents(spark, root).filter("doc_id = 1").select("dl")) == [(1,)] and generations(spark, root)[-1].n_documents == 7


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    root = str(tmp_path / "index")
    publish_generation(frame(spark, [(k, " ".join(f"w{j}" for j in range(k, k + 30))) for k in range(50)]), root, n_buckets=16)
    one = spark.createDataFrame([(1, "w40")], "q int, term string")
    last = generations(spark, root)[-1]
    wanted = index_bm25(spark, root, one, query_key="q")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = {p for p in wanted.inputFiles() if "/postings/" in p}
    assert files == set() or len({p.split("bucket=")[1].split("/")[0] for p in files}) == 16  # listed, but pruned when read
    read = live_postings(spark, root, [last], [int(bucket_of(spark, "w40", 16))]).select("term").distinct().count()
    assert 0 < read < 79 and wanted.count() == 30


def bucket_of(spark, term, n):
    from groundline.operators.inverted_index import bucket

    return spark.range(1).select(bucket(F.lit(term), n)).first()[0]


def test_unfinished_generations_are_not_there_and_one_of_two_publishers_wins(spark, tmp_path, searches, monkeypatch):
    import groundline.operators.inverted_index as module

    root = str(tmp_path / "index")
    publish_generation(frame(spark, TEXTS), root, expected=0)
    before = rows(index_bm25(spark, root, searches, query_key="q"))
    plain = module.write_once
    monkeypatch.setattr(module, "write_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        publish_generation(frame(spark, [(1, "beta")]), root)
    assert rows(index_bm25(spark, root, searches, query_key="q")) == before

    def late(spark_, path, body):  # another publisher is done just before this one's manifest
        monkeypatch.setattr(module, "write_once", plain)
        publish_generation(frame(spark, [(2, "delta")]), root)
        return plain(spark_, path, body)

    monkeypatch.setattr(module, "write_once", late)
    with pytest.raises(PublicationConflict):
        publish_generation(frame(spark, [(1, "beta")]), root)
    assert [g.number for g in generations(spark, root)] == [1, 2] and rows(live_documents(spark, root).filter("doc_id IN (1, 2)").select("doc_id", "dl")) == [(1, 4), (2, 1)]
    with pytest.raises(PublicationConflict):
        publish_generation(frame(spark, [(1, "beta")]), root, expected=1)


def test_ids_are_unique_and_faults_are_told_apart(spark, tmp_path):
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="unique"):
            publish_generation(frame(spark, bad), str(tmp_path / f"bad{len(bad)}"))
    good = document_postings(frame(spark, TEXTS))
    odd = good.filter("NOT (doc_id = 1 AND term = 'gamma')").union(good.filter("doc_id = 2")).union(spark.createDataFrame([("zeta", 1, 1, 4)], good.schema)).withColumn("tf", F.when(F.col("doc_id") == 6, 1).otherwise(F.col("tf")))
    assert rows(posting_faults(odd, frame(spark, TEXTS))) == [("alpha", 2, "duplicated"), ("gamma", 1, "missing"), ("the", 6, "different"), ("zeta", 1, "unexpected")]


def test_audit_compares_a_part_of_the_documents_at_a_time(spark, monkeypatch):
    """The same faults in several rounds; postings are counted within their rows, without a shuffle."""
    import groundline.operators.inverted_index as module

    docs = frame(spark, [(k, f"alpha beta{k % 7} beta{k % 7} w{k}") for k in range(60)] + [(90, None), (91, "-- !")])
    good = document_postings(docs)
    assert "Exchange" not in good._jdf.queryExecution().executedPlan().toString()
    assert rows(good.filter("doc_id IN (3, 90, 91)")) == [("alpha", 3, 1, 4), ("beta3", 3, 2, 4), ("w3", 3, 1, 4)]
    odd = good.filter("NOT (doc_id % 9 = 2 AND term = 'alpha')").union(good.filter("doc_id = 5")).withColumn("tf", F.when((F.col("doc_id") == 8) & (F.col("tf") > 1), F.lit(None)).otherwise(F.col("tf")))
    want = sorted([("alpha", k, "missing") for k in range(60) if k % 9 == 2] + [(t, 5, "duplicated") for t in ("alpha", "beta5", "w5")] + [("beta1", 8, "different")], key=repr)
    parts = []
    plain = module.cut
    monkeypatch.setattr(module, "cut", lambda df: (parts.append(1), plain(df))[1])
    monkeypatch.setattr(module, "_ROUND", 60)
    assert rows(posting_faults(odd, docs)) == want and len(parts) == 3


def test_generations_without_live_documents_are_not_read(spark, tmp_path, searches):
    """All of the first generation is superseded, none of the second, a part of the third."""
    root = str(tmp_path / "index")
    publish_generation(frame(spark, [(k, "alpha beta") for k in range(6)]), root, n_buckets=4)
    publish_generation(frame(spark, [(k, "alpha") for k in (1, 3, 5)]), root)
    publish_generation(frame(spark, [(0, "beta"), (2, "delta")]), root, removed=spark.createDataFrame([(4,)], "doc_id long"))
    plan = lambda: live_postings(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan() and not [p for p in live_postings(spark, root).inputFiles() if "part=00000001" in p]
    publish_generation(frame(spark, [(2, "the the")]), root)
    assert "Join" in plan()
    live = [(0, "beta"), (1, "alpha"), (2, "the the"), (3, "alpha"), (5, "alpha")]
    assert rows(live_postings(spark, root)) == rows(document_postings(frame(spark, live)))
    assert rows(index_bm25(spark, root, searches, query_key="q")) == rows(bm25(frame(spark, live), searches, query_key="q"))
    assert [(g.n_added, sorted(g.n_superseded.values())) for g in generations(spark, root)] == [(6, []), (3, [3]), (2, [3]), (1, [1])]


def test_publishing_tokenises_each_text_once(spark, tmp_path, monkeypatch):
    """Lengths come from the postings, also those of documents without terms."""
    import groundline.operators.inverted_index as module

    made, plain = [], module.tokens
    monkeypatch.setattr(module, "tokens", lambda text: (made.append(1), plain(text))[1])
    publish_generation(frame(spark, TEXTS), str(tmp_path / "index"))
    assert len(made) == 1
    assert rows(live_documents(spark, str(tmp_path / "index")).select("doc_id", "dl")) == [(1, 4), (2, 1), (3, 0), (4, 0), (5, 4), (6, 4)]
