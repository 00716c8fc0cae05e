import random

import pytest
from pyspark.sql import functions as F

from groundline.llm import near_copies as module
from groundline.llm.common import numbered
from groundline.llm.near_copies import near_components, near_copies


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def brute_force(rows):
    """doc_ids of all but the least of each component over all pairs at 0.8 or more."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) != i)


def planted():
    """Groups, chains and pairs around the threshold, texts around a common passage, short and empty texts."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            base = list(base)  # a chain: each changes the last
            for _ in range(rng.randint(1, max(1, len(base) // 35))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(2, 80))]) for _ in range(60)]
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(60):  # a large group
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(copy))
    footer = [rng.choice(words) for _ in range(40)]  # pages of a few own words around one passage, below, at and above the threshold
    texts += [" ".join([rng.choice(words) for _ in range(k % 9)] + footer[: 40 - k % 3] + [rng.choice(words) for _ in range(k % 4)]) for k in range(120)]
    parts = [[rng.choice(words) for _ in range(12)] for _ in range(12)]  # pages made of common passages only
    texts += [" ".join(w for k in sorted(rng.sample(range(12), rng.randint(4, 7))) for w in parts[k]) for _ in range(80)]
    return list(enumerate(texts))


@pytest.mark.parametrize("how", [{}, {"one_in": 1, "times": 2}, {"one_in": 1, "times": 20}, {"one_in": 1, "times": 2, "most": 40}])
def test_near_copies_are_those_of_all_pairs(spark, tmp_path, how):
    rows = planted()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents"))
    docs = numbered(spark.read.parquet(str(tmp_path / "documents")))
    gone = near_copies(docs, **how).join(docs, "row").select("doc_id").collect()
    want = brute_force(rows)
    assert sorted(r[0] for r in gone) == want and 60 < len(want) < len(rows) - 60


def test_pages_around_one_passage_are_not_paired(spark, tmp_path, monkeypatch):
    """3,000 pages of six own words and a passage of forty: near to none, and no pair of them is formed."""
    rng = random.Random(4)
    footer = " ".join(f"footer{k}" for k in range(40))
    rows = [(k, " ".join(f"own{rng.randrange(10**9)}" for _ in range(6)) + " " + footer) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents"))
    docs = numbered(spark.read.parquet(str(tmp_path / "documents")))
    verified = []
    plain = module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *how: verified.append(pairs.count()) or plain(pairs, *how))
    assert near_components(docs).count() == 0
    assert sum(verified) <= 2 * len(rows)


def test_stage_drops_near_copies_beyond_two_bits(spark, tmp_path):
    import corpus_pipeline

    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a"))
    docs.write.parquet(str(tmp_path / "documents"))
    left = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "documents")), "")
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(r[0] for r in left.collect()) == sorted({k for k, _ in rows} - set(brute_force(rows)))


def test_sketches_differ_in_no_more_bits_than_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(-(2**62), 2**62, 400)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 350))) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (module.sketch(a) ^ module.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
