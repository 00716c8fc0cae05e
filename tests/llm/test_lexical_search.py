import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from groundline.llm import lexical_search, oracle
from groundline.llm.lexical_search import BITS, LEVELS, Searches, levels_of, search, sliced, terms

ITEMS = [(1, "the of and que ALPHA the"), (2, "größe naïve été"), (3, "Licensed MIT-License alpha"), (4, None), (5, ""), (6, "nowhere-to-be-found"), (None, "one two"), (7, "x" * 5000), (8, "ok 日本語 ok"), (1, "the of and que ALPHA the"), (9, "beta " * 40 + "gamma")]


def slow(rows, items, top=10):
    """Every document scored for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(split(t))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(split(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        scored = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items())
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_equals_scoring_every_document(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = search(odd, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == slow(rows, ITEMS)


def test_groups_and_small_blocks_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BITS", 10_000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(search(odd, items, top=3, group_items=4)) == slow([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS, 3)


def test_ties_copies_and_missing_ids(spark):
    rows = [(k, "alpha beta") for k in range(30, 0, -1)] + [(None, "alpha beta alpha")] + [(5, "alpha gamma")] * 3 + [(-(2**62), "alpha beta")]
    items = [(1, "alpha"), (2, "gamma gamma"), (3, "beta alpha")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert found(search(docs, asked)) == slow(rows, items)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(empty, items).collect() == [] and search(odd, items.limit(0)).collect() == []


def test_bounds_hold_and_exclude(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randint(1, 400))) for _ in range(300)]
    counts = [Counter(terms(t.encode())) for t in texts]
    searches = Searches([" ".join(rng.sample(words, 12)) for _ in range(20)])
    df = Counter(t for c in counts for t in c)
    searches.weigh(len(texts), sum(map(len, map(str.split, texts))), {k: df[t.decode().encode()] for t, k in searches.vocabulary.items()})
    digest = lambda c: np.fromiter(map(lexical_search.xxhash.xxh64_intdigest, c), dtype=np.uint64, count=len(c))
    slices = sliced([(digest(c), np.fromiter(c.values(), dtype=np.int64)) for c in counts], BITS * 512)
    levels = levels_of(slices, len(texts), searches.hashes)
    for t, k in searches.vocabulary.items():
        assert all(levels[k, d] >= np.searchsorted(LEVELS, c[t], side="right") for d, c in enumerate(counts))
    bounds = searches.bounds(slices, np.array([sum(c.values()) for c in counts]), chunk=7, part=11)
    exact = np.array([searches.score(t.encode(), list(range(20))) for t in texts]).T
    assert (bounds >= exact).all()
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (bounds >= tenth[:, None]).mean() < 0.2  # most documents are excluded without their texts


@pytest.mark.parametrize("name", ["odd", "small"])
def test_sql_states_the_same(spark, odd, sf_dir, name, tmp_path):
    from groundline.llm.queries import op12_lexical_search

    if name == "odd":
        odd.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([x for x in ITEMS if x[0]], "item_id long, text string").distinct().write.parquet(f"{tmp_path}/benchmark.parquet")
        sf_dir = str(tmp_path)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{sf_dir}/{t}.parquet"
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if name == 'odd' else path}'")
    want = duck.sql(oracle.LEXICAL_SEARCH)
    got = op12_lexical_search(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr) and got.count()
