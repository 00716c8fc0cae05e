import math
from collections import defaultdict

import pytest

from groundline.llm.mixing import mix, source_weights


def weights(tokens, exponent):
    total = sum(tokens)
    raw = [(t / total) ** exponent for t in tokens]
    return [r / sum(raw) for r in raw]


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def slow_exponent(tokens, target, most):
    """By fine steps from the natural shares down."""
    steps = [k / 20000 for k in range(20000, -1, -1)]
    by_entropy = next((e for e in steps if entropy(weights(tokens, e)) >= target * math.log(len(tokens)) - 1e-12), 0.0)
    epochs = lambda e: max(w / t for w, t in zip(weights(tokens, e), tokens)) / min(w / t for w, t in zip(weights(tokens, e), tokens))
    by_epochs = next(e for e in reversed(steps) if epochs(e) <= most)
    return max(by_entropy, by_epochs)


@pytest.mark.parametrize(("target", "most"), [(0.93, 4.0), (0.99, 100.0), (0.5, 4.0), (1.0, 2.0)])
def test_exponent_matches_brute_force(spark, target, most):
    tokens = {"a": 90_000, "b": 5_000, "c": 4_000, "d": 1_000}
    got = source_weights(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), target_entropy=target, max_epochs=most, budget=None).collect()
    want = slow_exponent(list(tokens.values()), target, most)
    assert all(abs(r["exponent"] - want) < 1e-4 for r in got)
    table = source_weights(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), target_entropy=target, max_epochs=most, budget=None, max_sources=1).collect()
    for r, t in zip(sorted(got), sorted(table)):  # more sources than meet in one array
        assert r["source"] == t["source"] and abs(r["exponent"] - t["exponent"]) < 2e-9 and abs(r["weight"] - t["weight"]) < 2e-9 and abs(r["budget_tokens"] - t["budget_tokens"]) <= 1
    for r, w in zip(sorted(got), weights(list(tokens.values()), got[0]["exponent"])):
        assert abs(r["weight"] - w) < 1e-8
        assert tokens[r["source"]] <= r["budget_tokens"] <= most * tokens[r["source"]] + 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, "word " * (i % 17 + 1), "en", "hot" if i % 3 else f"s{i % 9}", 1) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("mix") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_budgets_are_spent_in_blocks(spark, corpus):
    used, have, budget, blocks = defaultdict(int), defaultdict(int), {}, defaultdict(set)
    rows = mix(corpus, block_tokens=200).collect()
    assert len(rows) == 3000
    for r in rows:
        used[r["source"]] += r["n_copies"] * r["n_tokens"]
        have[r["source"]] += r["n_tokens"]
        blocks[r["source"], r["block"]].add(r["n_copies"])
    tokens = spark.createDataFrame(list(have.items()), "source string, tokens long")
    for r in source_weights(tokens, target_entropy=0.93, max_epochs=4.0, budget=None).collect():
        assert r["budget_tokens"] - 17 <= used[r["source"]] <= r["budget_tokens"]
    assert min(r["n_copies"] for r in rows) >= 1 and max(r["n_copies"] for r in rows) <= 4
    # A source is cut within one block at most; all others are taken whole or not at all.
    split = defaultdict(int)
    for (source, _), counts in blocks.items():
        split[source] += len(counts) > 1
    assert max(split.values()) <= 1


def test_given_budget_and_repeatability(corpus):
    runs = [sorted((r["doc_id"], r["n_copies"]) for r in mix(corpus, budget=9000, max_epochs=2.0).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    assert sorted((r["doc_id"], r["n_copies"]) for r in mix(corpus, budget=9000, max_epochs=2.0, max_sources=2).collect()) == runs[0]
    size = {r["doc_id"]: r["doc_id"] % 17 + 1 for r in corpus.select("doc_id").collect()}
    spent = sum(size[i] * n for i, n in runs[0])
    assert 8800 <= spent <= 9000
    assert sorted((r["doc_id"], r["n_copies"]) for r in mix(corpus, budget=9000, max_epochs=2.0, seed=5).collect()) != runs[0]


def test_odd_rows_and_empty_table(odd, empty):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r["n_copies"] >= 1 for r in rows)
    assert mix(empty).count() == 0
    blank = odd.filter("doc_id IN (1, 2, 3)")
    assert [r["n_copies"] for r in mix(blank).collect()] == [1, 1, 1]
