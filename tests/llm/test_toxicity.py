import random

import pytest
from pyspark.sql import functions as F

from groundline.llm.language_id import held_out
from groundline.llm.toxicity import Matcher, allowed_edits, choose_terms, hits, toxicity

TERMS = ["idiot", "scum", "worthless", "disgusting", "clown", "clowns", "vequ*"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def slow_find(token):
    for k, t in enumerate(TERMS):
        if t.endswith("*") and token.startswith(t[:-1]):
            return 0, k
    near = [(distance(token, t), k) for k, t in enumerate(TERMS) if not t.endswith("*")]
    return min(((d, k) for d, k in near if d <= allowed_edits(TERMS[k])), default=None)


def test_automaton_finds_what_distances_say():
    rng, matcher = random.Random(1), Matcher(TERMS, most_states=40, most_tokens=300)
    alphabet = "idotscumwrhlegnv*é"
    for _ in range(4000):
        token = list(rng.choice(TERMS).removesuffix("*")) if rng.random() < 0.8 else []
        for _ in range(rng.randint(0, 4)):
            at, what = rng.randint(0, len(token)), rng.randint(0, 2)
            token[at : at + (what > 0)] = [] if what == 1 else [rng.choice(alphabet)]
        token = "".join(token)
        assert matcher.find(token) == slow_find(token), token
    assert len(matcher.states) <= 100 and len(matcher.known) <= 301


def test_marks_parts_and_letters_for_letters():
    matcher = Matcher(TERMS)
    assert matcher.nearest('"Idiot!"') == (0, 0) and matcher.nearest("id1ot") == (1, 0) and matcher.nearest("id!ot") == (1, 0)
    assert matcher.nearest("x,scum;y") == (0, 1) and matcher.nearest("scun") is None and matcher.nearest("dizgustin") == (2, 3)
    assert matcher.nearest("***") is None and matcher.nearest("vequille") == (0, 6)


@pytest.mark.parametrize("text, quoted", [("you idiot", False), ('He shouted "you idiot" again', True), ("« quel idiot » dit il", True), ("she called him an idiot", True), ('"yes" idiot no', False), ('an "idiot" here', True), ('far " one two three four five six idiot', False), ("idiot", False)])
def test_quotation(text, quoted):
    [(_, kind, term)] = [h for h in hits(text, Matcher(TERMS)) if h[2] == 0]
    assert (kind // 2 % 2 == 1) == quoted and term == 0


def test_company_and_edits_make_kinds():
    found = hits("idiot scum " + "a " * 20 + "worthles", Matcher(TERMS))
    assert found == [(0, 1, 0), (1, 1, 1), (22, 4, 2)]


def test_lexicon_leaves_out_relatives():
    rows = [("clown", 9, 5.0), ("clow*", 9, 5.0), ("vequ*", 30, 5.0), ("vequa", 12, 5.0), ("veq*", 30, 5.0), ("vequai*", 8, 5.0)]
    assert choose_terms(rows, 10) == ["vequ*", "clown", "vequa"] and choose_terms(rows, 1) == ["vequ*"]


@pytest.fixture(scope="module")
def planted():
    """Toxic documents hold two of the terms, clean ones none; a third is misspelled or quoted in new documents."""
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "blat brun cor del fim gran".split() for b in "ona ire emo" .split() for c in ("", "s", "ten")]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    docs, labels = [], []
    for k in range(400):
        toxic, body = k % 4 == 0, prose(rng.randint(30, 90))
        if toxic:
            for term in rng.sample(["idiot", "scum", "worthless", "vequille", "vequon"], 2):
                body.insert(rng.randrange(len(body)), term)
        docs.append((k, " ".join(body)))
        labels.append((k, 1, int(toxic)))
    new = [(1000, " ".join([*prose(20), "worthles", *prose(3), "idiiot", *prose(20)])), (1001, " ".join(prose(60))), (1002, " ".join([*prose(20), '"idiot"', *prose(20)])), (1003, None), (1004, ""), (1005, "vequanto " + " ".join(prose(10)) + " scum")]
    return docs, labels, new


def test_planted_terms_are_learned_and_met_misspelled(spark, planted):
    docs, labels, new = planted
    training = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity(spark.createDataFrame([*docs, *new, (1001, new[1][1])], "doc_id long, text string"), training, marks).collect()}
    assert all(rows[k]["predicted"] == t for k, _, t in labels)
    assert [rows[k]["predicted"] for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 0, 0, 0, 0, 1]
    assert {"idiot", "worthless"} == set(rows[1000]["terms"]) and rows[1000]["n_hits"] == 2
    assert rows[1003]["score"] == rows[1004]["score"] == rows[1001]["score"] > 0


def test_nothing_to_learn_from(spark, odd, labels, empty):
    none = toxicity(odd, odd, labels.limit(0)).collect()
    assert len(none) == odd.count() and max(r["score"] for r in none) < 1e-9
    assert toxicity(empty, empty, labels).collect() == []
    assert all(0 <= r["score"] <= 1 for r in toxicity(odd, odd, labels).collect())


def test_held_out_documents(spark, sf_dir):
    from groundline.llm.queries import op11_toxicity

    folder = sf_dir.replace("sf0.001", "sf0.1")
    result = op11_toxicity(spark, folder)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = result.join(marks.select("doc_id", "toxic"), "doc_id", "left").join(docs.select("doc_id", held_out(F.col("doc_id")).alias("want")), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == r["want"] and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    tried = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    found = sum(r["predicted"] for r in tried if r["toxic"]) / sum(r["toxic"] for r in tried)
    false = sum(r["predicted"] for r in tried if not r["toxic"]) / sum(not r["toxic"] for r in tried)
    # Here many of the words are rare forms of stems that clean texts have, too.
    assert found >= 0.8 and false <= 0.03
