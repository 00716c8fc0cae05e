import json
import random
import sqlite3
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from groundline.functions.text import collapse, content_id, normalized, query_terms, tokens, variants
from groundline.operators import planning
from groundline.operators.evidence import EMPTY_BYTES, best_chunks, bundle_state, entry_json, pack, resolution_code
from groundline.operators.ingest import budget_spans, chunk_cuts, chunks, line_order, offsets, pages
from groundline.operators.ranking import bm25, cosine_best, exact_percentiles, fuse, numbered_by, pareto_layers, ranking_metrics


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("words", "cuts"),
    [
        (["w"] * 121, [120, 121]),
        (["w"] * 140, [120, 140]),
        (["w"] * 95 + ["end."] + ["w"] * 15 + ['"done!"'] + ["w"] * 18, [112, 130]),
        (["w"] * 78 + ["end."] + ["w"] * 61, [120, 140]),
        (["w"] * 89 + ["end.)"] + ["w"] * 60, [90, 150]),
        (["w"], [1]),
    ],
)
def test_chunk_cuts(spark, words, cuts):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(chunk_cuts(F.col("w"))).first()[0] == cuts


def test_pages_and_chunks_keep_their_places(spark):
    text = " ".join(f"w{i}" for i in range(650))
    docs = spark.createDataFrame([(1, text, "s"), (2, "", "s"), (3, None, "s"), (4, "the the the", "s")], "doc_id long, text string, source string")
    p = {(r["doc_id"], r["page_index"]): len(r["page_words"]) for r in pages(docs).collect()}
    assert p == {(1, 0): 300, (1, 1): 300, (1, 2): 50, (2, 0): 0, (3, 0): 0, (4, 0): 3}
    by_page = {(r["doc_id"], r["page_index"]): r["page_text"] for r in pages(docs).collect()}
    assert {c["doc_id"] for c in chunks(pages(docs)).collect()} == {1}  # "the the the" needs another reading
    for c in chunks(pages(docs)).collect():
        assert by_page[c["doc_id"], c["page_index"]][c["start_offset"] : c["end_offset"]] == c["chunk_text"]
    assert spark.createDataFrame([(["a", "bcd", "é"],)], "w array<string>").select(offsets(F.col("w"))).first()[0] == [0, 2, 6]


def test_budget_spans(spark):
    df = spark.createDataFrame([(["aa", "bb", "c", "dddddddd", "e", "ff", "gg"],)], "w array<string>")
    got = [tuple(r) for r in df.select(budget_spans(F.col("w"), F.length, 5)).first()[0]]
    assert got == [(0, 3, True), (3, 4, False), (4, 7, True)]


def test_lines_go_by_their_first_top(spark):
    placed = [(10.0, 5.0, "b"), (13.0, 1.0, "a"), (13.1, 1.0, "c"), (16.0, 0.0, "d"), (9.9, 50.0, "x")]
    df = spark.createDataFrame([(placed,)], "p array<struct<top:double,x0:double,w:string>>")
    got = [[w["w"] for w in line] for line in df.select(line_order(F.col("p"))).first()[0]]
    assert got == [["b", "x"], ["d", "a", "c"]]  # 13.0 is over 3 below 9.9, 12.9 would not be


def test_text_functions(spark):
    df = spark.createDataFrame([("été  x y \n z ",), ("plain  text",), (None,)], "t string")
    assert sorted(r["n"] for r in normalized(df, "t", "n").collect()) == ["", "plain text", "été x y z"]
    words = spark.createDataFrame([("study",), ("boy",), ("use",), ("see",), ("box",), ("Été",), ("class",)], "t string")
    got = {r[0]: r[1] for r in words.select("t", variants(F.col("t"))).collect()}
    assert got["study"] == ["studies", "studied", "studying"] and got["boy"] == ["boys", "boyed", "boying"]
    assert got["use"] == ["uses", "used", "using"] and got["see"] == ["sees", "seed", "seeing"]
    assert got["box"] == ["boxes", "boxed", "boxing"] and got["Été"] == [] and got["class"][0] == "classes"
    q = spark.createDataFrame([("What IS the Aim of the Study's study, É-é?",)], "t string")
    assert q.select(query_terms(F.col("t"))).first()[0] == ["aim", "study", "s", "É", "é"]
    ids = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string").select(content_id("p-", F.col("x"), F.col("y"))).distinct().count()
    assert ids == 2
    assert spark.createDataFrame([(" a \t b ",)], "t string").select(collapse(F.col("t"))).first()[0] == "a b"


def test_bm25_equals_a_full_text_index(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(3, 60)))) for i in range(120)]
    index = sqlite3.connect(":memory:")
    index.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    index.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", docs)
    terms = ["w3", "w39", "w17"]
    want = dict(index.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", [" OR ".join(terms)]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25(df, spark.createDataFrame([(1, t) for t in terms], "q long, term string"), query_key="q").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in got)
    scoped = bm25(df, spark.createDataFrame([(1, t) for t in terms], "q long, term string"), query_key="q", eligible=F.col("doc_id") < 10)
    assert {r["doc_id"]: r["score"] for r in scoped.collect()} == {i: s for i, s in got.items() if i < 10}


def test_fusion_orders_like_exact_fractions(spark):
    rng = random.Random(2)
    lex = {d: r + 1 for r, d in enumerate(rng.sample(range(60), 40))}
    sem = {d: r + 1 for r, d in enumerate(rng.sample(range(60), 40))}
    frame = lambda ranks: spark.createDataFrame([(1, d, r) for d, r in ranks.items()], "q long, doc_id long, rank int")
    got = [r["doc_id"] for r in fuse(frame(lex), frame(sem), ["q", "doc_id"]).orderBy("fused_rank").collect()]
    far = 2**31 - 1

    def key(d):
        score = sum((Fraction(1, 40 + c[d]) for c in (lex, sem) if d in c), Fraction(0))
        a, b = lex.get(d, far), sem.get(d, far)
        return -score, min(a, b), -((d in lex) + (d in sem)), a, b, d

    assert got == sorted(lex.keys() | sem.keys(), key=key)


def test_pareto_layers_equal_peeling(spark):
    rng = random.Random(7)
    rows = [(q, d, rng.randint(1, 12), rng.choice([None, rng.randint(1, 12)])) for q in range(6) for d in range(15)]
    got = {(r["q"], r["doc_id"]): r["layer"] for r in pareto_layers(spark.createDataFrame(rows, "q long, doc_id long, semantic_rank int, lexical_rank int"), "q").collect()}
    for q in range(6):
        left, layer = {d: (s, l if l is not None else 2**31) for p, d, s, l in rows if p == q}, 0
        while left:
            layer += 1
            front = [d for d, (s, l) in left.items() if not any(x <= s and y <= l and (x, y) != (s, l) for x, y in left.values())]
            for d in front:
                assert got[q, d] == layer
                del left[d]


def test_cosine_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>")
    for block in (1, 3, 4096):
        ranked = cosine_best(v, v.filter("vec_id = 0"), 3, block=block)
        assert [r["vec_id"] for r in ranked.orderBy("rank").collect()] == [0, 2, 3]
        assert cosine_best(v, v, 9, block=block).count() == 16
    assert cosine_best(v.filter("vec_id > 9"), v, 3).count() == 0


def test_percentiles_interpolate_exactly(spark):
    rng = random.Random(6)
    groups = {"one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 50, "far": [1e300, -1e300, 0.0, 5e-324], "skewed": [rng.expovariate(1) ** 9 for _ in range(700)], "few": [float(rng.randint(0, 3)) for _ in range(101)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("one", None)], "k string, v double")
    parts = [0.0, 0.25, 0.5, 0.95, 1.0]
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", parts).alias("p")).collect()}
    for most, knots in ((100_000, 256), (10, 8)):
        got = exact_percentiles(df, "k", "v", parts, most=most, knots=knots).collect()
        assert len(got) == len(groups) * len(parts)
        assert all(abs(r["percentile"] - want[r["k"]][parts.index(r["part"])]) <= 1e-9 * abs(want[r["k"]][parts.index(r["part"])]) for r in got)


def test_numbers_run_on_over_ranges(spark):
    rows = [(k, i) for k, n in (("hot", 500), ("b", 3), ("c", 1)) for i in random.Random(1).sample(range(10_000), n)]
    got = numbered_by(spark.createDataFrame(rows, "k string, i long").repartition(3), "k", "i", "n").collect()
    for k in "hot", "b", "c":
        assert [r["n"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["i"])] == list(range(sum(x == k for x, _ in rows)))


def test_plans_and_branches_follow_the_limits(spark):
    cases = {
        "study of the aim": ("ok", ["study", "aim"]),
        "of the and": ("no_terms", []),
        "": ("no_terms", []),
        "bell\x07": ("unsupported_characters", ["bell"]),
        "soft\u00adhyphen": ("unsupported_characters", ["soft", "hyphen"]),
        "tab\tand\nline\r": ("ok", ["tab", "line"]),
        "x" * 65: ("resource_limit", ["x" * 65]),
        "é" * 64: ("ok", ["é" * 64]),
        "日" * 43: ("resource_limit", ["日" * 43]),
        "a1 " * 129: ("resource_limit", ["a1"]),
        " ".join(f"t{k}" for k in range(32)): ("ok", [f"t{k}" for k in range(32)]),
        " ".join(f"t{k}" for k in range(33)): ("resource_limit", [f"t{k}" for k in range(33)]),
        "word " + " " * 4096: ("resource_limit", ["word"]),
        "E\u0301te\u0301": ("ok", ["Été"]),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "k long, t string")
    plans = planning.plan(df, "k", "t")
    got = {r["k"]: (r["state"], r["terms"]) for r in plans.collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] == ("no_terms", [])
    found = {r["k"]: r for r in planning.branches(plans, "k").collect()}
    first = found[0]
    assert first["state"] == "ok" and [b["kind"] for b in first["branches"]] == ["base"] + ["morphology"] * 6 + ["intent"]
    assert first["branches"][0]["terms"] == ["study", "aim"] and first["branches"][1]["terms"] == ["study", "aim", "studies"]
    assert first["branches"][-1]["branch_id"] == "intent-000-research-objective-v1" and first["branches"][-1]["terms"][:4] == ["study", "aim", "objective", "purpose"]
    assert found[10]["state"] == "resource_limit"  # 32 terms have too many variants
    same = planning.branches(planning.plan(spark.createDataFrame([(1, "goal goals")], "k long, t string"), "k", "t"), "k").first()["branches"]
    assert same[0]["aliases"] == ["morphology-000-000"] and all(b["branch_id"] != "morphology-000-000" for b in same)


def test_fixture_of_nine_searches_gives_the_published_quality(spark):
    """Ranks of relevant (r) and other documents in both channels; values of the published evaluation."""
    searches = [("r", ""), ("", "r"), ("abr", "cr"), ("r", "s"), ("r", "s"), ("x", "x"), ("r", "x"), ("abcr", "rr"), ("." * 10 + "r", "-" * 34 + "r")]
    relevant = [(0, "r"), (1, "r"), (2, "r"), (3, "r"), (3, "s"), (4, "r"), (4, "s"), (6, "r"), (7, "r"), (8, "r")]
    number = {}
    name = lambda c, i: number.setdefault(c if c.isalpha() else c + str(i), len(number))

    def frame(channel):
        rows = []
        for q, lists in enumerate(searches):
            seen = set()
            for c in lists[channel]:  # a document's best span counts
                d = name(c, f"{q}-{channel}-{len(seen)}")
                if d not in seen:
                    seen.add(d)
                    rows.append((q, d, len(seen)))
        return spark.createDataFrame(rows, "q long, doc_id long, rank int")

    lex, sem = frame(0), frame(1)
    wanted = spark.createDataFrame([(q, name(c, 0)) for q, c in relevant], "q long, doc_id long")
    fused = fuse(lex, sem, ["q", "doc_id"]).select("q", "doc_id", F.col("fused_rank").alias("rank"))
    for ranked, want in ((lex, (0.625, 0.572917, 0.519621)), (sem, (0.5, 0.5625, 0.482153)), (fused, (1.0, 1.0, 1.0))):
        got = ranking_metrics(ranked, wanted, "q", 10, places=12).agg(F.avg("recall"), F.avg("reciprocal_rank"), F.avg("ndcg")).first()
        assert tuple(round(x, 6) for x in got) == want


def test_best_chunk_of_a_hit(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "q long, doc_id long, rank int")
    chunk_rows = spark.createDataFrame([(7, 0, 0, "red"), (7, 0, 1, "red green"), (7, 1, 0, "green red"), (9, 0, 0, "red")], "doc_id long, page_index int, ordinal int, chunk_text string")
    terms = spark.createDataFrame([(1, ["red", "green"])], "q long, terms array<string>")
    assert [tuple(r) for r in best_chunks(hits, chunk_rows, terms, "q").collect()] == [(1, 7, 1, 0, 1, "red green")]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 5, 1)], "q long, doc_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 10), (4, 1)], "q long, doc_id long")
    got = {r["q"]: tuple(r)[1:] for r in ranking_metrics(ranked, relevant, "q", 2).collect()}
    assert got[1] == (0.5, 0.5, round((1 / 1.5849625007) / (1 + 1 / 1.5849625007), 6))
    assert got[2] == (1.0, 1.0, 1.0) and got[3] == (None, None, None) and got[4] == (0.0, 0.0, 0.0)


def slow_pack(rows, max_bytes, max_entries):
    used, n, out = EMPTY_BYTES, 0, []
    for rank, doc, text in sorted(rows):
        body = json.dumps({"doc": doc, "label": f"E{n + 1}", "text": text}, ensure_ascii=False, separators=(",", ":"))
        size = len(body.encode()) + (n > 0)
        if n >= max_entries:
            out.append((doc, rank, None, "entry_limit"))
        elif used + size <= max_bytes:
            used, n = used + size, n + 1
            out.append((doc, rank, f"E{n}", "packed"))
        else:
            out.append((doc, rank, None, "byte_limit"))
    return out


def test_packing_passes_over_what_does_not_fit(spark):
    rng = random.Random(8)
    rows = [(q, r, 100 * q + r, rng.choice(['say "é"', "back\\slash", "tab\tline\n\x01", ""]) * rng.randint(0, 30)) for q in range(5) for r in range(1, 25)]
    got = pack(spark.createDataFrame(rows, "q long, rank int, doc_id long, text string"), "q", max_bytes=700, max_entries=5).collect()
    for q in range(5):
        assert sorted((tuple(r)[1:] for r in got if r["q"] == q), key=lambda r: r[1]) == slow_pack([r[1:] for r in rows if r[0] == q], 700, 5)


def test_states_and_codes(spark):
    assert one(spark, bundle_state(F.col("a"), F.col("b")), a=0, b=0) == "no_candidates"
    assert one(spark, bundle_state(F.col("a"), F.col("b")), a=0, b=2) == "budget_too_small"
    assert one(spark, bundle_state(F.col("a"), F.col("b")), a=1, b=2) == "partial"
    assert one(spark, bundle_state(F.col("a"), F.col("b")), a=2, b=2) == "ready"
    row = spark.createDataFrame([(True, None)], "yes boolean, unknown boolean")
    failed = lambda **c: row.select(resolution_code({k: F.col(v) for k, v in c.items()})).first()[0]
    assert failed(ANCHOR_MISMATCH="yes", RANGE_MISMATCH="yes") == "RANGE_MISMATCH"
    assert failed(ANCHOR_MISMATCH="yes", RANGE_MISMATCH="unknown") == "ANCHOR_MISMATCH" and failed(INVALID_ORDER="unknown") == "ok"
    with pytest.raises(ValueError):
        resolution_code({"NO_SUCH_CODE": F.lit(True)})
    assert json.loads(one(spark, entry_json(F.lit("E1"), F.lit(3), F.lit('a"b\t\x01')))) == {"doc": 3, "label": "E1", "text": 'a"b\t\x01'}


def test_units_go_in_together_or_not_at_all(spark):
    rows = [(1, 1, 11, 1, "a" * 40), (1, 2, 12, 1, "b" * 40), (1, 3, 13, 3, "c" * 400), (1, 4, 14, 3, "d"), (1, 5, 15, 5, "e" * 30)]
    df = spark.createDataFrame(rows, "q long, rank int, doc_id long, unit int, text string")
    got = [(r["doc_id"], r["label"], r["disposition"]) for r in pack(df, "q", max_bytes=400, max_entries=3, unit="unit").orderBy("rank").collect()]
    assert got == [(11, "E1", "packed"), (12, "E2", "packed"), (13, None, "entry_limit"), (14, None, "entry_limit"), (15, "E3", "packed")]
    got = [r["disposition"] for r in pack(df, "q", max_bytes=400, max_entries=9, unit="unit").orderBy("rank").collect()]
    assert got == ["packed", "packed", "byte_limit", "byte_limit", "packed"]


def test_tokens_by_letter_number_mark(spark):
    df = spark.createDataFrame([("Ab-c_1 É́x 日本 ½",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["ab", "c", "1", "é́x", "日本", "½"]


def test_short_passages_are_judged_by_full_comparison(spark):
    """Passages of any number of tokens against containment of the whole passage; one without a token is judged by nothing."""
    from groundline.plans.ranking import relevant

    texts = ["the cat sat on the mat today", "cat", "a cat, sat", "concatenate", "", None, "one two three four five six seven eight nine ten", "xone two three four five six seven eight nineteen", "Cat sat"]
    passages = ["cat", "cat sat", "cat, sat", "cat sat on", "sat on the mat", "one two three four five six seven eight nine", "...", "", None, "e two three four five six seven eight nin", "Cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = sorted(map(tuple, relevant(asked, docs).select("item_id", "doc_id").collect()))
    want = sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p and any(c.isalnum() for c in p) and t is not None and p in t)
    assert got == want and len(want) > 10
    assert relevant(asked.filter("item_id < 3"), docs).count() == sum(i < 3 for i, _ in want) and relevant(asked.limit(0), docs).count() == 0


def test_passages_meet_texts_by_their_rarest_inner_token(spark):
    """Passages of function words, of upper-case letters beyond ASCII and of common tokens; a long text costs no more than its length."""
    import time

    from groundline.plans.ranking import relevant

    # A text of 60,000 different words: its windows compared with each other are two billion pairs.
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = ["so that is what this is for, of all", "In der Größe ÄNDERT sich Öl wenig", "of that this is what for", "x the cat sat on the mat y", "the mat the cat sat on", long, None, "What is the of, in the end"]
    passages = ["that is what this is for", "Größe ÄNDERT sich Öl", "the cat sat on the mat", "w59990 w59991 w59992 w59993", "w1 w3 w5 w7", "is the of, in"]
    docs = spark.createDataFrame([*enumerate(texts), (1, "in der Größe ändert sich öl"), (3, "cat")], "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    relevant(asked, docs.filter("doc_id < 3")).collect()
    began = time.monotonic()
    assert sorted(map(tuple, relevant(asked, docs).collect())) == [(0, 0), (1, 1), (2, 3), (3, 5), (5, 7)]
    assert time.monotonic() - began < 15


def test_contradictions_are_found_in_the_facts(spark):
    from groundline.plans.evidence import contradictions

    rows = [(1, 5, "x", 1), (1, 5, "x", 1), (1, 6, "x", 1), (1, 6, "y", 1), (2, 6, "x", 1), (1, 7, None, 1), (1, 7, "x", 1), (1, 8, None, None), (1, 8, None, None), (3, 9, "x", 1), (3, 9, "x", 2)]
    refs = spark.createDataFrame(rows, "bundle int, ref int, digest string, n int")
    assert sorted((r["bundle"], r["ref"]) for r in contradictions(refs, "bundle", ["ref"], ["digest", "n"]).collect()) == [(1, 6), (1, 7), (3, 9)]


def test_every_rejection_and_abstention_is_reached_by_facts(spark):
    from groundline.operators.evidence import POLICY, verify_proposals

    entries = spark.createDataFrame([(k, *e) for k in range(20) for e in (("E1", 1, 10, "one"), ("E2", 2, 20, "two"), ("E3", 2, 21, "two"), ("E4", 3, 30, "one"), ("E5", 4, 40, "gone"))], "item int, label string, unit int, doc_id long, text string")
    prints = spark.createDataFrame([(k, "f") for k in range(20)], "item int, fingerprint string")
    current = spark.createDataFrame([(10,), (20,), (21,), (30,)], "doc_id long")
    cases = [
        (POLICY, "f", ["E1"], "one", "verified", None),
        (POLICY, "f", ["E1", "E4"], "one", "verified", None),
        (POLICY, "f", ["E1"], "One", "abstained", "VALUE_NOT_EXACT_SOURCE_TEXT"),
        (POLICY, "f", ["E2", "E3"], "two", "abstained", "EVIDENCE_GROUP_VALUE_PROJECTION_UNSUPPORTED"),
        (POLICY, "f", ["E5"], "gone", "rejected", "SOURCE_NOT_CURRENT"),
        (POLICY, "f", ["E2"], "two", "rejected", "EVIDENCE_GROUP_INCOMPLETE"),
        (POLICY, "f", ["E1", "E3"], "one", "rejected", "EVIDENCE_GROUP_INCOMPLETE"),
        (POLICY, "f", ["E1", "E1"], "one", "rejected", "EVIDENCE_REFERENCE_INVALID"),
        (POLICY, "f", ["E1", "E9"], "one", "rejected", "EVIDENCE_REFERENCE_INVALID"),
        (POLICY, "g", ["E1"], "one", "rejected", "EVIDENCE_REFERENCE_INVALID"),
        (POLICY, None, ["E1"], "one", "rejected", "EVIDENCE_REFERENCE_INVALID"),
        (POLICY, "f", ["E1"], "x" * 2001, "rejected", "RESOURCE_LIMIT"),
        ("p", "f", ["E1"], "one", "rejected", "POLICY_MISMATCH"),
        (None, "f", ["E1"], "one", "rejected", "INVALID_REQUEST"),
        (POLICY, "f", [], "one", "rejected", "INVALID_REQUEST"),
        (POLICY, "f", None, "one", "rejected", "INVALID_REQUEST"),
        (POLICY, "f", ["E1"], " ", "rejected", "INVALID_REQUEST"),
        (POLICY, "f", ["E1"], None, "rejected", "INVALID_REQUEST"),
    ]
    proposals = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "item int, policy string, fingerprint string, labels array<string>, value string")
    got = {r["item"]: (r["outcome"], r["code"]) for r in verify_proposals(proposals, entries, prints, current, "item").collect()}
    assert got == {k: c[4:] for k, c in enumerate(cases)}


def test_running_sums(spark):
    from groundline.operators.ingest import offsets, running_sums

    lists = [[], [5], list(range(1, 100)), [1] * 3000, None]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for depth in (0, 1, 2):
        got = [r[0] for r in df.select(running_sums(F.col("x"), depth)).collect()]
        assert got == [None if x is None else [sum(x[:i]) for i in range(len(x))] for x in lists], depth
    words = ["größe", "a", "the"] * 40
    assert spark.createDataFrame([(words,)], "w array<string>").select(offsets(F.col("w"))).first()[0] == [len(" ".join(words[:i])) + (i > 0) for i in range(len(words))]
