import itertools
import re

import duckdb
import pytest

from groundline.llm import oracle
from groundline.llm.filter_audit import audit_filters

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def slow(rows, labels):
    """Every order applied to every document, one filter after the other."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                stay = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), k + 1, len(stay), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = stay
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_equals_every_order_applied_in_turn(spark, odd, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    result = audit_filters(odd, labels)
    assert result.columns == COLUMNS
    assert sorted(map(tuple, result.collect())) == slow(rows, [tuple(r) for r in labels.collect()])


def test_shapley_values_sum_to_what_all_filters_remove(spark, odd, labels):
    rows = audit_filters(odd, labels).filter("filter_order = 'ABCDE'").collect()
    for part in {r["part"] for r in rows}:
        mine = [r for r in rows if r["part"] == part]
        assert sum(r["shapley"] for r in mine) == 120 * sum(r["removed"] for r in mine)


def test_copies_ids_and_labels(spark):
    text = "word " * 30
    docs = spark.createDataFrame([(5, text, None), (5, text, None), (4, text, None), (3, text + "x", ""), (None, text, ""), (None, None, "en"), (9, "", "en"), (8, None, "en"), (-(2**62), "", "de"), (2**62, "A#" * 400, "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (4, None, None), (None, 1, 1), (2**62, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit_filters(docs, labels).collect())) == slow([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_empty_tables(spark, empty, odd, labels):
    assert audit_filters(empty, labels).collect() == []
    rows = audit_filters(odd, labels.limit(0)).collect()
    assert rows and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


@pytest.mark.parametrize("name", ["odd", "small"])
def test_sql_states_the_same(spark, odd, labels, sf_dir, name, tmp_path):
    from groundline.llm.queries import op13_filter_audit

    if name == "odd":
        odd.write.parquet(f"{tmp_path}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        sf_dir = str(tmp_path)
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if name == 'odd' else path}'")
    want = duck.sql(oracle.FILTER_AUDIT)
    got = op13_filter_audit(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
