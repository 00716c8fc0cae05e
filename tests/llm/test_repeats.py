import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundline.llm.repeats import _merge_intervals, _run_tuples, _scan, remove_repeats, sliding_min


def slow(rows, span):
    """What stays of each text, string by string, in the order of ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(w)
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(data)))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((-1 if i is None else i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, **options):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in remove_repeats(df, **options).collect())


def test_odd_rows_match_brute_force(odd):
    assert found(odd) == slow([(r["doc_id"], r["text"]) for r in odd.collect()], 100)


def test_crafted_repeats_match_brute_force(spark, tmp_path):
    rng = random.Random(9)
    base = "".join(rng.choice("ab c") for _ in range(3000))
    rows = []
    for i in range(150):
        kind, at = rng.random(), rng.randint(0, 2700)
        if kind < 0.2:
            text = "a" * rng.randint(0, 300)
        elif kind < 0.6:
            text = base[at : at + rng.randint(20, 300)] + "".join(rng.choice("defgh ") for _ in range(rng.randint(0, 90))) + base[at + 20 : at + 140]
        else:
            text = "xyé" * rng.randint(1, 60) + base[100 : rng.randint(110, 500)]
        rows.append((i, text))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    assert found(df) == slow(rows, 100)
    assert found(df, span=30, gram=11) == slow(rows, 30)
    # Samples that count as frequent are dealt out otherwise, with the same result.
    assert found(df, span=30, gram=11, one_in=1, times=2) == slow(rows, 30)
    assert found(df, one_in=2, times=3) == slow(rows, 100)


def test_a_short_passage_in_many_surroundings(spark, tmp_path):
    rng = random.Random(3)
    other = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = "This notice of some fifty bytes stands in every text, always."
    rows = [(i, other(rng.randint(0, 200)) + passage + other(rng.randint(0, 200))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    assert found(spark.read.parquet(path), one_in=1, times=20) == slow(rows, 100)


def test_empty_table_and_bad_gram(empty):
    assert found(empty) == []
    with pytest.raises(ValueError):
        remove_repeats(empty, span=40, gram=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_min(values, width):
    if width <= len(values):
        assert sliding_min(np.array(values), width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 9)), max_size=40))
def test_merged_intervals_cover_the_same(parts):
    row, begin, end = (np.array(x, dtype=np.int64) for x in ([p[0] for p in parts], [p[1] for p in parts], [p[1] + p[2] for p in parts]))
    r, b, e = _merge_intervals(row, begin, end)
    cover = lambda r, b, e: {(x, k) for x, p, q in zip(r.tolist(), b.tolist(), e.tolist()) for k in range(p, q)}
    assert cover(r, b, e) == cover(row, begin, end)
    assert sum((e - b).tolist()) == len(cover(r, b, e)) and all(p < n for x, y, p, n in zip(r, r[1:], e, b[1:]) if x == y)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(0, 9), st.sampled_from([-5, 1, 3])), max_size=40), st.integers(1, 7))
def test_scan_does_not_depend_on_batches(tuples, width):
    names = ["k", "b", "doc", "row", "start", "size"]
    rows = sorted((k, b, doc, doc, i, size) for i, (k, b, doc, size) in enumerate(tuples))
    blocks = {}
    for k, b, *_, size in rows:
        if size > 0:
            blocks.setdefault(k, set()).add(b)
    want, seen = [], set()
    for k, b, doc, row, start, size in rows:
        if size < 0:
            want.append((doc, row, start, size))
        elif (k, b) in seen:
            want.append((doc, row, start, -(size + 9)))
        elif len(blocks[k]) > 1:
            want.append((doc, row, start, size))
        if size > 0:
            seen.add((k, b))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + width]], pa.int64()) for c in range(6)], names=names) for i in range(0, len(rows), width)]
    got = [tuple(r.values()) for out in _scan(10)(iter(batches)) for r in out.to_pylist()]
    assert sorted(got) == sorted(want)


def test_sections_of_a_long_text_cover_every_start_once():
    rng = random.Random(2)
    data = [bytes(rng.choices(b"abc ", k=n)) for n in (5000, 40, 0, 700)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([10, 20, 30, 40]), pa.array(data, pa.binary())], names=["doc", "row", "data"])
    for longest in (150, 601, 1 << 20):
        starts = []
        for out in _run_tuples(100, 40, 256, 10_000, longest)(iter([batch])):
            for r in out.to_pylist():
                starts += [(r["row"], p) for p in range(r["start"], r["start"] + (r["size"] if r["size"] > 0 else -r["size"] - 99))]
        assert sorted(set(starts)) == [(10, p) for p in range(4901)] + [(40, p) for p in range(601)]
