import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from groundline.llm.language_id import PpmModel, fit, held_out, identify, language_groups
from groundline.sources.tables import table


def slow_code_length(texts, data, order=3):
    """Bits of ``data`` under a context tree of ``texts``, byte by byte."""
    tree = defaultdict(Counter)
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                tree[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(data)):
        for k in range(min(order, i), -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def model_of(samples, order=3):
    langs = sorted(samples)
    rows = []
    for code, lang in enumerate(langs):
        for w in range(1, order + 2):
            grams = Counter(int.from_bytes(t[i : i + w], "big") for t in samples[lang] for i in range(len(t) - w + 1))
            rows += [(code, w, g, n) for g, n in grams.items()]
    a = np.array(rows, dtype=np.int64)
    return PpmModel(langs, order, a[:, 0], a[:, 1].astype(np.int32), a[:, 2].astype(np.uint64), a[:, 3])


def test_code_lengths_match_brute_force():
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": ["der Hund saß auf der Matte".encode(), b"die Katze"]}
    model = model_of(samples)
    for data in (b"", b"t", b"the", b"the dog sat", "Größe der Katze".encode(), bytes(range(256)), b"the cat sat on the mat " * 400):
        want = [slow_code_length(samples[x], data) for x in ("a", "b")]
        assert np.allclose(model.code_length(data), want, rtol=1e-5, atol=1e-4)
        assert np.allclose(model.code_length(data, block=7), want, rtol=1e-5, atol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(~held_out(F.col("doc_id")))).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_odd_rows(odd, empty):
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in identify(odd, odd).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 13))
    assert all(0 <= s <= 1 for _, s in got.values()) and got[4][0] in ("en", "de", "fr")
    assert identify(odd, odd).count() == odd.count()
    assert {r["lang_pred"] for r in identify(odd, empty).collect()} == {"und"}
    assert identify(empty, odd).count() == 0


def test_training_is_a_bounded_sample(odd):
    model = fit(odd, per_cell=1)
    assert model.langs == ["de", "en", "fr"]


def test_groups_of_languages_give_what_one_model_gives(odd, empty):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["lang_pred"])
    whole, apart = (sorted(identify(odd, odd, max_cells=cells).collect(), key=key) for cells in (4_000_000, 1))
    assert [r["lang_pred"] for r in whole] == [r["lang_pred"] for r in apart]
    assert np.allclose([r["score"] for r in whole], [r["score"] for r in apart], rtol=1e-4, atol=1e-6)
    assert language_groups([("b", 5), ("a", 5), ("c", 90)], 20) == [["a", "b"], ["c"]] and language_groups([], 5) == []


def test_all_of_two_thousand_languages_are_learned(spark):
    """Each language has a word of its own; none is left out for their number."""
    rows = [(k, f"l{k:04d}", f"common {chr(0x4E00 + k)}{chr(0x4E00 + k)}{chr(0x4E00 + k)} words") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    found = identify(docs, docs, max_cells=400_000).join(docs, "doc_id")
    assert found.filter("lang = lang_pred").count() == 2000
