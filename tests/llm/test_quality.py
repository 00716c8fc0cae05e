import math
import re
from collections import Counter

import xxhash

from groundline.llm.quality import quality_scores

BUCKETS = 512


def h64(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    one = [h64(w.encode(), 42) for w in words]
    # Spark's hash of two longs: the second with the first one's hash as its seed, on 8 little-endian bytes.
    pair = lambda a, b: h64(b.to_bytes(8, "little"), h64(a.to_bytes(8, "little"), 42))
    return words, [signed(x) % BUCKETS for x in [*one, *(pair(a, b) for a, b in zip(one, one[1:]))]]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)}
    n, failed = len(words), len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_scores_and_verdicts_match_brute_force(odd, labels):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    good = {6, 7, 101}
    raw, target = Counter(), Counter()
    for i, text in rows:
        f = features(text)[1]
        raw.update(f)
        if i in good:
            target.update(f)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (n_target + BUCKETS)) - math.log((raw[b] + 1) / (n_raw + BUCKETS))
    want = []
    for i, text in rows:
        f = features(text)[1]
        b = base(text)
        score = round(sum(map(ratio, f)) / max(1, len(f)), 6)
        want.append((i, *b, score, not b[-1] and score >= -0.2))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["score"], r["kept"]) for r in quality_scores(odd, labels, buckets=BUCKETS, threshold=-0.2).collect()]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == w[:7]
        assert abs(g[7] - w[7]) < 2e-6
        assert g[8] == w[8] or abs(w[7] + 0.2) < 1e-5


def test_duplicate_lines_and_symbols(spark, labels):
    docs = spark.createDataFrame([(1, "a b\na b\n\n\n #x|<>\n a b\na b")], "doc_id long, text string")
    r = quality_scores(docs, labels).first()
    assert (r["n_dup_lines"], r["n_symbols"], r["n_words"]) == (2, 4, 9)


def test_empty_tables_and_no_target(odd, empty, labels):
    assert quality_scores(empty, labels).count() == 0
    scored = quality_scores(odd, labels.limit(0)).collect()
    assert len(scored) == odd.count() and all(r["score"] == 0 for r in scored)


def test_carried_columns_keep_clashing_names(odd, labels):
    carried = quality_scores(odd, labels, carry=odd.columns).select("carried.*")
    assert carried.columns == odd.columns and carried.count() == odd.count()


def test_repeated_words_beyond_the_packed_positions(spark):
    from pyspark.sql import functions as F

    from groundline.llm.quality import repeated_words

    tri = [*range(50), 7, 8, 9, *range(100, 140), 3]
    found = spark.createDataFrame([(tri,), (tri[:16],), (tri[:8] * 2,), (tri[:8] * 2 + [0],)], "tri array<long>")
    got = [tuple(r) for r in found.select(repeated_words(F.col("tri"), 4), repeated_words(F.col("tri"))).collect()]
    assert got == [(16, 16), (0, 0), (18, 18), (19, 19)]
