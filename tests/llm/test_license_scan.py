import math
import re
import textwrap

from groundline.llm.license_scan import PHRASES, TEMPLATES, frequency_order, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(text, threshold=0.8):
    lower = (text or "").translate(LOWER)
    words = WORD.findall(lower)
    at, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    found = []
    for label, template in TEMPLATES:
        t = WORD.findall(template.translate(LOWER))
        length = math.ceil(len(t) / threshold - 1e-9)
        t = set(t)
        best = max((len(t & set(words[i : i + length])) for i in range(max(1, len(words) - length + 1))), default=0)
        if best >= math.ceil(threshold * len(t) - 1e-9):
            found.append((label, best / len(t)))
    score = 1.0 if base else round(max((c for _, c in found), default=0.0), 6)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), score


CASES = [
    "Licensed under the Apache License, Version 2.0 by someone",
    "apache licensed version 2.0 under",
    "All rights reserved. KELVIN K and İ: MIT LICENSE, mit-license MITLICENSE mit\nlicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation",
    "General Public License general public\nlicense version 3 of this work is licensed under the GNU",
    "licensed under cc by nc\n4 0",
    "Licensed CC BY-NC 4.0 x",
    "rights all all reserved",
    "é" * 50 + " MIT License " + "word " * 3000 + "mit license",
    "all of the\nrights of mine are\nreserved",
    "All rights\n * reserved.",
]


def wrapped(text, width=72, lead=" * "):
    return "\n".join(lead + line for line in textwrap.wrap(text, width))


def test_wrapped_texts_are_found(spark):
    """Published texts wrapped in comments, whole and with a few words changed, far into other text."""
    noise = "some other words of a program " * 40
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        words[len(words) // 2 : len(words) // 2 + len(words) // 12] = ["other"] * (len(words) // 12)
        rows += [(2 * k, noise + "\n" + wrapped(text) + "\n" + noise, label), (2 * k + 1, wrapped(" ".join(words), 40, "# "), label)]
    got = {r["doc_id"]: tuple(r)[1:] for r in scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: slow(t) for i, t, _ in rows}
    assert all(label in got[i][5].split(",") for i, _, label in rows)
    mit = next(t for label, t in reversed(TEMPLATES) if label == "mit")
    spread = " ".join(f"{w} a b c d e" for w in mit.split())
    assert scan_licenses(spark.createDataFrame([(1, spread)], "doc_id long, text string")).first()["labels"] == ""


def test_matches_brute_force(spark, odd):
    texts = CASES + [r["text"] for r in odd.collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in scan_licenses(df).collect()}
    assert got == {k: slow(t) for k, t in enumerate(texts)}


def test_odd_rows_and_empty_table(odd, empty):
    assert scan_licenses(odd).count() == odd.count()
    assert scan_licenses(empty).count() == 0
    assert len(frequency_order(empty)) == len(frequency_order(odd))
