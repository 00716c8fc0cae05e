import random

import pytest
from llm_slow import components, slow_fingerprint

from groundline.llm.common import connected_components
from groundline.llm.simhash import fingerprint, hex_fingerprint, links, near_duplicates


def test_fingerprints_and_components_match_brute_force(odd):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").collect()), key=lambda r: (r[0], r[1] or ""))
    fps = [slow_fingerprint(t) for _, t in rows]
    assert [fingerprint(t) for _, t in rows] == fps
    roots = components(fps)
    want = sorted((rows[k][0], f"{fps[k]:016x}", rows[roots[k]][0]) for k in range(len(rows)))
    found = near_duplicates(odd.filter("doc_id IS NOT NULL")).select("doc_id", hex_fingerprint("fp"), "component_id")
    assert sorted(map(tuple, found.collect())) == want
    every = near_duplicates(odd).collect()
    assert len(every) == odd.count()  # null ids stay
    kept = [r["component_id"] for r in every if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["component_id"] for r in every})


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(200):
        x = rng.choice(sorted(fps))
        fps.add(x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & (1 << 64) - 1)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    label = {r["node"]: r["label"] for r in connected_components(links(df)).collect()}
    roots = components(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = label.get(signed(fps[i]), i) == label.get(signed(fps[j]), ~j)
            assert same == (roots[i] == roots[j])


def test_crowded_segments_lose_no_link(spark):
    """Many different fingerprints agree in one half: all links are found, whether keys count as crowded or not."""
    rng = random.Random(11)
    fps = {(0xABCD1234 << 32) | rng.getrandbits(32) for _ in range(60)} | {(rng.getrandbits(32) << 32) | 77 for _ in range(60)}
    for _ in range(150):
        x = rng.choice(sorted(fps))
        fps.add((x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 2)))) & (1 << 64) - 1)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = components(fps)
    for most in (2, 30, 10_000):
        label = {r["node"]: r["label"] for r in connected_components(links(df, most=most)).collect()}
        mine = [label.get(signed(x), signed(x)) for x in fps]
        assert all((mine[i] == mine[j]) == (roots[i] == roots[j]) for i in range(len(fps)) for j in range(i))


def test_far_candidates_are_rejected(spark):
    """Equal in one segment, far in the other: they meet in a table but are no link."""
    df = spark.createDataFrame([(5,), (5 | 0xFFFF << 32,), (7,), (0,)], "fp long")
    assert sorted(tuple(sorted(r)) for r in links(df).distinct().collect()) in ([(0, 5), (5, 7)], [(0, 5), (0, 5), (5, 7), (5, 7)])


def test_components_of_a_long_path_and_a_hub(spark):
    names = random.Random(5).sample(range(10_000, 20_000), 2000)  # a path whose ids go up and down
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(7, 7)] + list(zip(names, names[1:]))
    label = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[i] == 0 for i in range(301)) and all(label[1000 + i] == 1000 for i in range(500))
    assert {label[x] for x in names} == {min(names)} and len(label) == 301 + 500 + 2000
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_empty_table_and_bad_distance(empty):
    assert near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(empty, max_distance=3)
