import random

import numpy as np
import public_tokenizers
import pytest
from test_near_copies import brute_force, planted

from groundline.llm import near_copies as module
from groundline.llm.common import connected_components, numbered
from groundline.llm.near_copies import near_components, near_copies, simhash_pairs
from groundline.llm.simhash import fingerprint, wide_candidates


def stored(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(path))
    return numbered(spark.read.parquet(str(path)))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_wide_candidates_are_pairs_near_in_a_segment(spark):
    """Fingerprints in pairs at 1 to 12 bits: those 2 bits apart at most in a segment meet, up to 11 as a whole; no other pair does."""
    rng = random.Random(7)
    want, fps = set(), set()
    for k in range(240):
        x, bits = rng.getrandbits(64), rng.sample(range(64), 1 + k % 12)
        y = x ^ sum(1 << b for b in bits)
        fps |= {x, y}
        if min(sum(b < 32 for b in bits), sum(b >= 32 for b in bits)) <= 2 and len(bits) <= 11:
            want.add(frozenset((signed(x), signed(y))))
        else:
            assert len(bits) > 5
    unique = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    assert {frozenset(r) for r in wide_candidates(unique).collect()} == want
    assert {len(p) for p in want} == {2} and len(want) > 120


def test_candidates_around_one_fingerprint_are_linear(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {signed(base ^ sum(1 << rng.randrange(64) for _ in range(3))) for _ in range(1500)}
    found = wide_candidates(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert len(found) <= 2 * len(fps)
    label = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert set(label) == fps and len(set(label.values())) == 1


@pytest.mark.parametrize("rows", [planted()])
def test_near_copies_are_found_by_fingerprints_alone(spark, tmp_path, monkeypatch, rows):
    """With no entries for the exact join, the stage still drops near copies: SimHash finds them, not the join."""
    docs = stored(spark, tmp_path / "documents", rows)
    monkeypatch.setattr(module, "_entries", lambda *how: lambda it: iter(()))
    gone = {r[0] for r in near_copies(docs).join(docs, "row").select("doc_id").collect()}
    want = set(brute_force(rows))
    assert gone <= want and len(gone) > 0.6 * len(want)


def test_exact_join_follows_for_pairs_that_fingerprints_do_not_join(spark, tmp_path, monkeypatch):
    """A pair beyond the fingerprints' reach is joined; a pair that they join is not verified again."""
    rng = random.Random(3)
    near = [rng.choice([f"w{k}" for k in range(3000)]) for _ in range(300)]
    rows, far = [(0, " ".join(near)), (1, " ".join([*near[:-1], "other"]))], None
    while far is None:  # a similarity of 0.8 or more at twelve bits or more
        base = [rng.choice([f"w{k}" for k in range(3000)]) for _ in range(100)]
        copy = [w if k not in (20, 60) else "other" for k, w in enumerate(base)]
        if (fingerprint(" ".join(base), 5) ^ fingerprint(" ".join(copy), 5)).bit_count() > 11:
            far = base, copy
    rows += [(2 + k, " ".join(t)) for k, t in enumerate(far)]
    assert brute_force(rows) == [1, 3]
    docs = stored(spark, tmp_path / "documents", rows)
    ids = {r["row"]: r["doc_id"] for r in docs.collect()}
    named = lambda pairs: {frozenset(ids[x] for x in r) for r in pairs.collect()}
    assert named(simhash_pairs(docs)) == {frozenset((0, 1))}
    rounds, plain = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *how: rounds.append(named(pairs)) or plain(pairs, *how))
    label = {ids[r["node"]]: r["label"] for r in near_components(docs).collect()}
    assert label[0] == label[1] and label[2] == label[3] and len(label) == 4
    assert rounds == [{frozenset((0, 1))}, {frozenset((2, 3))}, set()]


def test_workers_forget_encoders_before_near_copies():
    """What a worker keeps for BPE encoding is freed when tasks of the near stage come to it."""
    import pyarrow as pa
    import tokenizers

    from groundline.llm.chunk_encode import _encoder
    from groundline.llm.near_copies import _all_shingles, _entries, _prints

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f g", None])], names=["row", "text"])
    order = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for task in (_all_shingles(5), _entries(5, 0.8, order, False), _prints(5)):
        _encoder(public_tokenizers.path("byte_bpe_50k.json"), 512)
        assert vars(tokenizers)["_kept_chunk_encoders"]
        assert sum(b.num_rows for b in task(iter([batch])))
        assert not vars(tokenizers).get("_kept_chunk_encoders")
