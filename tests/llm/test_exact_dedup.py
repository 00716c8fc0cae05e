import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from groundline.llm.exact_dedup import CuckooIndex, digest_groups, exact_duplicates


def test_groups_match_brute_force(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_duplicates(odd).collect()
    assert len(got) == len(rows)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == keep[r["text_sha256"]]
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_empty_table(empty):
    assert exact_duplicates(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=400))
def test_index_follows_a_dictionary(steps):
    index, live = CuckooIndex(buckets=1), {}
    for number, delete in steps:
        digest = hashlib.sha256(str(number).encode()).digest()
        if delete:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        elif digest not in live:
            index.insert(digest, number)
            live[digest] = number
        assert index.get(digest) == live.get(digest) and len(index) == len(live)
    assert dict(index.entries()) == live


def test_equal_tags_are_told_apart_and_overflow_grows():
    index = CuckooIndex(buckets=2)
    digests = [b"\x01\x02" + bytes(6) + bytes(8) + k.to_bytes(16, "big") for k in range(8)]
    for k, d in enumerate(digests):
        index.insert(d, k)
    assert [index.get(d) for d in digests] == list(range(8))
    assert index.get(b"\x01\x02" + bytes(14) + (99).to_bytes(16, "big")) is None


def test_small_indexes_and_many_shards_give_the_same_groups(spark):
    rows = [(hashlib.sha256(str(k % 70).encode()).digest(), k, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "digest binary, doc_id long, row long")
    want = {d: (max(i for e, i, _ in rows if e == d), sum(e == d for e, *_ in rows)) for d in {r[0] for r in rows}}
    for most in (3, 400_000):
        got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in digest_groups(df, most).collect()}
        assert got == want
