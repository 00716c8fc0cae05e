import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from groundline.llm.chunk_encode import ChunkEncoder, cut_points, encode_documents, load_byte_bpe, sure_positions
from groundline.llm.token_count import PieceCounter, count_tokens

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t\r.,'aZé9_▁日<|>\u0085\u00a0\u2028\u3000\u001c\U0001f600\u0301"
texts = st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=60), st.sampled_from(["<|endoftext|>", " the", " don't", "<s>", "</s>", "  ", " a.b,c", "<unk>", "\x00"])), max_size=12).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe():
    return load_byte_bpe(BYTES)


@settings(max_examples=80, deadline=None)
@given(batch=st.lists(texts, min_size=1, max_size=4))
def test_counts_equal_the_library(pieces, batch):
    counter = PieceCounter(pieces)
    assert counter.splits
    assert counter.count(batch) == [len(pieces.encode(t)) for t in batch]


@settings(max_examples=80, deadline=None)
@given(batch=st.lists(texts, min_size=1, max_size=4), mean=st.sampled_from([4, 16, 512]))
def test_chunks_encode_and_decode_as_the_library(bpe, batch, mean):
    encoder = ChunkEncoder(bpe, mean_chunk=mean)
    for _ in range(2):  # from memory, too
        for text, (ids, back) in zip(batch, encoder.encode(batch)):
            want = bpe.encode(text, add_special_tokens=False).ids
            assert ids == ",".join(map(str, want)).encode()
            assert back.decode("utf-8", "replace") == bpe.decode(want, skip_special_tokens=False)


def test_chunks_are_shared_and_memory_is_bounded(bpe):
    rng = random.Random(1)
    passage = " ".join(rng.choice(["alpha", "beta", "größe", "delta,", "epsilon."]) + str(rng.randint(0, 99)) for _ in range(800))
    encoder = ChunkEncoder(bpe, mean_chunk=64)
    encoder.encode(["Before. " + passage])
    known = len(encoder.chunks)
    encoder.encode(["Quite another beginning " + passage + " and end"])
    assert known > 20 and len(encoder.chunks) - known < 4  # the passage falls into the same chunks
    small = ChunkEncoder(bpe, mean_chunk=64, word_bytes=1000, chunk_bytes=1000)
    assert [small.encode([passage]) for _ in range(3)] == [encoder.encode([passage])] * 3


def scripts(rng):
    """Texts without spaces or with few: ideographs, kana, Hangul, base64, digits, one letter, punctuation between."""
    ideographs = [chr(c) for c in range(0x4E00, 0x4E60)] + ["的", "是", "我", "不", "国"]
    pools = [ideographs, ideographs * 20 + ["，", "。", "、"] * 40, [chr(c) for c in range(0x3041, 0x3097)] + ["。"], [chr(c) for c in range(0xAC00, 0xAC80)], list("abcdefgXYZ0123456789+/="), list("0123456789"), ["a"], list("abcß") + ["é"], ["，", "。", "国", "'", "s", " "], list("{}();=.x1 ")]
    return ["".join(rng.choices(pool, k=rng.randint(1, 4000))) for pool in pools for _ in range(3)]


def test_texts_without_spaces(pieces, bpe):
    rng = random.Random(9)
    batch = scripts(rng)
    batch += [a + b for a, b in zip(batch, reversed(batch))]
    counter = PieceCounter(pieces)
    assert counter.splits and counter.cuts
    assert counter.count(batch) == [len(pieces.encode(t)) for t in batch]
    assert all(len(w) <= 64 for w in counter.lengths)  # no whole text is remembered
    assert max(map(len, counter._parts("".join(chr(0x4E00 + k % 999) for k in range(20_000))))) < 1000
    encoder = ChunkEncoder(bpe, mean_chunk=64, long_run=100)
    for _ in range(2):
        for text, (ids, _) in zip(batch, encoder.encode(batch)):
            assert ids == ",".join(map(str, bpe.encode(text, add_special_tokens=False).ids)).encode()


def test_runs_of_letters_share_their_chunks(bpe):
    rng = random.Random(4)
    start = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(3000))
    encoder = ChunkEncoder(bpe, mean_chunk=64)
    encoder.encode([start])
    known = len(encoder.runs)
    encoder.encode([start + "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(80))])
    assert known > 20 and len(encoder.runs) - known < 10


def test_counter_forgets(pieces):
    counter = PieceCounter(pieces, memory_bytes=2000)
    for k in range(5):
        assert counter.count([f"some words {k} and {k * 7} more " * 20]) == [len(pieces.encode(f"some words {k} and {k * 7} more " * 20))]
        assert counter.used < 6000


def test_cut_points_and_sure_positions_respect_characters():
    data = ("é日\U0001f600 x" * 300).encode()
    ends = cut_points(data, 8)
    assert ends[-1] == len(data) and all(data[e] & 0xC0 != 0x80 for e in ends[:-1])
    assert sure_positions(b"ab cd, ef\ngh  ij") == [2, 5, 6, 9]


def test_documents(odd, empty, pieces, bpe):
    rows = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(odd, PIECES, limit=300, batch_bytes=100).collect())
    assert got == sorted((i, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 300) for i, t in rows)
    want = []
    for i, t in rows:
        ids = bpe.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in encode_documents(odd, BYTES, batch_bytes=100, with_ids=True).collect()]
    assert sorted(got) == sorted(want)
    assert count_tokens(empty, PIECES).count() == 0 and encode_documents(empty, BYTES).count() == 0


def test_encoders_live_as_long_as_their_worker(spark):
    """Tasks of one Python worker share an encoder and what it has learned."""
    import os

    import pyarrow as pa

    from groundline.llm.chunk_encode import _encoder

    def look(it):
        for batch in it:
            encoder = _encoder(BYTES, 512)
            before = len(encoder.words)
            encoder.encode([f"one two three {k}" for k in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([id(encoder)]), pa.array([before])], names=["pid", "encoder", "before"])

    seen = [r for k in range(3) for r in spark.range(k * 100, k * 100 + 40, 1, 8).mapInArrow(look, "pid long, encoder long, before long").collect()]
    pids = {r["pid"] for r in seen}
    assert len(seen) == 24 and len({(r["pid"], r["encoder"]) for r in seen}) == len(pids) < len(seen)
    assert sum(r["before"] == 0 for r in seen) <= len(pids)
