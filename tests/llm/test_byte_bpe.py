import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiforge.llm import byte_bpe as B

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ours():
    return B.codec(*B.public_ranks())


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    ranks, pattern = B.public_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(ranks), special_tokens={})


TEXTS = ["", " ", "a", "don't we'll 1234567 ...", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n\n \t\r\n x\x1c\x1d\x85\xa0 　y", "é" * 700, "\U0001f600\U0001f468‍\U0001f469 क्ष 漢字かな" * 50, "Ab1_" * 999, "0" * 999, "-=" * 2000, "\x00\x01\x7f", "ſ's'ſ İ"]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=200))
def test_random_texts(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=60))
def test_random_bytes_in_one_piece(ours, theirs, data):
    want = tuple(theirs._encode_single_piece(data)) if data else ()
    got = ours.ranks.get(data)
    assert ((got,) if got is not None else ours.transducer.encode(data)) == want


def test_states_are_built_again_when_full():
    small = B.Transducer(B.read_ranks(B.public_ranks()[0]), max_states=50)
    big = B.codec(*B.public_ranks()).transducer
    for word in (b"interoperability", b"transduceraaaa", "naïveté".encode(), b"zzzzzzzzqqq") * 3:
        assert small.encode(word) == big.encode(word)


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_streaming_decode(data, cuts):
    machine, cuts = B.Utf8Machine(), sorted({0, len(data), *(c for c in cuts if c < len(data))})
    out = "".join(machine.feed(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) + machine.end()
    assert out == data.decode("utf-8", "replace")


def test_transitions_emit_and_what_is_left_is_bounded(ours):
    transducer, longest = ours.transducer, max(map(len, ours.ranks))
    for data in (b"ab" * 4000, b"a" * 9000, "é漢字".encode() * 900, bytes(range(256)) * 20):
        state, emitted = 0, 0
        for byte in data:
            to = transducer.states[state].get(byte)
            state, tokens = to if to is not None else transducer.step(state, byte)
            emitted += len(tokens)
            assert sum(len(ours.bytes_of[t]) for t in transducer.rest[state]) <= 2 * longest
        assert emitted > 0


def test_rows(spark):
    texts = [(1, None), (1, None), (2, ""), (None, "x"), (3, "word " * 40_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as names", "'own' as ids", "'own' as decoded", "0 as n_tokens")
    assert B.digests(df, *B.public_ranks()).columns == ["doc_id", "text", "key", "names", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = B.decode(B.encode(df, *B.public_ranks()), *B.public_ranks())
    assert sorted((r.doc_id or 0, r.decoded) for r in out.collect()) == sorted((i or 0, t or "") for i, t in texts)
    assert B.digests(df.limit(0), *B.public_ranks()).collect() == []


def test_whole_table(spark, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in B.op7_byte_bpe(spark, DATA).collect():
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_states_and_pieces_are_bounded_within_a_text(ours, theirs):
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 123, 20_000, np.uint8).tobytes()
    small = B.Transducer(B.read_ranks(B.public_ranks()[0]), max_states=500)
    assert small.encode(piece) == ours.transducer.encode(piece)
    assert len(small.states) <= 502
    ranks, pattern = B.public_ranks()
    c = B.Codec(B.read_ranks(ranks), pattern, max_pieces=20)
    for words in rng.integers(0, 60, (30, 100)).tolist():
        text = " ".join(f"w{i}x" for i in words)
        assert c.encode(text) == theirs.encode_ordinary(text)
        assert len(c.pieces) <= 20 and len(c.older) <= 20


def test_hot_states_outlive_the_rest():
    t = B.Transducer(B.read_ranks(B.public_ranks()[0]), max_states=300)
    rng = np.random.default_rng(5)
    words = [b"the" + rng.integers(97, 123, 9, np.uint8).tobytes() for _ in range(200)]
    for w in words:
        t.encode(w)
    state = 0
    for byte in b"the":
        assert byte in t.states[state]
        state = t.states[state][byte][0]
