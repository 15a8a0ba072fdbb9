import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiforge.llm import token_files as T
from lexiforge.llm.common import shared_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.public_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ours(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, counts = T.encoder(T.public_tokenizer()).encode(data, offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


PARTS = [*" \n\t\x0b'stΣσİ́각　\x85\x1cÀÿ×÷ßÉé12.,A<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'S", "I'LL"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join), min_size=1, max_size=5))
def test_word_by_word_equals_whole_texts(theirs, texts):
    assert ours(texts) == [theirs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(0, 310), st.integers(0, 310))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids, np.int32)
    g = T.compress(ids, least=2)
    assert g.ids().tolist() == ids.tolist()
    assert g.ids(a, b).tolist() == ids[a:b].tolist()
    assert all(len(g.expand(np.array([g.base + i]))) == n for i, n in enumerate(g.lengths))


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(100), 500)
    g = T.compress(ids)
    assert len(g.sequence) < len(ids) / 50 and g.ids().tolist() == ids.tolist()


def brute(docs, encode):
    out, start = [], 0
    for d, t in docs:
        ids = [*encode(t or ""), 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_edge_cases(spark, theirs):
    docs = [(None, "x"), (-3, ""), (1, None), (2, "<|endoftext|> It's 42"), (2, "<|endoftext|> It's 42"), (5, "word " * 20_000), (9, "é")]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").selectExpr("*", "1 as row", "2 as part").repartition(3)
    path = shared_path(spark, "test")
    T.write(df, path, T.public_tokenizer())
    assert sorted((tuple(r) for r in T.read(spark, path).collect()), key=str) == brute(docs, theirs)
    path = shared_path(spark, "test")
    T.write(df.limit(0), path, T.public_tokenizer())
    assert T.read(spark, path).collect() == []


def test_forgetting_and_equal_hashes(monkeypatch, theirs):
    texts = ["a b c d e f g h", "a b c", "x y z a", "one two three", "six seven"]
    want = [theirs(t) for t in texts]
    for limit, width in ((5, 64), (1000, 3)):
        monkeypatch.setattr(T.W.Words, "hashes", lambda w, *a, f=T.W.Words.hashes, width=width: f(w, *a) if a else f(w) >> np.uint64(64 - width))
        monkeypatch.setitem(T._ENCODERS, T.public_tokenizer(), T.PieceEncoder(T.public_tokenizer(), limit))
        assert [ours([t])[0] for t in texts] == want
        assert ours(texts) == want
        monkeypatch.undo()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1000, 600)
    ids = np.concatenate([x for _ in range(40) for x in (passage, rng.integers(0, 1000, 50))] + [np.full(5000, 7)])
    g = T.compress(ids)
    assert g.ids().tolist() == ids.tolist() and g.lengths.max() >= 600
    pairs, count = np.unique(np.stack((g.sequence[:-1], g.sequence[1:]), axis=1), axis=0, return_counts=True)
    # a run of one symbol holds the same pair at places that overlap
    assert count[pairs[:, 0] != pairs[:, 1]].max() < T.LEAST


def test_starts_of_many_parts(spark):
    rows = [(p, s, (p * 7 + s * 3) % 11) for p in range(0, 3000, 3) for s in range(p % 4)]
    want, total = {}, 0
    for p, s, n in rows:
        want[p, s] = total
        total += n
    got = T._starts(spark.createDataFrame(rows, "part int, shard int, n_ids long"))
    assert {(r.part, r.shard): r["first"] for r in got.collect()} == want


def test_whole_table(spark, theirs):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert sorted((tuple(r) for r in T.op8_token_files(spark, DATA).collect()), key=str) == brute(docs, theirs)


def test_plain_pieces_are_asked_for_together(monkeypatch, theirs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(f"{a}{b}{c}q {a}9{c}!?{b}" for a in letters for b in letters[:7] for c in letters[:7]), "it's é ÀB <|endoftext|> ½ </w> a</w>b", "", "..."]
    encoder, asked = T.PieceEncoder(T.public_tokenizer()), []
    monkeypatch.setitem(T._ENCODERS, T.public_tokenizer(), encoder)

    class Counting:
        def encode_batch_fast(self, x, tokenizer=encoder.tokenizer, **how):
            asked.extend(x)
            return tokenizer.encode_batch_fast(x, **how)

    encoder.tokenizer = Counting()
    want = [theirs(t) for t in texts]
    assert ours(texts) == want and len(asked) < 30
    plain = T.PieceEncoder(T.public_tokenizer())
    plain.last[:] = False  # as if no token ended a word
    monkeypatch.setitem(T._ENCODERS, T.public_tokenizer(), plain)
    assert ours(texts) == want


def test_letters_beyond_ascii_are_asked_for_together(monkeypatch, theirs):
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    texts = [" ".join(f"{a}{b}{c}" for a in letters for b in letters[::5] for c in "eéÈ"), " ".join(f"é{a}{b}{a}9ÿ" for a in marks for b in marks), "Àpropos l'été ×÷ Ñandú ½"]
    encoder, asked = T.PieceEncoder(T.public_tokenizer()), []
    monkeypatch.setitem(T._ENCODERS, T.public_tokenizer(), encoder)

    class Counting:
        def encode_batch_fast(self, x, tokenizer=encoder.tokenizer, **how):
            asked.extend(x)
            return tokenizer.encode_batch_fast(x, **how)

    encoder.tokenizer = Counting()
    assert ours(texts) == [theirs(t) for t in texts]
    assert all(any(c in "'<×÷½" for c in t) for t in asked)  # only words left whole


def test_pairs_of_one_frequency_take_few_rounds(monkeypatch):
    """Ranks that rise along the sequence would let each round replace one pair of a passage."""
    rounds, frequent = [], T._frequent
    monkeypatch.setattr(T, "_frequent", lambda *a: rounds.append(1) or frequent(*a))
    ids = np.tile(np.arange(2000), 8)
    g = T.compress(ids)
    assert len(rounds) < 40 and g.ids().tolist() == ids.tolist() and g.lengths.max() >= 1000
