import re

import corpus_pipeline as C
import pytest
from lexiforge.llm import byte_bpe

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in C.STAGES:
        docs = C.materialise(stage(spark, docs, DATA), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    names = steps["documents"].columns
    assert all(steps[n].columns == names for n in ("quality", "near_duplicates", "decontaminate", "personal_data"))
    assert steps["encode"].columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_near_duplicates_against_brute_force(steps):
    docs = sorted((r.doc_id, r.text) for r in steps["quality"].collect())
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    kept = {docs[i][0] for i in range(len(docs)) if find(i) == i}
    assert set(rows(steps["near_duplicates"])) == kept and len(kept) < len(docs)


def test_clean_documents_stay_and_texts_change_only_by_redaction(steps):
    labels = {r.doc_id: r.quality for r in steps["documents"].sparkSession.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = rows(steps["documents"]), rows(steps["quality"])
    assert all(i in after for i, q in labels.items() if q == 1 and i in before and len(before[i].text.split()) >= 50)
    clean, redacted = rows(steps["decontaminate"]), rows(steps["personal_data"])
    assert set(clean) == set(redacted)
    for i, r in redacted.items():
        assert r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]", r.text)
        if "<" not in r.text:
            assert r.text == clean[i].text
    assert any("<EMAIL>" in r.text for r in redacted.values()) or not any("@" in r.text for r in clean.values())


def test_ids_decode_to_the_texts(steps):
    codec = byte_bpe.codec(*byte_bpe.public_ranks())
    texts = rows(steps["personal_data"])
    for i, r in rows(steps["encode"]).items():
        assert codec.decode(r.ids) == texts[i].text and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, steps):
    assert {i: r.ids for i, r in rows(C.run(spark, DATA)).items()} == {i: r.ids for i, r in rows(steps["encode"]).items()}


def test_edge_rows_pass_through(spark):
    words = " ".join(f"w{i}" for i in range(80))
    docs = [(1, words, "en", "s", 3), (1, words, "en", "s", 3), (None, words, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        df = C.materialise(stage(spark, df, DATA), "test")
    assert [r.doc_id for r in df.collect()] == [1]
