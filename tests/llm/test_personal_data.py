import hashlib
import random
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiforge.llm import personal_data as P
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
sys.set_int_max_str_digits(0)
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", P._joined(P.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    return [r.s for r in sorted(df.collect())]


CARD = "4111 1111 1111 1111"
EDGE = [
    None, "", "a@b.co", "a@b.co_x@y.com", "a@b.co@c.de", "x" * 50_000 + "@", "é.a+b%c@d-e.f.g. next", "a@b..c", "@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "001.002.255.256", "0255.1.1.1", "9" * 30_000 + ".1.1.1",
    CARD, CARD + "-" + CARD, "5  " + CARD, CARD + " 9", "4111-1111-1111-1111", "0" * 14, "0" * 20, "1" * 40_000, "+1 (017) 555-7713", "++49 (0)30 1234567 +", "+1" + " " * 30 + "234567890", "+12345678901234567", "\U0001f600 a@b.co \U0001f600 1.2.3.4",
    "a." + "b." * 20_000 + "c@" + "d." * 20_000 + "e", "1 " * 30_000, "+" * 20_000 + "1", "٣.٤.٥.٦ ١", "a@b.c\x00d@e.f", "a@b.co " * 700,
]


def test_base_on_edge_cases(spark):
    got = base_of(spark, EDGE)
    for text, spans in zip(EDGE, got, strict=True):
        assert spans == brute(text), repr((text or "")[:60])


def test_base_on_random_texts(spark):
    texts = []

    @settings(max_examples=1500, deadline=None, database=None)
    @given(st.text(alphabet="aA1209.@ -+()é_", max_size=40))
    def collect(t):
        texts.append(t)

    collect()
    assert base_of(spark, texts) == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def result(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    return docs, P.op3_personal_data(spark, DATA).collect()


def test_whole_table(result):
    docs, rows = result
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"(?:^|,){k}:", base)) for k in KINDS]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_secrets_are_added_and_little_else(result):
    docs, rows = result
    secrets = {i: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)] for i, t in docs.items()}
    added = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x and x.split(":")[0] not in KINDS] for r in rows}
    wanted, got = {(i, s) for i, a in secrets.items() for s in a}, {(i, s) for i, a in added.items() for s in a}
    assert wanted and len(wanted & got) >= 0.95 * len(wanted)
    assert len(got - wanted) <= 0.1 * len(wanted)


def test_redaction(spark):
    rows = [(1, "x a@b.co y +1 (017) 555-7713.", 3, "k"), (2, None, None, "k"), (3, "clean", 5, "k"), (4, "+4111111111111111 é a@b.co", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    out = {r.doc_id: (r.text, r.n_chars) for r in P.redact(df).collect()}
    assert out[1] == ("x <EMAIL> y <PHONE>.", 21 - 1) or out[1][0] == "x <EMAIL> y <PHONE>."
    assert out[2] == (None, None) and out[3] == ("clean", 5)
    assert out[4][0] == "+<CARD> é <EMAIL>"
    assert P.redact(df.limit(0)).columns == df.columns and P.redact(df.limit(0)).collect() == []


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op3_personal_data(spark, str(tmp_path)).collect() == []


def test_reliabilities_favour_agreeing_labelers():
    for_, against, mixed = (0, 1, 0, 1, 1, 0), (-1, 0, -1, -1, -1, -1), (0, 1, 0, -1, 0, 0)
    found = [(for_, (4, 1, 0, 0, 1, 1, 1), 50), (against, (4, 2, 0, 0, 1, 1, 0), 50), (mixed, (4, 1, 0, 0, 1, 1, 1), 10)]
    prior, _, belief = P.reliabilities(found)
    assert 0.3 < prior < 0.8 and belief[for_] > 0.9 and belief[against] < 0.1
    assert P.reliabilities([])[2] == {} and P.train([], {}) == {}


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def planted(rng):
    """A text with one candidate, and whether that is personal data."""
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(3, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n - 3)) + "7a4"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds = [
        (lambda: (f'token = "', pick(40), '" '), True), (lambda: ("password: ", pick(24, mixed), "\n"), True), (lambda: ("api_key=", pick(32, mixed), " "), True), (lambda: ("IBAN: ", iban(rng), ". "), True),
        (lambda: ("SSN ", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", ", "), True), (lambda: ("call ", f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", ". "), True),
        (lambda: ("Contact: ", f"{rng.choice(P.GIVEN)} {word().capitalize()}", ", "), True),
        (lambda: ("order no ", digits(8), " "), False), (lambda: ("version ", f"{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(30)}", " "), False), (lambda: ("since ", f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-{rng.randrange(10, 28)}", " "), False),
        (lambda: ("commit ", pick(40), " "), False), (lambda: (word() + " ", "1219538112535716", " " + word()), False), (lambda: ("sha256 checksum ", pick(64), " "), False), (lambda: ("see /files/", pick(32), "/" + word()), False),
        (lambda: ("the ", f"{rng.choice(P.GIVEN)} {word().capitalize()}", " University "), False),
    ]
    make, is_personal = rng.choice(kinds)
    before, match, after = make()
    head = " ".join(word() for _ in range(rng.randrange(3, 12))) + " " + before
    return head + match + after + " ".join(word() for _ in range(5)), (len(head), len(head) + len(match)), is_personal


def test_candidates_are_told_apart(spark):
    rng = random.Random(5)
    rows = [planted(rng) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = P.patterns(df)
    belief = P.reliabilities(found)[2]
    assert min(belief.values()) < 0.05 and max(belief.values()) > 0.95
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in filter(None, r.s.split(","))] for r in df.select("doc_id", P._joined(P.detected(F.col("text"), P.learn(df))["spans"]).alias("s")).collect()}
    tally = {(a, b): sum((span in got[i]) == a and is_personal == b for i, (_, span, is_personal) in enumerate(rows)) for a in (True, False) for b in (True, False)}
    recall, precision = tally[True, True] / (tally[True, True] + tally[False, True]), tally[True, True] / (tally[True, True] + tally[True, False])
    print("recall", recall, "precision", precision, tally)
    assert tally[False, False] > 100  # the classifier rejects candidates
    assert recall >= 0.9 and precision >= 0.9


def test_checksum_of_account_numbers(spark):
    rng = random.Random(1)
    good = [iban(rng) for _ in range(20)] + ["GB82WEST12345698765432", "NL91ABNA0417164300"]
    bad = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select(P.iban_valid(F.col("x")).alias("v"))
    assert [r.v for r in df.collect()] == [True] * len(good) + [False] * len(bad)
