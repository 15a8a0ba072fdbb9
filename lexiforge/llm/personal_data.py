"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) are exact, always reported, and no part of what is learned.  One wider pattern
proposes further candidates, among them many that are no personal data: order numbers, versions, dates, hashes, numbers that
fail their check.  Labelers look at each candidate: its format, gazetteers of announcing and of counting words near it, names
and what follows them, its surroundings, its characters, a checksum.  Each votes for, against or, by default, not at all.
Expectation-maximisation estimates the labelers' reliabilities from the counts of all vote patterns, and a logistic classifier
of a candidate's features is trained on the resulting probabilities.  Candidates that it accepts and that touch no base span
are added.

Everything on the corpus is column expressions and one aggregate.  What comes to the driver are counts of equal vote and
feature patterns, whose number is bounded by the labelers' and features' values and not by the corpus.

Defined results: a null text counts as empty; repeated rows are judged alike; without candidates nothing is added; other
columns pass unused.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.columns import let, spans
from lexiforge.llm.common import table

# Matches begin where a run of their first characters begins, or where the match before ended; so a long run that is no
# match is read once.  Repetitions whose end cannot matter are possessive, so that they need no stack.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What the wider pattern may match, by kind; the first that fits at a place is taken.
_SHAPES = {
    "mac": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_+/-])",
    "secret": r"(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "identifier": r"[0-9]{1,19}(?:[./-][0-9]{1,12}){1,5}+(?![A-Za-z0-9])|[0-9]{6,}+(?![A-Za-z0-9])",
}

#: Kind: (what a text must hold to be searched at all, the pattern).  The base kinds come first, in the order of output.
BASE = {"email": (r"@", _EMAIL), "ip": (r"[0-9]\.[0-9]", _IP), "card": (r"[0-9](?:[\x20-]?[0-9]){13}", _CARD), "phone": (r"\+[0-9]", _PHONE)}
KINDS = [*BASE, "secret", "iban", "ssn", "mac", "local_phone", "person", "identifier"]

#: Given names that begin a person's name.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Ashley Kimberly Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Laura Cynthia "
    "Hans Peter Klaus Wolfgang Jürgen Dieter Manfred Günther Helmut Uwe Stefan Andreas Ursula Monika Petra Sabine Renate Helga Brigitte Ingrid Claudia Katrin "
    "Jean Pierre Michel Philippe Alain Nicolas Jacques François Laurent Marie Nathalie Isabelle Sylvie Catherine Françoise Valérie "
    "José Antonio Manuel Francisco Javier Carlos Miguel Rafael Pedro María Carmen Josefa Dolores Pilar Teresa Mercedes"
).split()
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sr", "sra", "dear", "liebe", "lieber", "cher", "chère", "estimado", "estimada")
#: Words after a name that make it that of a place or a body.
BODIES = ("street", "avenue", "road", "university", "college", "school", "hospital", "inc", "ltd", "corp", "company", "foundation", "institute", "award", "prize", "museum", "church", "square", "bridge", "airport", "park", "island", "straße", "platz")
#: Words that announce each kind.
GAZETTEER = {
    "secret": ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "apikey", "api_key", "access key", "secret key", "private key", "key", "bearer", "authorization", "credential", "client secret", "session"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "sparkasse", "volksbank", "barclays", "hsbc", "deutsche bank", "commerzbank", "santander", "bbva", "bnp paribas", "société générale", "ing", "unicredit", "lloyds"),
    "ssn": ("ssn", "social security", "taxpayer id", "tax id", "itin"),
    "mac": ("mac", "ether", "hwaddr", "hardware address", "physical address", "bssid"),
    "local_phone": ("phone", "telephone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "reach"),
    "person": (*TITLES, "name", "contact", "signed", "regards", "sincerely", "attn", "attention", "patient", "customer", "employee"),
    "identifier": ("passport", "driver license", "license number", "account", "customer id", "patient id", "member id", "national id", "steuernummer", "dni", "nie", "date of birth", "dob", "born", "birthday"),
}
#: Words before a number or a name of another sort.
COUNTERS = (
    "page", "figure", "fig", "table", "version", "release", "build", "vol", "volume", "no", "issue", "chapter", "section", "isbn", "issn", "doi", "commit", "revision", "sha", "md5", "checksum", "hash", "digest",
    "order", "invoice", "ticket", "ref", "reference", "model", "part", "serial", "article", "item", "sku", "tracking", "case", "at", "in", "from", "since", "until", "about",
)
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?:\x20\p{Lu}\p{Ll}+)?"
_PERSON = rf"(?<![\p{{L}}0-9])(?=\p{{Lu}})(?:{'|'.join(GIVEN)})\x20{_NAME}"
_NUMBERS = r"(?<![A-Za-z0-9_+/.-])(?:" + "|".join(_SHAPES.values()) + ")"

LABELERS = ("format", "announced", "counted", "surroundings", "characters", "checksum")
ROUNDS = 60
ACCEPT = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` (19 at most are asked about) pass the Luhn check."""

    def of(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda x, i: let(x.cast("int"), lambda v: F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)))
        return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0

    return let(_digits(m), lambda d: F.length(d).between(1, 19) & of(d))


def iban_valid(m: Column) -> Column:
    """Whether the number that letters (A is 10) and digits make, country and check digits last, is 1 modulo 97."""
    turned = F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))
    # a letter has two digits, which move what stands before by a factor of 100
    step = lambda r, x: F.when(x.rlike("[0-9]"), (r * 10 + F.coalesce(x.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


CANDIDATES = "array<struct<start:int,kind:int,end:int,match:string,before:string,after:string>>"


def _found(text: Column, kind: str) -> Column:
    asked, pattern = BASE[kind]
    number = KINDS.index(kind)
    hits = F.filter(spans(text, pattern), lambda x: _valid(kind, x["match"]))
    rows = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))
    return F.when(text.rlike(asked), rows).otherwise(F.array().cast(CANDIDATES))


def base_spans(text: Column) -> Column:
    """The spans of the base patterns, by start and then kind."""
    found = lambda *kinds: F.concat(*[_found(text, k) for k in kinds])
    numbers = F.when(text.rlike("[0-9]"), found("ip", "card", "phone")).otherwise(F.array().cast(CANDIDATES))
    return F.sort_array(F.concat(F.when(F.contains(text, F.lit("@")), found("email")).otherwise(F.array().cast(CANDIDATES)), numbers))


def _kind(m: Column) -> Column:
    """The kind of a wider candidate, by its shape."""
    out = F.when(m.rlike(r"^\p{Lu}\p{Ll}+\x20"), KINDS.index("person"))
    for kind, shape in _SHAPES.items():
        out = out.when(m.rlike(f"^(?:{shape})$"), KINDS.index(kind))
    return out.otherwise(KINDS.index("secret"))


def wider_spans(text: Column, base: Column) -> Column:
    """Candidates of the wider patterns that touch no base span; numbers and names do not overlap."""

    def found(t: Column, pattern: str) -> Column:
        rows = F.transform(spans(t, pattern, 64), lambda x: F.struct(x["start"].alias("start"), _kind(x["match"]).alias("kind"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))
        return F.filter(rows, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    none = F.array().cast(CANDIDATES)
    return F.concat(F.when(text.rlike("[0-9]"), found(text, _NUMBERS)).otherwise(none), F.when(text.rlike(_PERSON), found(text, _PERSON)).otherwise(none))


def _announced(near: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words comes right before, but for marks and a few small words."""
    return F.lower(near).rlike(r"(?:^|[^\p{L}])(?:" + "|".join(words) + r")s?[^\p{L}]*(?:(?:is|was|to|id|no|nr|number|address|ist|est|es)[^\p{L}]*){0,2}$")


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for personal data, -1 against, 0 no opinion."""
    kind, m = c["kind"], c["match"]
    is_kind = lambda *names: kind.isin(*[KINDS.index(n) for n in names])
    distinct = lambda x: F.size(F.array_distinct(F.split(x, "")))
    known_key = m.rlike(r"^(?:gh[opsur]_[A-Za-z0-9]{36}|github_pat_|glpat-|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[A-Za-z0-9_-]{30,}|sk-[A-Za-z0-9-]{20,}|xox[abprs]-|eyJ[A-Za-z0-9_-]{10,})")
    date = m.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)?[0-9]{2})$")
    version = m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){1,4}$")
    own_word = F.lit(0)
    for name, words in GAZETTEER.items():
        own_word = F.when(is_kind(name), _announced(c["before"], words).cast("int")).otherwise(own_word)
    quoted = c["before"].rlike(r"""[:=]\s*["'<(]?$""") & ~c["after"].rlike(r"^[\p{L}]")
    in_prose = c["before"].rlike(r"\p{L},?\s$") & c["after"].rlike(r"^\s\p{Ll}")
    glued = c["before"].rlike(r"[\p{L}0-9/_#@]$") | c["after"].rlike(r"^(?:[\p{L}0-9/_%@]|\.[\p{L}0-9])")
    return {
        "format": F.when(known_key, 1).when(date | version | m.rlike("[-_=+/]{3}") | m.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-"), -1).when(is_kind("person") & (F.lower(m).rlike(r"\s(?:" + "|".join(BODIES) + ")$") | F.lower(c["after"]).rlike(r"^\s(?:" + "|".join(BODIES) + r")(?![\p{L}])")), -1).otherwise(0),
        "announced": own_word,
        "counted": F.when(_announced(c["before"], COUNTERS), -1).otherwise(0),
        "surroundings": F.when(quoted, 1).when(glued, -1).when(in_prose & ~is_kind("person"), -1).otherwise(0),
        "characters": F.when(is_kind("identifier"), F.when(m.rlike("^[0-9]+$") & (F.length(m) > 12), -1).otherwise(0)).when(is_kind("secret"), let(distinct(m), lambda n: F.when((n >= 10) & m.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"), 1).when(n <= 6, -1).otherwise(0))).otherwise(0),
        "checksum": F.when(is_kind("iban"), F.when(iban_valid(m), 1).otherwise(-1)).when(is_kind("ssn"), F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(0))
        .when(is_kind("local_phone"), F.when(m.rlike(r"^[2-9][0-9]{2}.[2-9]"), 0).otherwise(-1)).when(is_kind("identifier") & F.length(_digits(m)).between(13, 19), F.when(luhn(m), 0).otherwise(-1)).otherwise(0),
    }


def traits(c: Column) -> dict[str, Column]:
    """A candidate's features, each with a few values."""
    m = c["match"]
    share = lambda pattern: F.floor(4 * F.length(F.regexp_replace(m, pattern, "")) / F.greatest(F.length(m), F.lit(1))).cast("int")
    own_word = F.lit(0)
    for name, words in GAZETTEER.items():
        own_word = F.when(c["kind"] == KINDS.index(name), _announced(c["before"], words).cast("int")).otherwise(own_word)
    return {
        "kind": c["kind"], "length": F.least(F.floor(F.length(m) / 8), F.lit(8)).cast("int"), "digits": share("[^0-9]"), "upper": share("[^A-Z]"),
        "before": F.when(c["before"] == "", 0).when(c["before"].rlike(r"\s$"), 1).when(c["before"].rlike(r"""["'<(\[]$"""), 2).when(c["before"].rlike("[:=]$"), 3).otherwise(4),
        "after": F.when(c["after"] == "", 0).when(c["after"].rlike(r"^\s"), 1).when(c["after"].rlike(r"""^[")'>\]]"""), 2).when(c["after"].rlike("^[.,;:!?]"), 3).otherwise(4),
        "words": F.when(own_word == 1, 1).when(_announced(c["before"], COUNTERS), 2).otherwise(0),
    }


TRAITS = ("kind", "length", "digits", "upper", "before", "after", "words")
Pattern = tuple[tuple[int, ...], tuple[int, ...], int]  # votes, traits, count


def patterns(docs: DataFrame) -> list[Pattern]:
    """How often each combination of votes and traits occurs among the wider candidates of the whole corpus."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(let(text, lambda t: wider_spans(t, base_spans(t))).alias("_all")).where(F.size("_all") > 0)
    each = found.select(F.explode("_all").alias("_c"))
    c = F.col("_c")
    each = each.select(*[v.cast("int").alias(f"v_{n}") for n, v in votes(c).items()], *[v.cast("int").alias(f"t_{n}") for n, v in traits(c).items()])
    counts = each.groupBy(*each.columns).count().collect()
    return sorted((tuple(r[f"v_{n}"] for n in LABELERS), tuple(r[f"t_{n}"] for n in TRAITS), r["count"]) for r in counts)


def reliabilities(found: list[Pattern]) -> tuple[float, dict[tuple[int, int, int], float], dict[tuple[int, ...], float]]:
    """Expectation-maximisation: the share of personal data, P(vote | class) by (labeler, vote, class), and for each
    vote pattern the probability of personal data.  Begins from the majority of votes."""
    by_votes: dict[tuple[int, ...], int] = defaultdict(int)
    for v, _, n in found:
        by_votes[v] += n
    belief = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in by_votes}
    prior, rate = 0.5, {}
    for _ in range(ROUNDS if by_votes else 0):
        total = sum(by_votes.values())
        prior = (1 + sum(n * belief[v] for v, n in by_votes.items())) / (2 + total)
        for j, vote, y in product(range(len(LABELERS)), (-1, 0, 1), (0, 1)):
            mass = sum(n * (belief[v] if y else 1 - belief[v]) for v, n in by_votes.items())
            here = sum(n * (belief[v] if y else 1 - belief[v]) for v, n in by_votes.items() if v[j] == vote)
            # a vote counts a little for its own side before anything is seen
            lean = 2.0 if vote == (1 if y else -1) else 1.0 if vote == 0 else 0.5
            rate[j, vote, y] = (here + lean) / (mass + 3.5)
        for v in by_votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, x, 1] / rate[j, x, 0]) for j, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, rate, belief


Weights = dict[tuple[str, int], float]


def train(found: list[Pattern], belief: dict[tuple[int, ...], float], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Weights:
    """A logistic classifier of traits, fitted to the probabilities by gradient steps with a decaying sum of squares."""
    mass: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for v, t, n in found:
        mass[t][0] += n
        mass[t][1] += n * belief[v]
    total = sum(n for n, _ in mass.values()) or 1.0
    w: Weights = defaultdict(float)
    seen: Weights = defaultdict(lambda: 1e-6)
    keys = {t: [("", 0), *zip(TRAITS, t, strict=True)] for t in mass}
    for _ in range(rounds):
        slope: Weights = defaultdict(float)
        for t, (n, p) in mass.items():
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[k] for k in keys[t])))))
            for k in keys[t]:
                slope[k] += (n * score - p) / total
        for k, g in slope.items():
            g += decay * w[k]
            seen[k] += g * g
            w[k] -= rate * g / math.sqrt(seen[k])
    return dict(w)


def score(c: Column, weights: Weights) -> Column:
    """The classifier as a column; a value never seen in training weighs nothing."""
    total = F.lit(weights.get(("", 0), 0.0))
    for name, value in traits(c).items():
        known = [(v, w) for (n, v), w in sorted(weights.items()) if n == name]
        weight = F.lit(0.0)
        for v, w in known:
            weight = F.when(value == v, F.lit(w)).otherwise(weight)
        total = total + weight
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame) -> Weights:
    found = patterns(docs)
    return train(found, reliabilities(found)[2])


def detected(text: Column, weights: Weights) -> Column:
    """A struct of the base spans and of all spans, each array<(start, kind, end, ...)> in order."""
    if weights:
        added = lambda t, b: F.filter(wider_spans(t, b), lambda c: score(c, weights) >= ACCEPT)
    else:
        added = lambda t, b: F.array().cast(CANDIDATES)
    return let(F.coalesce(text, F.lit("")), lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, added(t, b))).alias("spans"))))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("_d.base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    out = docs.select("doc_id", detected(F.col("text"), learn(docs)).alias("_d"))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("_d.base")), 256).alias("base_sha256"), _joined(F.col("_d.spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets, of overlapping spans by that of the
    first, and ``n_chars`` brought up to date.  A null text stays null."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def merged(found: Column) -> Column:
        start = F.array().cast("array<struct<start:int,kind:int,end:int>>")

        def add(done: Column, x: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            new = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
            grown = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when((F.size(done) > 0) & (x["start"] < last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new)))

        return F.aggregate(found, start, add)

    def written(t: Column, m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        parts = F.transform(m, lambda x, i: F.concat(F.substring(t, before(i) + 1, x["start"] - before(i)), F.get(names, x["kind"])))
        tail = F.substring(t, F.get(m, F.size(m) - 1)["end"] + 1, F.length(t))
        return F.concat(F.array_join(parts, ""), tail)

    weights = learn(docs)
    text = let(F.col("text"), lambda t: let(detected(t, weights)["spans"], lambda s: F.when(F.size(s) == 0, t).otherwise(let(merged(s), lambda m: written(t, m)))))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")], text.alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])
