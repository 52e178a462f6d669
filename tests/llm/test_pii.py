"""Base spans against Python's re, the added spans on planted keys, redaction against slices."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerline.llm import pii as P

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if valid(k, m[0]))


def digest(spans):
    return hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


ODD = [
    None, "", "a@b.c_d@e.f g@h", "a@b@c.dd.ee", "x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.0255.9 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4 1", "+1 (988) 555-2485, +1-2 +49 30 1234567890123456 ++12 345 678 9012",
    "𝒳é 10.0.0.1 𝒳 a.b@c-d.example.com", "4041894974608795", "1" * 40000, "a" * 40000, "a." * 20000, "1." * 9000, "1 " * 9000, "x@y" + ".z" * 9000, "mail a@b.co " * 3000, "+1 " + "2.3-" * 5000, "dup a@b.co", "dup a@b.co",
]


def test_base_of_all_texts(spark, sf_dir):
    odd = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "a@b.co", "x", 1)], "doc_id long, text string, base string, cands int")
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = sorted(((r[0], digest(plain(r[1]))) for r in df.select("doc_id", "text").collect()), key=repr)
        got = P.pii_spans(df).select("doc_id", F.sha2(P.written(F.col("base")), 256)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert P.pii_spans(odd.limit(0)).count() == 0


def test_added_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    key = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    n = found = wrong = 0
    for r in P.op1_pii(spark, sf_dir).collect():
        text = rows[r["doc_id"]]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert digest([(s, P.KINDS.index(k), e) for k, s, e in spans if k in P.BASE]) == r["base_sha256"]
        want, got = {m.span() for m in key.finditer(text)}, {(s, e) for k, s, e in spans if k not in P.BASE}
        n, found, wrong = n + len(want), found + len(want & got), wrong + len(got - want)
    assert n > 5 and found >= 0.9 * n and wrong <= 0.1 * n


def test_redaction(spark):
    many = "call +1 (988) 555-2485 or a@b.co é " * 400
    texts = [None, "", "no data", "mail a@b.co, 10.0.0.1!", "+1.2.3.4 555 1234567 x", "x" * (P.CHUNK - 2) + "a@b.co" + "y" * 5000, many]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, doc int")
    got = {r["doc_id"]: r for r in P.redact(df).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for s, k, e in plain(t):
            if s >= at:
                want += (t or "")[at:s] + f"<{P.KINDS[k].upper()}>"
            at = max(at, e)
        assert got[i]["text"] == (None if t is None else want + t[at:]) and got[i]["doc"] == 5


def bank_number(rng, country="DE"):
    body = "".join(rng.choice("0123456789") for _ in range(P.BANKS[country] - 4))
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{body}"


def planted_numbers(rng, n=40):
    """Texts with one number each: (text, the number or None if it is none)."""
    word = lambda: rng.choice("the house of a green river runs by old stone walls and no one knows why".split())
    line = lambda: " ".join(word() for _ in range(8))
    digits = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    out = []
    for k in range(n):
        iban = bank_number(rng, rng.choice(["DE", "FI", "FR", "NL"]))
        spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
        bad = iban[:2] + f"{(int(iban[2:4]) + 5) % 90 + 5:02d}" + iban[4:]
        ssn, tel = f"{digits(3, '12345')}-{digits(2, '1234')}-{digits(4, '123')}", f"{digits(3, '23456789')}{'-'}{digits(3, '23456789')}-{digits(4)}"
        for cue, good in (("IBAN: ", rng.choice([iban, spaced])), ("SSN: ", ssn), ("phone: ", tel), ("password = ", "".join(rng.choice("0123456789abcdef") for _ in range(32)))):
            out.append((f"{line()} {cue}{good} {line()}", good))
        for cue, other in (("part ", bad), ("order ", f"000-00-{digits(4)}"), ("version ", f"{digits(3, '01')}.{digits(3, '01')}.{digits(4)}"), ("page /", "averylonglowercasename1234567")):
            out.append((f"{line()} {cue}{other} {line()}", None))
    return out


def test_planted_numbers_of_all_kinds(spark):
    rng = random.Random(12)
    made = planted_numbers(rng)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    found = {r["doc_id"]: [made[r["doc_id"]][0][x["s"] : x["e"]] for x in r["spans"]] for r in P.pii_spans(df).collect()}
    for kind, name in enumerate(("iban", "idnum", "tel", "key")):
        good = [k for k in range(len(made)) if k % 8 == kind]
        assert sum(made[k][1] in found[k] for k in good) >= 0.9 * len(good), name
    wrong = [k for k in range(len(made)) if made[k][1] is None]
    assert sum(bool(found[k]) for k in wrong) <= 0.1 * len(wrong)


def test_check_digits(spark):
    rng = random.Random(2)
    good = [bank_number(rng, c) for c in P.BANKS] + ["GB82 WEST 1234 5698 7654 32"]
    rows = [(x, True) for x in good] + [(x[:-1] + str((int(x[-1]) + 1) % 10), False) for x in good]
    got = spark.createDataFrame(rows, "x string, ok boolean").select("ok", P._checked(F.col("x")).alias("c")).collect()
    assert all(r["ok"] == r["c"] for r in got)
