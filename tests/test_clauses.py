"""Clauses and detectors against plain regular expressions and by hand."""

import re

from pyspark.sql import functions as F

from ledgerline.operators import clauses as C
from ledgerline.plans import catalog
from ledgerline.plans.clauses import _texts

ONE = re.compile("|".join(f"(?P<p{k}>{p})" for k, (*_, p) in enumerate(C.CLAUSES)), re.IGNORECASE)


def sample(pattern):
    """A text that the pattern matches: the first of all alternatives, nothing of what may be left out."""
    while "(?:" in pattern:
        pattern = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] else m[1].split("|")[0], pattern)
    for a, b in ((r"\s+", " "), (r"[\s-]", "-"), (r"\w+", "a"), (r"\d", "1"), (r"\b", "")):
        pattern = pattern.replace(a, b)
    return re.sub(r".\?", "", re.sub(r"\.\{0,\d+\}", "", pattern))


def test_each_pattern_is_found_and_none_passed_over(spark):
    rows = [(k, f"X {sample(p).upper()} y") for k, (*_, p) in enumerate(C.CLAUSES)]
    assert all(re.search(C.CLAUSES[k][2], t, re.IGNORECASE) for k, t in rows)
    got = {}
    for r in C.clauses(spark.createDataFrame(rows, "id int, text string"), id_col="id", text_col="text").collect():
        got.setdefault(r["id"], []).append((r["at"], r["category"], r["subtype"], r["said"]))
    for k, t in rows:
        want = [(m.start(), *C.CLAUSES[int(m.lastgroup[1:])][:2], m[0]) for m in ONE.finditer(t)]
        assert got.get(k) == want and want


def test_scan_of_all_texts(spark, sf_dir):
    want = []
    for r in _texts(spark, sf_dir).collect():
        for m in ONE.finditer(r["text"]):
            around = r["text"][max(0, m.start() - 60) : m.end() + 60].replace("\n", " ").strip(" ")
            want.append((r["doc_id"], m.start(), *C.CLAUSES[int(m.lastgroup[1:])][:2], m[0], around))
    got = [tuple(r[c] for c in ("doc_id", "place", "category", "subtype", "said", "context")) for r in catalog.QUERIES["clause_scan"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len({w[2:4] for w in want}) > 8


def test_spots_count_characters(spark):
    df = spark.createDataFrame([("äb12 3é45",), ("7",), ("",), ("x",)], "t string")
    got = [[tuple(x) for x in r["s"]] for r in df.select(C.spots(F.col("t"), "[0-9]+").alias("s")).collect()]
    assert got == [[(2, "12"), (5, "3"), (7, "45")], [(0, "7")], [], []]


def detect(spark, impact, claims=(), proposed=(), year=2024, report=None):
    atoms = spark.createDataFrame([(1, "IMPACT", t) for t in impact] + [(1, "PROPOSED", t) for t in proposed], "bill long, part string, text string")
    years = spark.createDataFrame([(1, year)], "bill long, year int")
    money = spark.createDataFrame([(1, *c) for c in claims], "bill long, kind string, euros double")
    reports = spark.createDataFrame([(1, *report)] if report else [], "bill long, committee string, ignored double, delegations int")
    return {r["detector"]: r["severity"] for r in C.detected(C.profile(atoms, years), money, reports).collect()}


def test_detectors_by_hand(spark):
    big, small = [("FISCAL", 6e8)] * 2, [("FISCAL", 1e3), ("FISCAL", None), ("BEHAVIORAL", None)]
    assert detect(spark, ["työllisyys -700–+3 200 ja -50–20"]) == {"sign_cross": 3}
    assert detect(spark, ["työllisyys -700–+3 200 https://a.fi", "vaihteluväli 5 - 7", "x -1–2"]) == {}
    assert detect(spark, ["ei voida arvioida " * 5], [("FISCAL", 1e3)] * 2) == {"confession_proceed": 2}
    assert detect(spark, ["ei voida arvioida " * 5], small) == {}
    assert detect(spark, ["a" * 30000, None]) == {"zero_failure": 1} and detect(spark, ["a" * 29999]) == {}
    assert detect(spark, ["a" * 30000 + "riski " * 5]) == {} and detect(spark, ["a" * 30000 + "köyhyysriski " * 50]) == {"zero_failure": 1}
    assert detect(spark, ["malli on staattinen"], small) == {"static_fiscal": 1}
    assert detect(spark, ["Ei aiheuta lisäkustannuksia."], report=("x", 0.0, 2), proposed=["rekisteri"]) == {"impl_zero": 1}
    assert detect(spark, ["ei voida arvioida, ei ole arvioitu, säädetään erikseen, karkeasti noin"], [("FISCAL", -6e5)] * 2) == {"epistemic_buffer": 1}
    assert detect(spark, ["vuoden 2021 tilasto", "perustuu vuoden 2023"]) == {"stale_data": 2}
    assert detect(spark, ["vuoden 2022 aineisto on riittävä"]) == {"stale_data": 3}
    assert detect(spark, ["on pysynyt vuoden 2012 tasolla"]) == {"frozen_parameter": 2} and detect(spark, ["päästö on pysynyt vuoden 2012 tasolla"]) == {}
    long = "riski " * 3000
    assert detect(spark, [long + "säästöpaine"], proposed=["vähimmäismäärä"]) == {"minimum_becomes_maximum": 1}
    assert detect(spark, [long + "säästöpaine mitoituksen katto"], proposed=["vähimmäismäärä"]) == {}
    assert detect(spark, ["sopimuksen nojalla, direktiivin vaatima, komissio on todennut. Potilas."]) == {"juridical_shield": 2}
    assert detect(spark, ["asumistuki"], report=("Valtiovarainvaliokunta", 0.7, 0)) == {"domain_committee_mismatch": 3}
    assert detect(spark, ["asumistuki"], report=("Sosiaali- ja terveysvaliokunta", 0.7, 0)) == {} == detect(spark, ["asumistuki"])
    assert detect(spark, ["x"], big) == {"model_void": 3} and detect(spark, ["SISU"], big) == {} and "model_void" in detect(spark, ["sisu"], big)


def test_all_detectors_are_met(spark, sf_dir):
    assert {r["detector"] for r in catalog.QUERIES["bill_detectors"](spark, sf_dir).select("detector").distinct().collect()} >= {"sign_cross", "confession_proceed", "static_fiscal", "impl_zero", "epistemic_buffer", "stale_data", "frozen_parameter", "juridical_shield", "domain_committee_mismatch"}


def test_clauses_with_letters_that_only_fold_alike(spark):
    """A long s is an s to a pattern that ignores case, but no plain search for stems finds it."""
    texts = spark.createDataFrame([(1, "Tästä säädetään erikſeen."), (2, None), (3, "Ei mitään")], "id long, text string")
    assert [(r["id"], r["at"], r["said"]) for r in C.clauses(texts, id_col="id", text_col="text").collect()] == [(1, 6, "säädetään erikſeen")]


def test_patterns_tried_by_their_first_letters(spark):
    """The same matches as all patterns tried at every place; letters that stand for others (ſ, ı, İ, K), nested and optional beginnings."""
    said = ["ei voida arvioida", "EI\tOLE arvioitu aineistoperusteisesti", "on hyvin vaikea arvioida", "hyvin vaikea arvioida", "on haastava erottaa", "ſuuruuſluokaltaan noin 5", "arviolta 7", "muutoksella pyritään", "eı ole huomıoıtu", "EİVÄT TULE", "selvitetään erikseen", "seikarkeasti noin", "eei voida luotettavasti", "e", ""]
    said += ["komissio on todennut", "Komissio on esittänyt", "EU:n valtiontukisäännösten vuoksi", "yhteisöoikeus estää", "este on EU", "ei ole mahdollista x direktiivi", "mahdoton EU", "säästö x hyvinvointialue", "hyvinvointialue säästö", "kuntien leikkau", "voimavarat niukat"]
    texts = spark.createDataFrame([(f"{a} {b}{c}",) for a in said for b in said for c in ("", ".")], "text string")
    for patterns in ([p for *_, p in C.CLAUSES], list(C.MANDATORY), list(C.PRESSURE), list(C.FLOOR), list(C.METHODS)):
        plain = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
        quick = C.quick(patterns)
        found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
        assert quick.count("(?=") > 2 and texts.filter(found(plain) != found(quick)).count() == 0
        assert patterns == list(C.METHODS) or patterns == list(C.FLOOR) or texts.filter(F.size(found(plain)) > 0).count() > 20
