"""Library functions without SQL: identity, pages, streams, readers, allocations, against plain Python and by hand."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import html as H
from ledgerline.functions import text as T
from ledgerline.operators import ballots as B
from ledgerline.operators import identity as P
from ledgerline.operators import incremental as N
from ledgerline.operators import intervals as I
from ledgerline.operators import matching as M
from ledgerline.operators import rollups as R
from ledgerline.plans import catalog
from ledgerline.sources import readers


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"


def test_names_fold_and_keep_letters_apart(spark):
    rows = spark.createDataFrame([("Šek", "ek"), ("Ｊｏｈｎ –Paul", "o'Brien"), (None, "x"), ("!", "y")], "first string, last string")
    got = rows.select(P.fold("first").alias("f"), P.name_key(F.col("first"), F.col("last")).alias("k"), P.name_tokens("first").alias("t")).collect()
    assert [r["f"] for r in got] == ["šek", "john -paul", "", ""]
    assert [r["k"] for r in got] == ["ek|šek", "o brien|john -paul", None, None]
    assert [r["t"] for r in got] == [["sek"], ["john", "paul"], [], []]


def test_candidacies_join_only_where_they_must_be_one_person(spark):
    rows = [(1, "a", 1999, 40), (2, "a", 2003, 44), (3, "a", 2007, 49), (4, "b", 1999, 30), (5, "b", 2003, 34), (6, "b", 2003, 33), (7, "c", 1999, 30), (8, "c", 2003, None), (9, None, 1999, 30), (10, None, 2003, 34), (11, "d", 1999, 20), (12, "d", 2003, 60)]
    df = spark.createDataFrame(rows, "id long, key string, year int, age int")
    got = {r["id"]: r["cluster"] for r in P.clustered(df, id_col="id", key="key", year="year", age="age").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12}


def test_members_are_matched_once(spark):
    clusters = spark.createDataFrame([(1, "a", 1999, 40), (1, "a", 2003, 44), (2, "b", 1999, 30), (3, "b", 2003, 34), (4, "c", 1999, 30), (5, "d", 1999, None), (6, "e", 1999, 30)], "cluster long, key string, year int, age int")
    members = spark.createDataFrame([(10, "a", 1958), (11, "a", 1900), (12, "b", 1969), (13, "c", None), (14, "d", 1960), (15, "e", 1968), (16, "e", 1969)], "person_id long, key string, birth_year int")
    got = {r["cluster"]: (r["person_id"], r["status"]) for r in P.matched_members(clusters, members).collect()}
    assert got == {1: (10, "MP_UNIQUE"), 2: (None, "AMBIGUOUS"), 3: (None, "AMBIGUOUS"), 4: (None, "CANDIDATE_ONLY"), 5: (None, "CANDIDATE_ONLY"), 6: (None, "AMBIGUOUS")}


def test_pages_are_cleaned_balanced_and_marked():
    assert H.cleaned('<div><p onclick="x">a<b>c</p>d</i><script>e()</script><a href="javascript:x" title="t">f</a><a href="/y?a=1&amp;b">g') == '<p>a<b>c</b></p>d<a>f</a><a href="/y?a=1&amp;b">g</a>'
    assert H.cleaned(None) is None and H.cleaned("") == "" and H.cleaned("1 < 2") == "1 &lt; 2"
    page = "<p>one <b>two</b> three four</p><p>five</p>"
    assert H.highlighted(page, ["two three", "three", "five", "six", ""]) == "<p>one <b><mark>two</mark></b><mark> three</mark> four</p><p><mark>five</mark></p>"
    assert H.highlighted(None, ["a"]) is None and H.highlighted("a", None) == "a"


def test_page_queries(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import hashlib

    for r in catalog.QUERIES["sanitised_pages"](spark, sf_dir).collect():
        assert r["html_sha256"] == hashlib.sha256(H.cleaned(pages[r["page_id"]]).encode()).hexdigest()
        assert H.text_of(r["marked"]) == H.text_of(H.cleaned(pages[r["page_id"]]))


def plain_clusters(rows):
    """Clusters of one key's (id, year, age), joined pair by pair as the docstring says."""
    of = {r[0]: frozenset([r]) for r in rows}
    one_birth = lambda rs: max(y - a - 1 for _, y, a in rs) <= min(y - a for _, y, a in rs)
    for x in sorted(rows):
        for y in sorted(rows):
            a, b = of[x[0]], of[y[0]]
            both = a | b
            if y <= x or x[1] == y[1] or a == b or len({r[1] for r in both}) < len(both) or not one_birth(both):
                continue
            if not any(r != y and r[1] == y[1] and one_birth(a | {r}) for r in rows):
                of.update({r[0]: both for r in both})
    return {i: min(r[0] for r in members) for i, members in of.items()}


def test_identity_query_equals_plain_python(spark, sf_dir):
    from ledgerline.plans.evidence import _people

    people = _people(spark, sf_dir).withColumn("key", P.name_key(F.col("first"), F.col("last"))).collect()
    keys, want = {}, {}
    for r in people:
        if r["key"] is None or r["age"] is None:
            want[r["id"]] = r["id"]
        else:
            keys.setdefault(r["key"], []).append((r["id"], r["year"], int(r["age"])))
    for rows in keys.values():
        want |= plain_clusters(rows)
    got = catalog.QUERIES["identity_clusters"](spark, sf_dir).collect()
    assert {r["id"]: r["cluster"] for r in got} == want and len(got) == len(people)
    assert len(set(want.values())) < len(people) and any(r["status"] == "MP_UNIQUE" for r in got)


def test_random_candidacies(spark):
    rng = random.Random(11)
    rows = [(k, f"n{rng.randrange(25)}", 1999 + 4 * rng.randrange(6), 0) for k in range(260)]
    rows = [(k, n, y, y - 1960 - 3 * rng.randrange(3) + rng.randrange(3)) for k, n, y, _ in rows] + [(300 + k, "hot", 1999 + 4 * (k % 7), 30 + k % 5) for k in range(80)]
    keys = {}
    for k, n, y, a in rows:
        keys.setdefault(n, []).append((k, y, a))
    want = {}
    for group in keys.values():
        want |= plain_clusters(group)
    got = {r["id"]: r["cluster"] for r in P.clustered(spark.createDataFrame(rows, "id long, key string, year int, age int"), id_col="id", key="key", year="year", age="age").collect()}
    assert got == want and len(set(want.values())) < len(want) - 50


def test_known_cases_of_namesakes(spark):
    cases = {
        "same year": [(1, 2023, 40), (2, 2023, 40)],
        "age gap": [(3, 2019, 40), (4, 2023, 60)],
        "one person": [(5, 2019, 40), (6, 2023, 44)],
        "later namesake": [(10, 2015, 24), (11, 2019, 28), (12, 2023, 32), (13, 2023, 32)],
        "windows don't chain": [(20, 2011, 30), (21, 2015, 35), (22, 2019, 40)],
    }
    rows = [(i, key, y, a) for key, group in cases.items() for i, y, a in group]
    got = {r["id"]: r["cluster"] for r in P.clustered(spark.createDataFrame(rows, "id long, key string, year int, age int"), id_col="id", key="key", year="year", age="age").collect()}
    assert got[5] == got[6] and got[10] == got[11] and got[20] != got[22]
    assert len({got[1], got[2]}) == len({got[3], got[4]}) == 2 and len({got[10], got[12], got[13]}) == 3


def test_ballots_of_odd_sources(spark):
    rows = [("v1", "1", " jaa"), ("v1", "2", "EI"), ("v1", "3", "Tyhjää"), ("v1", "4", "poissa "), ("v2", "1", "jaa"), ("v2", "1", "ei"), ("v3", None, "jaa"), ("v4", "1", "maybe"), ("v5", "1", " ")]
    seen = B.observed(spark.createDataFrame(rows, "vote string, person string, raw string").select("vote", "person", B.response(F.col("raw")).alias("said")), "vote", "person", "said")
    got = {r["vote"]: (r["rows"], r["JAA"], r["UNKNOWN"], r["BLANK"], r["DUPLICATES"]) for r in seen.collect()}
    assert got == {"v1": (4, 1, 0, 0, False), "v2": (2, 1, 0, 0, True), "v3": (1, 1, 0, 0, True), "v4": (1, 0, 1, 0, False), "v5": (1, 0, 0, 1, False)}
    votes = spark.createDataFrame([("v1", 1, 1, 1, 1, 4, False, "2020-01-01"), ("v2", 1, 1, 0, 0, 2, True, "2020-01-01"), ("v3", None, 0, 0, 0, 1, False, "2020-01-01"), ("v4", 1, 0, 0, 0, 2, False, "2030-01-01"), ("v6", 0, 0, 0, 0, 0, None, None)],
                                  "vote string, published_JAA long, published_EI long, published_TYHJAA long, published_POISSA long, published_TOTAL long, void boolean, day string").withColumn("day", F.col("day").cast("date"))
    found = {r["vote"]: (r["state"], r["reasons"]) for r in B.diagnosed(votes, seen, "vote", "2025-01-01").collect()}
    assert found["v1"] == ("VALID", "") and found["v2"] == ("EXCLUDED_VOID", "DUPLICATE_OR_BLANK_PERSON_ID,VOID_VOTE")
    assert found["v3"] == ("EXCLUDED_SOURCE_MISMATCH", "DUPLICATE_OR_BLANK_PERSON_ID,MISSING_PUBLISHED_TOTAL")
    assert found["v4"][0] == "EXCLUDED_FUTURE" and found["v6"] == ("EXCLUDED_SOURCE_MISMATCH", "MISSING_SESSION_DATE")
    whole = {r["vote"]: r["state"] for r in B.completeness(votes, seen, "vote").collect()}
    assert whole == {"v1": "COMPLETE_FOR_DECLARED_VOTE", "v2": "COMPLETE_FOR_DECLARED_VOTE", "v3": "DECLARED_TOTAL_OR_BUCKET_UNKNOWN", "v4": "INVALID_BALLOT_RESPONSES", "v6": "NO_LOCAL_BALLOT_ROWS"}


def test_allocation_leaves_children_without_parents(spark):
    children = spark.createDataFrame([(1, "a", 0.6), (1, "b", None), (1, "c", None), (2, "d", 0.9), (2, "e", 0.4), (3, "f", None)], "k int, c string, w double")
    parents = spark.createDataFrame([(1, 100.0), (2, 10.0)], "k int, amount double")
    got = {r["c"]: r["share"] for r in R.allocated(children, parents, "k", "amount", "w").collect()}
    assert got == {"a": 60.0, "b": 20.0, "c": 20.0, "d": 9.0, "e": 4.0, "f": None}
    for tile in (1, 2, 512):
        pairs = R.pairs_by_key(children, "k", "c", tile=tile).collect()
        assert sorted((r["first"], r["second"], r["n"]) for r in pairs) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("d", "e", 1)]


def test_pairs_in_blocks_are_those_by_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice((None, *range(7))), rng.choice((None, *"abcdefghijklmnopq"))) for _ in range(150)]
    df = spark.createDataFrame(rows, "k int, c string")
    members = {k: {c for j, c in rows if j == k and c is not None} for k, _ in rows if k is not None}
    want = Counter((a, b) for ms in members.values() for a in ms for b in ms if a < b)
    for block, least in ((1, 1), (3, 2), (4096, 1)):
        got = R.pairs_in_blocks(df, "k", "c", least=least, block=block)
        assert sorted((r["first"], r["second"], r["n"]) for r in got.collect()) == sorted((*p, n) for p, n in want.items() if n >= least)
    assert R.pairs_in_blocks(df.limit(0), "k", "c").count() == 0


def test_readers_keep_errors_and_replace_partitions(spark):
    path = folder()
    spark.createDataFrame([('{"a": 1, "b": "x"}',), ("",), ("{oops",), ('{"a": "no"}',), ('{"b": null}',)], "value string").coalesce(1).write.text(path)
    good, bad = readers.jsonl(spark, path, "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect() if r["a"]) == [(1, "x")] and good.count() == 2
    assert sorted(r["text"] for r in bad.collect()) == ["{oops", '{"a": "no"}'][::-1] or sorted(r["text"] for r in bad.collect()) == sorted(["{oops", '{"a": "no"}'])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.jsonl_strict(spark, path, "a int, b string").collect()
    where = folder()
    readers.replaced(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), where, "year")
    readers.replaced(spark.createDataFrame([(3, 2021)], "v int, year int"), where, "year")
    assert sorted((r["v"], r["year"]) for r in spark.read.parquet(where).collect()) == [(1, 2020), (3, 2021)]
    bodies = folder()
    for _ in range(2):
        readers.stored_bodies(spark.createDataFrame([("a",), ("b",), ("a",)], "body string"), "body", bodies)
    assert spark.read.parquet(bodies).count() == 2


def test_upserts_and_contracts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, N.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, N.inserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    N.must_hold({"old": old})
    with pytest.raises(ValueError, match="none"):
        N.must_hold({"old": old, "none": old.filter("false")})


def test_text_parsers_on_odd_input(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.index_ranges(F.lit("3-1, 5, 7-9, 8"))) == [5, 7, 8, 9] and one(T.index_ranges(F.lit("none"))) == []
    assert [tuple(x) for x in one(T.deltas(F.lit("1A  2B x 3")))] == [(1, "A"), (3, "B")]
    assert one(T.finnish_date(F.lit("voimaan 31.2.2020"))) is None and str(one(T.finnish_date(F.lit("1.2.2020 tai 3.4.2021")))) == "2020-02-01"
    assert [tuple(x) for x in one(T.lines(F.lit("a\n\nb")))] == [(0, 2, "a\n"), (2, 3, "\n"), (3, 4, "b")] and one(T.lines(F.lit(""))) == []
    assert [(w["start"], w["end"]) for w in one(T.char_windows(F.lit("abcde"), 2))] == [(0, 2), (2, 4), (4, 5)]
    assert tuple(one(T.anchor(F.lit("abab"), F.lit("ab")))) == (0, 2, False) and tuple(one(T.anchor(F.lit("abab"), F.lit("")))) == (None, None, False)
    assert [w["first"] for w in one(I.windows_of(F.lit(0), 10, 2))] == [] and [(w["first"], w["end"]) for w in one(I.windows_of(F.lit(11), 10, 2))] == [(0, 10), (8, 11)]


def test_f1_counts_classes_that_never_occur(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, None)], "gold int, pred int")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in M.classification(pairs, [0, 1, 2]).collect()}
    assert got == {0: (0, 1, 1, 0.0), 1: (1, 0, 1, 0.666667), 2: (0, 0, 0, 0.0)}
    assert M.classification(pairs.limit(0), [5]).collect()[0]["f1"] == 0.0


def test_sources_with_duplicates_judge_nobody(spark):
    rows = [("v1", p, g, s) for p, g, s in [("a", "x", "JAA"), ("b", "x", "JAA"), ("c", "x", "JAA"), ("d", "x", "EI"), ("e", None, "JAA"), ("f", "y", "EI")]]
    rows += [("v2", p, "x", s) for p, s in [("a", "JAA"), ("b", "JAA"), ("c", "JAA"), ("c", "EI")]] + [("v3", p, "x", s) for p, s in [("a", "EI"), ("b", "JAA"), ("d", "EI"), ("c", "JAA")]] + [("v9", "z", "x", "JAA")]
    ballots = spark.createDataFrame(rows, "vote string, person string, grp string, said string")
    seen = B.observed(ballots, "vote", "person", "said")
    votes = seen.filter("vote <> 'v9'").select("vote", F.lit("2020-01-01").cast("date").alias("day"), F.lit(False).alias("void"), *(F.col(r).alias(f"published_{r}") for r in B.RESPONSES), F.col("rows").alias("published_TOTAL"))
    got = {r["person"]: r.asDict() for r in B.person_summary(ballots, B.diagnosed(votes, seen, "vote", "2025-01-01"), vote="vote", person="person", group="grp", response="said").collect()}
    assert (got["a"]["n_match"], got["a"]["n_differ"], got["a"]["n_tie"], got["a"]["n_excluded"]) == (1, 1, 0, 1)  # v3: one EI and two JAA among the others
    assert got["c"]["n_excluded"] == 2 and got["d"]["n_differ"] == 2 and got["e"]["n_no_group"] == 1 and got["f"]["n_too_few_peers"] == 1
    assert (got["a"]["status"], got["f"]["status"], got["z"]["status"]) == ("COMPARABLE", "NOT_COMPARABLE", "NO_VALID_SOURCE")
    assert got["a"]["agreement"] == 0.5 and got["a"]["contested_agreement"] == 0.5 and got["z"]["agreement"] is None


def test_html_is_decoded_before_white_space_goes(spark):
    rows = [("<p>a&nbsp;&nbsp; b</p>", "a b"), ("&amp;lt;", "<"), ("x \n y &quot;", "x y &quot;"), ("", ""), ("<>", "<>")]
    got = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(rows)], "k int, h string").orderBy("k").select(T.clean_html(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in got] == [t for _, t in rows]


def test_pages_become_python_objects_few_at_a_time():
    import pyarrow as pa

    from ledgerline.functions import html as H

    held, most = [], []
    pages = pa.array([f"<b>{k}" if k % 7 else None for k in range(1000)])
    pages_seen = lambda p: held.append(p) or H.cleaned(p)

    class Column:
        def __len__(self):
            return len(pages)

        def slice(self, at, n):
            most.append(n)
            return pages.slice(at, n)

    assert H._by_page(pages_seen, Column()).to_pylist() == [H.cleaned(p) for p in pages.to_pylist()]
    assert len(held) == 1000 and max(most) <= 64 and H._by_page(H.cleaned, pages.slice(0, 0)).to_pylist() == []
