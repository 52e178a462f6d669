"""XML atoms and spans by hand, and every atom of whole documents against its own source."""

from xml.etree import ElementTree

from ledgerline.functions import markup as X
from ledgerline.plans.markup import bills

ODD = [
    (1, '<a x="1">é<b/>t&amp;u<b>v</b><c><b>w</b></c></a>'),
    (2, "<a><b></a>"),
    (3, None),
    (4, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'),
    (5, ""),
    (6, "<?xml version='1.0'?>\n<!-- c --><ä>ö<![CDATA[<x>]]></ä>"),
]


def test_atoms_of_odd_documents(spark):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "id long, xml string, node int")
    got = {}
    for r in X.atoms(df, id_col="id", xml_col="xml").collect():
        got.setdefault(r["id"], []).append(r)
    assert [(r["path"], r["parent"], r["ordinal"], r["text"], dict(ODD)[1][r["start"] : r["end"]]) for r in got[1]] == [
        ("/a", None, 1, "ét&u", ODD[0][1]), ("/a/b", 0, 1, "", "<b/>"), ("/a/b", 0, 2, "v", "<b>v</b>"), ("/a/c", 0, 1, "", "<c><b>w</b></c>"), ("/a/c/b", 3, 1, "w", "<b>w</b>"),
    ]
    assert [(r["text"], ODD[5][1][r["start"] : r["end"]]) for r in got[6]] == [("ö<x>", "<ä>ö<![CDATA[<x>]]></ä>")]
    assert set(got) == {1, 2, 4, 5, 6} and all(len(got[k]) == 1 and got[k][0]["error"] and got[k][0]["node"] == -1 for k in (2, 4, 5))
    assert X.atoms(df.limit(0), id_col="id", xml_col="xml").count() == 0


def test_repeated_text_is_bound_in_source_order(spark):
    raw = "<Report><H>Grounds</H><P>Repeated part.</P><P>Repeated part.</P><P>gone</P><P> </P></Report>"
    text = "Grounds\nRepeated\npart.\nRepeated\npart."
    df = spark.createDataFrame([(1, raw, text), (2, "<x>", "a"), (3, raw, None), (4, None, "a")], "id long, xml string, text string")
    got = {}
    for r in X.structural_spans(df, id_col="id", xml_col="xml", text_col="text", headings=("H",)).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["state"], r["headings"]))
    assert got[1] == [(0, 7, "BOUND", []), (8, 22, "BOUND", ["Grounds"]), (23, 37, "BOUND", ["Grounds"]), (None, None, "UNBOUND", ["Grounds"])]
    assert got[2] == [(None, None, "INVALID", [])] and [s for _, _, s, _ in got[3]] == ["UNBOUND"] * 4 and 4 not in got


def test_dissent_keeps_its_voice_and_headings(spark):
    raw = "<r><m><H>Reasons</H><p>We agree.</p></m><d><H>Dissent 1</H><s><H>Grounds</H><p>We\n do not.</p></s></d></r>"
    df = spark.createDataFrame([(1, raw, "Reasons We agree. Dissent 1 Grounds We do not.")], "id long, xml string, text string")
    got = [(r["path"], r["scope"], r["headings"]) for r in X.structural_spans(df, id_col="id", xml_col="xml", text_col="text", headings=("H",), dissent=("d",)).collect()]
    assert got[1] == ("/r/m/p", "MAIN", ["Reasons"]) and got[-1] == ("/r/d/s/p", "DISSENT", ["Dissent 1", "Grounds"])


def test_words_are_bound_whole():
    assert X.bound(["b", "b c", "zz", "a"], "ab b\tc b  c a") == [(3, 4), (7, 11), None, (12, 13)]


def test_all_atoms_of_all_bills(spark, sf_dir):
    docs = bills(spark, sf_dir)
    sources = {r["doc_id"]: r["xml"] for r in docs.collect()}
    got = {}
    for r in X.atoms(docs, id_col="doc_id", xml_col="xml").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(sources)
    for i, xml in sources.items():
        tree = list(ElementTree.fromstring(xml).iter())
        rows = sorted(got[i], key=lambda r: r["node"])
        assert [(r["tag"], r["text"]) for r in rows] == [(e.tag, (e.text or "") + "".join(c.tail or "" for c in e)) for e in tree]
        for r in rows:
            assert xml[r["start"] : r["end"]].startswith(f"<{r['tag']}>") and xml[r["start"] : r["end"]].endswith(f"</{r['tag']}>")


def test_evenly_spaced_texts_are_bound_without_a_walk_over_words(monkeypatch):
    pieces = ["a\tb", "b", " \n", "a  b c", "x", "c", "b\u00a0c"]
    want = {"a b b a b c c": [(0, 3), (4, 5), None, (6, 11), None, (12, 13), None], "  a b\n\nb a \tb c  c ": [(2, 5), (7, 8), None, (9, 15), None, (17, 18), None], "": [None] * 7}
    assert {text: X.bound(pieces, text) for text in want} == want
    monkeypatch.setattr(X.re, "finditer", None)
    assert X.bound(pieces, "a\nb b a b c c") == want["a b b a b c c"]
