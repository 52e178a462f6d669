"""Archives: exact round trips, revisits, seeking single records, the file format, odd rows."""

import base64
import hashlib
import struct
from collections import defaultdict

import zstandard
from pyspark.sql import functions as F

from ledgerline.llm import common, warc
from ledgerline.llm.warc import Bundle, archive, lookup, read_archive, records, seek_table, storage


def plain(pages, least):
    """Rows (id, size, digest, type, refers to) of the whole table."""
    of = defaultdict(list)
    for k, (i, _, html) in enumerate(pages):
        of[html or ""].append((i is None, i or 0, k))
    out = []
    for html, group in of.items():
        data = html.encode()
        told = len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()
        for n, (_, _, k) in enumerate(sorted(group)):
            again = n and len(data) >= least
            out.append((pages[k][0], *told, "revisit" if again else "response", pages[min(group)[2]][0] if again else None))
    return sorted(out, key=repr)


def check(spark, pages, least=0):
    frame = spark.createDataFrame([(*p, 3, "x", "y") for p in pages], "page_id long, url string, html string, row int, slot string, first string").repartition(3)
    index = archive(frame, least=least)
    got = read_archive(index).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == plain(pages, least)
    assert index.count() == len(pages)
    texts = {(i, h or "") for i, _, h in pages}
    assert all((r.page_id, r.html) in texts for r in got if r.record_type == "response")
    return index, got


def test_odd_pages(spark):
    pages = [(1, "http://a/ü?x=1 2\r\nX: y", "<p>é</p>"), (2, None, ""), (3, "u", None), (4, "v", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "lost"), (9, "w", "x" * 3_000_000), (5, "z", "x" * 3_000_000), (5, "z", "x" * 3_000_000)]
    pages += [(k, f"http://h/{k}", "the same page") for k in range(100, 160)] + [(None, None, "the same page")] * 2
    index, got = check(spark, pages)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%C3%BC?x=1%202%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 2} == {None}
    check(spark, pages, least=14)
    check(spark, [])
    wanted = index.filter("page_id IN (1, 4, 9, 130)").select("record_id")
    one = {r.page_id: r for r in lookup(index, wanted.union(wanted)).collect()}
    assert {i: (r.record_type, r.refers_to, r.html) for i, r in one.items()} == {1: ("response", None, "<p>é</p>"), 4: ("response", None, pages[3][2]), 9: ("revisit", 5, None), 130: ("revisit", 100, None)}


def test_format(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 100)
    bundle = Bundle(str(tmp_path))
    bodies = [b"a" * 60, b"b" * 30, b"c" * 500, b"d"]
    assert [bundle.add(b) for b in bodies] == [(0, 0), (0, 60), (1, 0), (2, 0)]
    bundle.close()
    raw = open(bundle.where, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(bodies)  # any decoder reads it
    assert struct.unpack("<I", raw[-4:]) == (0x8F92EAB1,) and raw.index(struct.pack("<I", 0x184D2A5E)) == len(raw) - 9 - 24 - 8
    system, path = storage(bundle.where)
    with system.open_input_file(path) as data:
        assert [warc.frame(data, *x) for x in seek_table(data)] == [b"a" * 60 + b"b" * 30, b"c" * 500, b"d"]


def test_records_of_a_frame():
    made = [warc._record(f"<urn:page:{k}:{k}>", "u", b"body\r\n\r\n" * k, None if k else "<urn:page:7:7>", "2024-01-01T00:00:00Z") for k in range(4)]
    found = list(records(b"".join(made)))
    assert [at for at, _, _ in found] == [sum(map(len, made[:k])) for k in range(4)]
    assert [warc._parsed(f, b)[6] for _, f, b in found] == [None, "body\r\n\r\n", "body\r\n\r\n" * 2, "body\r\n\r\n" * 3]


def test_whole_table(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    check(spark, pages)


def test_marks_join_without_a_shuffle(spark, monkeypatch):
    for chunk in (16, 1 << 14):
        monkeypatch.setattr(common, "CHUNK", chunk)
        stored = common.Numbered(spark.range(1000).repartition(7).withColumn("mark_", F.lit("x")), "numbers")
        marks = stored.table.filter("id % 3 = 0").select("row", (F.col("id") * 2).alias("twice"), F.lit(1).alias("one"))
        both = stored.marked(marks)
        assert both.count() == 1000 and both.filter("mark.twice = 2 * id AND mark.one = 1").count() == 334 and both.filter("mark IS NULL").count() == 666
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert stored.table.select("slot").distinct().count() == 7
        assert stored.marked(marks.limit(0)).filter("mark IS NULL").count() == 1000
