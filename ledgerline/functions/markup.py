"""XML documents as rows: a streaming walk over parser events, and spans of a canonical text that elements stand for.

The parser is fed the document's bytes and reports where each element begins and ends; no tree is built. Documents with a document
type are refused (nothing outside or self-defined is ever expanded), and one that isn't well-formed gives one row with its
error and no others. Null is no document and gives no row."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK, WORD = re.compile("[ \t\n\r\f\v]+"), re.compile("[^ \t\n\r\f\v]")
#: Elements that one Arrow batch holds.
ROWS = 20_000
_ATOM = "node long, parent long, depth int, tag string, path string, ordinal int, start long, end long, text string, headings array<string>, error string"


class _Walk:
    """Elements in the order in which they begin, as dictionaries; ``headings`` are the tags whose text heads their container."""

    def __init__(self, xml: str, headings: frozenset[str]) -> None:
        self.data = xml.encode()
        ascii_only = len(self.data) == len(xml)
        self.chars = None if ascii_only else np.concatenate(([0], np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)))
        self.heads, self.atoms, self.open = headings, [], []
        self.parser = p = expat.ParserCreate("utf-8", namespace_separator=None)
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = self.began, self.ended, self.said, self.refused

    def place(self) -> int:
        at = self.parser.CurrentByteIndex
        return at if self.chars is None else int(self.chars[at])

    def refused(self, *_: object) -> None:
        raise ValueError("a document type is not allowed")

    def began(self, tag: str, _: dict) -> None:
        above = self.open[-1] if self.open else None
        seen = above["seen"] if above else {}
        seen[tag] = seen.get(tag, 0) + 1
        path = f"{above['path'] if above else ''}/{tag}"
        headings = above["headings"] + ([above["heading"]] if above["heading"] else []) if above else []
        atom = {"node": len(self.atoms), "parent": above["node"] if above else None, "depth": len(self.open), "tag": tag, "path": path, "ordinal": seen[tag], "start": self.place(), "said": [], "seen": {}, "headings": headings, "heading": None}
        self.atoms.append(atom)
        self.open.append(atom)

    def said(self, text: str) -> None:
        self.open[-1]["said"].append(text)

    def ended(self, tag: str) -> None:
        atom = self.open.pop()
        at = self.parser.CurrentByteIndex
        close = self.data.find(b">", at) + 1 if self.data[at : at + 2] == b"</" else at
        atom["end"] = close if self.chars is None else int(self.chars[close])
        atom["text"] = "".join(atom.pop("said"))
        if tag in self.heads and self.open:
            self.open[-1]["heading"] = BLANK.sub(" ", atom["text"]).strip(" ")

    def all(self) -> list[dict]:
        try:
            self.parser.Parse(self.data, True)
        except (expat.ExpatError, ValueError) as error:
            return [dict.fromkeys(("parent", "tag", "path", "ordinal", "start", "end", "text")) | {"node": -1, "depth": 0, "headings": [], "error": str(error)}]
        return self.atoms


def walked(xml: str, headings: frozenset[str] = frozenset()) -> list[dict]:
    return _Walk(xml, headings).all()


def atoms(docs: DataFrame, *, id_col: str, xml_col: str, headings: tuple[str, ...] = ()) -> DataFrame:
    """``id`` and one row for each element in source order: its number and its parent's, depth, tag, path of tags, ordinal among
    its siblings of that tag, characters [start, end) of the source, its own text, and the headings of the containers
    it is in, outermost first (a container's last heading before the element)."""
    heads, kind = frozenset(headings), docs.schema[id_col].dataType.simpleString()
    names = [c.split(" ")[0] for c in _ATOM.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, xml in zip(batch.column("id"), batch.column("xml"), strict=True):
                found = walked(xml.as_py(), heads) if xml.is_valid else []
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    ids = pa.array([name.as_py()] * len(part), batch.schema.field("id").type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([a.get(n) for a in part], k) for n, k in zip(names, kinds, strict=True))], names=["id", *names])

    return docs.select(docs[id_col].alias("id"), docs[xml_col].alias("xml")).mapInArrow(run, f"id {kind}, {_ATOM}").withColumnRenamed("id", id_col)


def _plain(text: str) -> str:
    """``text`` with a blank for each character of white space."""
    for c in "\t\n\r\f\v":
        text = text.replace(c, " ")
    return text


def bound(pieces: list[str], text: str) -> list[tuple[int, int] | None]:
    """Where the pieces stand in ``text``, one after the other: each at the first place after the piece before that has its words,
    white space aside; None where there is none. Pieces without words stand nowhere."""
    flat = f" {_plain(text)} "
    spots = begins = None
    if "  " in flat:  # else a place in flat is one in text
        spots = [(m.start(), m.end()) for m in re.finditer("[^ \t\n\r\f\v]+", text)]
        flat = "".join(f" {text[a:b]}" for a, b in spots) + " "
        begins = list(accumulate((b - a + 1 for a, b in spots), initial=0))  # where each word's blank stands in flat
    out, after = [], 0
    for piece in pieces:
        words = _plain(piece)
        if "  " in f" {words} ":
            words = " ".join(w for w in words.split(" ") if w)
        at = flat.find(f" {words} ", after) if words else -1
        if at < 0:
            out.append(None)
            continue
        after = at + len(words) + 1
        out.append((spots[bisect_left(begins, at)][0], spots[bisect_left(begins, after) - 1][1]) if spots else (at, after - 1))
    return out


def structural_spans(docs: DataFrame, *, id_col: str, xml_col: str, text_col: str, headings: tuple[str, ...] = (), dissent: tuple[str, ...] = ()) -> DataFrame:
    """``id, node, path, headings, scope, start, end, state``: each element with words of its own, bound to its exact characters of the
    canonical text. state is BOUND, UNBOUND or, for a document that can't be read, INVALID; scope is DISSENT inside one of the
    elements ``dissent``, else MAIN. Repeated texts are bound in source order."""
    heads, apart, kind = frozenset(headings), frozenset(dissent), docs.schema[id_col].dataType.simpleString()
    fields = {"node": pa.int64(), "path": pa.string(), "headings": pa.list_(pa.string()), "scope": pa.string(), "start": pa.int64(), "end": pa.int64(), "state": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, xml, text in zip(*(batch.column(c).to_pylist() for c in ("id", "xml", "text")), strict=True):
                if xml is None:
                    continue
                found = walked(xml, heads)
                if found[0].get("error"):
                    rows = [(-1, None, [], None, None, None, "INVALID")]
                else:
                    own = [a for a in found if WORD.search(a["text"])]
                    spans = bound([a["text"] for a in own], text or "")
                    scope = lambda a: "DISSENT" if apart & set(a["path"].split("/")) else "MAIN"
                    rows = [(a["node"], a["path"], a["headings"], scope(a), *(s or (None, None)), "BOUND" if s else "UNBOUND") for a, s in zip(own, spans, strict=True)]
                for at in range(0, len(rows), ROWS):
                    cols = zip(*rows[at : at + ROWS], strict=True)
                    ids = pa.array([name] * len(rows[at : at + ROWS]), batch.schema.field("id").type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, fields.values(), strict=True))], names=["id", *fields])

    rows = docs.select(docs[id_col].alias("id"), docs[xml_col].alias("xml"), docs[text_col].alias("text"))
    schema = f"id {kind}, node long, path string, headings array<string>, scope string, start long, end long, state string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
