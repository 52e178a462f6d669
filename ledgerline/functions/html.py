"""HTML that regular expressions can't handle: an allow-list, balanced tags, and highlights. Vectorised functions around small
helpers that work on one page or one snippet at a time."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

ALLOWED = {"p": (), "b": (), "i": (), "em": (), "strong": (), "ul": (), "ol": (), "li": (), "h1": (), "h2": (), "h3": (), "table": (), "tr": (), "td": ("colspan",), "th": ("colspan",), "a": ("href",), "br": ()}
VOID = ("br", "hr", "img", "input", "meta", "link")
SILENT = ("script", "style")


#: Pages that a task holds as Python objects.
PAGES = 64


def _by_page(f: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """``f`` of each row of an Arrow batch, PAGES rows at a time: of the rest of a batch there are only Arrow's own bytes."""
    slices = ([x.slice(at, PAGES).to_pylist() for x in columns] for at in range(0, len(columns[0]), PAGES))
    parts = [pa.array([f(*row) for row in zip(*rows, strict=True)], pa.string()) for rows in slices]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


class _Cleaner(HTMLParser):
    """Writes what is allowed, closes what stays open, and drops end tags that close nothing."""

    def __init__(self, allowed: dict[str, tuple[str, ...]]) -> None:
        super().__init__(convert_charrefs=True)
        self.allowed, self.out, self.open, self.muted = allowed, [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.muted += 1
        elif tag in self.allowed and not self.muted:
            kept = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if k in self.allowed[tag] and not re.match(r"(?i)\s*(javascript|data):", v or ""))
            self.out.append(f"<{tag}{kept}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.muted = max(0, self.muted - 1)
        elif tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.out.append(escape(data, quote=False))

    def result(self) -> str:
        self.close()
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def cleaned(html: str | None, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> str | None:
    if html is None:
        return None
    cleaner = _Cleaner(allowed)
    cleaner.feed(html)
    return cleaner.result()


@arrow_udf(StringType())
def sanitised(pages: pa.Array) -> pa.Array:
    """Only allowed tags and attributes, nothing of scripts and styles, every open tag closed."""
    return _by_page(cleaned, pages)


def located(html: str, snippet: str) -> tuple[int, int] | None:
    """Where a snippet of text first stands in a page, tags between its words skipped and white space of any width; what lies
    within a tag or an entity is no text."""
    words = [re.escape(escape(w, quote=False)) for w in snippet.split()]
    if not words:
        return None
    wanted = r"(?:\s|&nbsp;|<[^>]*>)+".join(words)
    for found in re.finditer(f"(?P<hit>{wanted})|<[^>]*>|&[A-Za-z0-9#]+;", html):
        if found["hit"]:
            return found.start(), found.end()
    return None


def highlighted(html: str | None, snippets: list[str] | None) -> str | None:
    """The page with each snippet in a ``<mark>``, longer ones first; one that would overlap a mark, or isn't there, is left out."""
    if html is None:
        return None
    taken: list[tuple[int, int]] = []
    for snippet in sorted(set(snippets if snippets is not None else []), key=lambda s: (-len(s), s)):
        place = located(html, snippet)
        if place and all(place[1] <= a or place[0] >= b for a, b in taken):
            taken.append(place)
    out, at = [], 0
    for a, b in sorted(taken):
        inner = re.sub(r"(<[^>]*>)", r"</mark>\1<mark>", html[a:b])
        out += [html[at:a], f"<mark>{inner}</mark>"]
        at = b
    return "".join(out).replace("<mark></mark>", "") + html[at:]


@arrow_udf(StringType())
def marked(pages: pa.Array, snippets: pa.Array) -> pa.Array:
    return _by_page(highlighted, pages, snippets)


def text_of(html: str) -> str:
    return unescape(re.sub(r"<[^>]*>", "", html))
