"""Filing HTML and XHTML to block-aware text in one Arrow stage per batch of documents.

Documents that say they are XML are read by their namespaces: what is hidden by the
inline or instance vocabulary goes whatever its prefix, and CDATA is text. One that is
not well-formed is read as HTML instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: tags that end a line
BLOCK_TAGS = frozenset("address article blockquote br div h1 h2 h3 h4 h5 h6 li p section tr".split())
DROPPED = frozenset(("script", "style", "noscript", "svg", "ix:header", "ix:hidden", "xbrli:context", "xbrli:unit"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# fixed values: how far a document's beginning is looked at, and what there tells XML
PROLOGUE, XML_SIGNS = 4096, ("xmlns:ix=", 'xmlns="http://www.w3.org/1999/xhtml"', "<ix:")
_NAMESPACES = ((re.compile(r"^http://www\.xbrl\.org/\d{4}/inlineXBRL"), "ix:"), (re.compile(r"^http://www\.xbrl\.org/2003/instance$"), "xbrli:"))
_PLAIN = ("", "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg")
_ENTITY = re.compile(r"<!\[CDATA\[.*?\]\]>|&([A-Za-z][A-Za-z0-9]*);", re.DOTALL)
_XML_ENTITIES = ("amp", "lt", "gt", "quot", "apos")
_NUMBER = re.compile(r"^\(?[\s$€£¥]*[\d][\d,.\s]*\)?\s*%?$|^[-–—]$")


@dataclass(frozen=True)
class Line:
    """A line of visible text, whether it is styled as a heading, and the anchors of the tags around it."""

    text: str
    heading: bool = False
    anchors: frozenset[str] = frozenset()


def _styled_heading(tag: str, given: dict[str, str | None], style: str) -> bool:
    weight = re.search(r"font-weight:(\d{3})", style)
    return (
        tag in ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b") or (given.get("role") or "").lower() == "heading" or "font-weight:bold" in style or "text-align:center" in style
        or bool(weight and int(weight[1]) >= 600) or bool(re.search(r"(?:^|[-_\s])(?:heading|title)(?:$|[-_\s])", given.get("class") or "", re.IGNORECASE))
    )


class _Reader(HTMLParser):
    """Collects text by blocks with its signals; drops invisible parts and grids of numbers. None ends a line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list[tuple[str, bool, frozenset[str]] | None]] = [[]]
        self.skip: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.open: list[tuple[str, bool, str | None]] = []
        self.ids: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        given = dict(attrs)
        style = re.sub(r"\s", "", (given.get("style") or "").lower())
        hidden = "display:none" in style or "visibility:hidden" in style or "hidden" in given or given.get("aria-hidden") == "true"
        if tag in DROPPED or hidden:
            if tag not in VOID:
                self.skip.append(tag)
            return
        anchor = given.get("id") or given.get("name")
        if anchor:
            self.ids[anchor] += 1
        if tag not in VOID:
            self.open.append((tag, _styled_heading(tag, given, style), anchor))
        if tag == "table":
            self.out.append([])
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
        if tag in BLOCK_TAGS:
            self.out[-1].append(None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.skip and tag in BLOCK_TAGS:
            self.out[-1].append(None)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCK_TAGS:
            self.out[-1].append(None)
        if tag == "table" and self.tables:
            grid, inner = self.tables.pop(), self.out.pop()
            if not is_data_grid(grid):
                self.out[-1] += [None, *inner, None]

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out[-1].append((data, any(h for _, h, _ in self.open), frozenset(a for _, _, a in self.open if a)))
            if self.tables and self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += data


def says_xml(text: str) -> bool:
    start = text.lstrip("\ufeff \t\r\n")[:PROLOGUE].lower()
    return start.startswith("<?xml") or any(sign in start for sign in XML_SIGNS)


def _tag(name: str) -> str:
    """A qualified name of expat as the reader knows tags: known vocabularies by their usual prefix, others by none of ours."""
    space, _, local = name.rpartition(" ")
    if space in _PLAIN:
        return local.lower()
    return next((prefix + local.lower() for pattern, prefix in _NAMESPACES if pattern.search(space)), f"other:{local.lower()}")


def _read_xml(text: str) -> _Reader:
    """The reader after all of a well-formed document; raises ExpatError if it is none."""
    reader, parser = _Reader(), expat.ParserCreate(namespace_separator=" ")

    def declared(*_: object) -> None:
        raise expat.ExpatError("documents do not define entities")

    def started(name: str, attributes: dict[str, str]) -> None:
        # attributes of other vocabularies are not those of the page
        reader.handle_starttag(_tag(name), [(k.lower(), v) for k, v in attributes.items() if " " not in k])

    parser.StartElementHandler, parser.EndElementHandler = started, lambda name: reader.handle_endtag(_tag(name))
    parser.CharacterDataHandler, parser.EntityDeclHandler, parser.buffer_text = reader.handle_data, declared, True
    known = lambda m: m[0] if m[1] is None or m[1] in _XML_ENTITIES else html5.get(f"{m[1]};", m[0])
    parser.Parse(_ENTITY.sub(known, text.lstrip("\ufeff \t\r\n")), True)
    return reader


def _read(text: str) -> _Reader:
    if says_xml(text):
        try:
            return _read_xml(text)
        except expat.ExpatError:
            pass
    reader = _Reader()
    reader.feed(text)
    reader.close()
    return reader


def complete_references(html: str | Column) -> Column:
    """The markup with each ``&`` that begins no reference with a semicolon as ``&amp;``: readers then leave it and what follows as text.

    HTML reads ``&amp`` without its semicolon as a reference too, patterns over references do not.
    """
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(html, r"&(?!#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;)", "&amp;")


def is_data_grid(rows: list[list[str]]) -> bool:
    """A table of figures: three rows, nine cells, two rows of three columns, a fifth of the cells numeric and none long."""
    cells = [re.sub(r"\s+", " ", c).strip() for r in rows for c in r]
    full = [c for c in cells if c]
    numeric = sum(bool(_NUMBER.match(c)) for c in full)
    return len(rows) >= 3 and len(cells) >= 9 and sum(
        len(r) >= 3 for r in rows
    ) >= 2 and numeric >= max(3, len(full) // 5) and max(map(len, full), default=0) < 500


def read_lines(html: str | None) -> list[Line]:
    """The visible lines of a document; anchors that stand twice in it are left out."""
    reader = _read(html or "")
    out, held = [], []
    for piece in [*(p for part in reader.out for p in part), None]:
        if piece is not None:
            held.append(piece)
            continue
        text = re.sub(r"\s+", " ", " ".join(p[0] for p in held)).strip()
        if text:
            told = [p for p in held if p[0].strip()]
            anchors = frozenset(a for a in frozenset().union(*(p[2] for p in told)) if reader.ids[a] == 1)
            out.append(Line(text, all(p[1] for p in told), anchors))
        held = []
    return out


def visible_text(html: str | None) -> str:
    return "\n".join(line.text for line in read_lines(html))


def to_text(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([visible_text(h) for h in batch.column(1).to_pylist()], pa.string())],
                ["doc", "text"]
            )

    return docs.select(id_col, F.col(html_col)).mapInArrow(
        run, f"doc {docs.schema[id_col].dataType.simpleString()}, text string"
    )
