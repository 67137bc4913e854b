"""Parsers of single documents: bytes or text to the text of blocks.  Standard library only."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import math
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from itertools import groupby, islice, pairwise
from xml.etree import ElementTree

# ------------------------------------------------------------------------------------ tables, csv


def markdown_table(rows: list[list[str]], escape: bool = False) -> str:
    """The first row is the head; rows keep their own lengths."""
    if not rows:
        return ""

    def line(cells):
        return "| " + " | ".join(c.replace("|", "\\|") if escape else c for c in cells) + " |"

    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


# Fields may be as long as their documents.
csv.field_size_limit(2**31 - 1)


def _rows(text: str, sign: str) -> Iterator[list[str]]:
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sign) if r and r != [""])


def delimiter_of(text: str) -> str:
    """The sign under which the widths of the first ten rows change least from row to row.

    It has to make two fields a row on average; a sign further down the list needs more of them than
    the one before it, with no more change.  Rows are read whole, however long."""
    best, wide, change = ",", 1.99, math.inf
    for sign in (",", "\t", "|", ";", "\x1e", "\x1f"):
        widths = [len(r) for r in islice(_rows(text, sign), 10)]
        if not widths:
            continue
        mean, changes = sum(widths) / len(widths), sum(abs(x - y) for x, y in pairwise(widths))
        if mean > wide and changes <= change:
            best, wide, change = sign, mean, changes
    return best


def csv_table(text: str, escape: bool = False) -> str:
    text = text.removeprefix("﻿")
    return markdown_table(list(_rows(text, delimiter_of(text))), escape)


# ------------------------------------------------------------------------------------------- html

# Elements that stand in lines of their own, and the line feeds around them.
_AROUND = {"p": 2, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "ul": 2, "ol": 2, "table": 2, "pre": 2, "blockquote": 2, "hr": 2, "dl": 2}
_LINES = frozenset("div section article header footer main nav aside address form fieldset figure figcaption li dt dd tr body html center details summary".split())
_DROPPED = frozenset("script style head title noscript template img iframe svg object select textarea button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    """Text with blank lines around paragraphs; tables as aligned columns."""

    def __init__(self, tables: bool):
        super().__init__(convert_charrefs=True)
        self.tables, self.out, self.gap = tables, [], 0
        #: Open elements, how many of each name, and the depth of the outermost dropped one.
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.skip: int | None = None
        self.lists: list[int | None] = []
        self.grids: list[list[list[list[str]]]] = []
        self.pre = 0

    def _sink(self) -> list[str]:
        if self.grids and self.grids[-1] and self.grids[-1][-1]:
            return self.grids[-1][-1][-1]
        return self.out

    def _break(self, n: int) -> None:
        sink = self._sink()
        if sink is not self.out:
            if sink and not sink[-1].endswith(" "):
                sink.append(" ")
        else:
            self.gap = max(self.gap, n)

    def _write(self, text: str) -> None:
        sink = self._sink()
        if sink is self.out and self.gap:
            if self.out:
                self.out[-1] = self.out[-1].rstrip(" ")
                self.out.append("\n" * self.gap)
            self.gap = 0
            text = text.lstrip(" ") if not self.pre else text
        if text.startswith(" ") and not self.pre and (not sink or sink[-1][-1:] in (" ", "\n", "")):
            text = text[1:]
        if text:
            sink.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.count["head"]:
            self.handle_endtag("head")
        if tag not in _VOID:
            self.open.append(tag)
            self.count[tag] += 1
            if tag in _DROPPED and self.skip is None:
                self.skip = len(self.open) - 1
        if self.skip is not None or tag in _DROPPED:
            return
        if tag == "br":
            self._break(1)
        elif tag == "table" and self.tables:
            self._break(2)
            self.grids.append([])
        elif tag == "tr" and self.grids:
            self.grids[-1].append([])
        elif tag in ("td", "th") and self.grids:
            if not self.grids[-1]:
                self.grids[-1].append([])
            self.grids[-1][-1].append([])
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self._break(1)
            mark = " * "
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f" {self.lists[-1]}. "
            self._write("   " * max(0, len(self.lists) - 1) + mark.lstrip() if self._sink() is not self.out else mark)
        elif tag == "hr":
            self._break(2)
            self._write("-" * 40)
            self._break(2)
        elif tag in _AROUND or tag in _LINES:
            self._break(_AROUND.get(tag, 1))
            self.pre += tag == "pre"

    def handle_endtag(self, tag):
        if self.count[tag]:
            while (last := self.open.pop()) != tag:
                self.count[last] -= 1
            self.count[tag] -= 1
            # a dropped element without an end of its own ends with the one around it
            if self.skip is not None and len(self.open) <= self.skip:
                self.skip = None
        if self.skip is not None or tag in _DROPPED:
            return
        if tag == "table" and self.tables and self.grids:
            grid = self.grids.pop()
            self._write(_columns([["".join(c).strip() for c in row] for row in grid if row]))
            self._break(2)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag in _AROUND or tag in _LINES:
            self.pre -= tag == "pre" and self.pre > 0
            self._break(_AROUND.get(tag, 1))

    def handle_data(self, data):
        if self.skip is None:
            self._write(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))

    def text(self) -> str:
        while self.grids:
            self.handle_endtag("table")
        return "".join(self.out).strip(" \n")


def _columns(rows: list[list[str]], between: int = 3) -> str:
    """Cells padded to their columns."""
    width = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return "\n".join((" " * between).join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows)


def html_text(html: str, preserve_tables: bool = True) -> str:
    """Text of a page: no wrapping, links by their text, no images, tables in aligned columns."""
    parser = _Text(preserve_tables)
    # an unclosed paragraph or item ends where the next begins
    parser.feed(html)
    parser.close()
    return parser.text()


# ------------------------------------------------------------------------------------------- mail


def email_text(data: bytes, headers: bool = True) -> str:
    """Header lines that are there, a blank line, and the plain body, or else the text of the HTML one."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    out = []
    if headers:
        for name in ("From", "To", "Subject"):
            if m[name]:
                out.append(f"{name}: {m[name]}")
        if m["Date"]:
            try:
                when = parsedate_to_datetime(str(m["Date"]))
                out.append("Date: " + when.astimezone(_utc()).strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z")
            except (TypeError, ValueError):
                pass
        out.append("")
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content().replace("\r\n", "\n") if body else ""
    return "\n".join([*out, html_text(text) if body and body.get_content_subtype() == "html" else text])


def _utc():
    from datetime import timezone

    return timezone.utc


# ------------------------------------------------------------------------------------ office files

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n


def xlsx_sheets(data: bytes, sheets="all", escape: bool = False) -> list[tuple[str, str]]:
    """(name, markdown table) of the wanted sheets; ids count from 1."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    strings = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            strings.append("".join(t.text or "" for t in si.iter(_S + "t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
        number = int(sheet.get("sheetId"))
        if sheets == "first" and number > 1 or not isinstance(sheets, str) and number not in sheets:
            continue
        path = targets[sheet.get(_R + "id")].lstrip("/")
        rows = []
        for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else "xl/" + path)).iter(_S + "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(_S + "c"), 1):
                v, kind = c.find(_S + "v"), c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_S + "t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    value = strings[int(v.text)]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                else:
                    value = v.text
                cells[_column_number(c.get("r", "")) or k] = value
            if cells:
                rows.append([cells.get(k, "") for k in range(1, max(cells) + 1)])
        out.append((sheet.get("name"), markdown_table(rows, escape)))
    return out


#: Signs that mean something in markdown.
_MARKS = re.compile(r"[\\`*_{}\[\]()#+\-.!]")


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")


def _value(e: ElementTree.Element | None, path: str = "", default: str | None = None) -> str | None:
    """Attribute val of the element at ``path`` below ``e``."""
    found = e.find("/".join(_W + p for p in path.split("/"))) if e is not None and path else e
    return default if found is None else found.get(_W + "val", default)


def _ordered_levels(z: zipfile.ZipFile) -> dict[tuple[str, str], bool]:
    """(list, level) -> whether it counts."""
    root = _part(z, "word/numbering.xml")
    kinds = {a.get(_W + "abstractNumId"): {v.get(_W + "ilvl"): _value(v, "numFmt") for v in a.iter(_W + "lvl")} for a in root.iter(_W + "abstractNum")}
    return {(n.get(_W + "numId"), level): kind not in ("bullet", "none", None) for n in root.iter(_W + "num") for level, kind in kinds.get(_value(n, "abstractNumId"), {}).items()}


def _run_text(run: ElementTree.Element) -> str:
    shown = {_W + "tab": "\t", _W + "br": "  \n"}
    return "".join(shown.get(t.tag) or _MARKS.sub(r"\\\g<0>", t.text or "") for t in run if t.tag == _W + "t" or t.tag in shown)


def _inline(p: ElementTree.Element, links: dict[str, str]) -> str:
    """Runs of a paragraph; neighbours of one style are marked together."""
    runs = []
    for child in p:
        href = links.get(child.get(_R + "id")) if child.tag == _W + "hyperlink" else None
        for r in child.iter(_W + "r"):
            on = [_value(r, f"rPr/{k}", "1") if r.find(f"{_W}rPr/{_W}{k}") is not None else "0" for k in ("b", "i")]
            if text := _run_text(r):
                runs.append((href, *(x not in ("0", "false") for x in on), text))
    out = ""
    for href, linked in groupby(runs, key=lambda r: r[0]):
        text = ""
        for (_, bold, italic), same in groupby(linked, key=lambda r: r[:3]):
            mark = "__" * bold, "*" * italic
            text += "".join(mark) + "".join(r[3] for r in same) + "".join(reversed(mark))
        out += f"[{text}]({href})" if href else text
    return out


def docx_markdown(data: bytes) -> str:
    """Paragraphs as markdown: headings, bold, italic, links, bullets and counted lists; signs escaped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    links = {r.get("Id"): r.get("Target") for r in _part(z, "word/_rels/document.xml.rels") if r.get("TargetMode") == "External"}
    ordered = _ordered_levels(z)
    counts: list[int] = []  # items of the open list, by depth
    joined, before = "", None
    for p in _part(z, "word/document.xml").iter(_W + "p"):
        text = _inline(p, links)
        if not text.strip():
            continue
        props = p.find(_W + "pPr")
        level = re.fullmatch(r"[Hh]eading\s?([1-6])", _value(props, "pStyle", ""))
        listed = props is not None and props.find(_W + "numPr") is not None
        if level:
            text = "#" * int(level[1]) + " " + text
        if level or not listed:
            counts, listed = [], False
        else:
            at = _value(props, "numPr/ilvl", "0")
            counts = [*counts[: int(at) + 1], *[0] * (int(at) + 1 - len(counts))]
            counts[-1] += 1
            bullet = f"{counts[-1]}." if ordered.get((_value(props, "numPr/numId"), at)) else "-"
            text = "\t" * int(at) + f"{bullet} {text}"
        joined += ("" if before is None else "\n" if listed and before else "\n\n") + text
        before = listed
    return joined


# -------------------------------------------------------------------------------------------- pdf

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n", re.S)
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\d|\s+\d+\s+R)")
_STREAM_END = re.compile(rb"\s*endstream")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]\s*TJ|T\*|(?:-?[\d.]+\s+){2}T[dD]|ET", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(data: bytes) -> bytes | None:
    """A deflated stream without what follows its end, or None if it is damaged or has none."""
    unpack = zlib.decompressobj()
    try:
        found = unpack.decompress(data)
    except zlib.error:
        return None
    return found if unpack.eof else None


def _streams(data: bytes):
    """Contents of the streams, inflated.

    A stream has its /Length if endstream follows there, else it ends before endstream.  Its last byte
    can look like a line end, so deflated ones end where their own format says so."""
    m = _STREAM.search(data)
    while m:
        start, packed = m.end(), b"FlateDecode" in m[1]
        lengths = _LENGTH.findall(m[1])
        end = start + int(lengths[-1]) if lengths else -1
        if end < 0 or not _STREAM_END.match(data, end):
            end = data.find(b"endstream", start)
        if end < 0:
            return
        body = _inflated(data[start:end]) if packed else data[start:end]
        if body is not None:
            yield body
        m = _STREAM.search(data, end)


def pdf_text(data: bytes) -> str:
    """Text of plain content streams; pages (streams) and lines joined by line feeds, trimmed.

    Fonts with their own encodings need an injected extractor (``NormalizeConfig.pdf_text``)."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages = []
    for body in _streams(data):
        if b"BT" not in body:
            continue
        lines = [""]
        for m in _SHOWN.finditer(body):
            op = m.group()
            if op.startswith((b"(", b"[")):
                for s in _STRING.findall(op):
                    s = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), s, flags=re.S)
                    lines[-1] += s.decode("cp1252", "replace")
            elif lines[-1]:
                lines.append("")
        pages.append("\n".join(x for x in lines if x))
    return "\n".join(pages).strip()
