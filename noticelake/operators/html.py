"""HTML pages to rows: the only per-page Python, kept to cutting pages into texts inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Marks of the tables read (fixed values).
TABLE_CLASS = "tabla_en_texto"
LISTING_ID = "resultadoConsulta"
NEXT_CLASS = "nextPage"
# End of fixed values.

_BLOCKS = ("p", "pre", "div")
_SECTIONS = ("thead", "tbody", "tfoot")
_ENDS_PARAGRAPH = (*_BLOCKS, "table", "h5")
_SKIPPED = ("script", "style")


class _NoticeParser(HTMLParser):
    """Title, h5 headings, text of block elements and the cells of the notice tables.

    Each section of a notice table is a table of its own, with its own header. ``body[j]`` is the text of the blocks that open
    behind ``j`` tables.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.headings: list[list[str]] = []
        self.body: list[list[str]] = [[]]
        self.tables: list[list[list[list[str]]]] = []
        self._open: str | None = None
        self._blocks: list[str] = []
        self._behind = 0  # tables before the outermost open block
        self._depth = 0  # tables open inside the notice table, itself included
        self._section = False
        self._cell = False
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_PARAGRAPH and self._blocks and self._blocks[-1] == "p":
            self._blocks.pop()
        if tag in _SKIPPED:
            self._skip += 1
        elif tag == "title":
            self.title, self._open = [], "title"
        elif tag == "h5":
            self.headings.append([])
            self._open = "h5"
        elif tag in _BLOCKS:
            if not self._blocks:
                self._behind = len(self.tables)
            self._blocks.append(tag)
        elif tag == "table":
            if self._depth:
                self._depth += 1
            elif dict(attrs).get("class") == TABLE_CLASS:
                self._depth, self._section = 1, False
        elif self._depth == 1 and tag in _SECTIONS:
            self._start_section()
        elif self._depth == 1 and tag == "tr":
            if not self._section:
                self._start_section()
            self.tables[-1].append([])
            self._cell = False
        elif self._depth == 1 and tag in ("td", "th"):
            self._cell = tag == "td" and self._section and bool(self.tables[-1])
            if self._cell:
                self.tables[-1][-1].append([])

    def _start_section(self) -> None:
        self.tables.append([])
        self.body.append([])
        self._section, self._cell = True, False

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag in ("title", "h5"):
            self._open = None
        elif tag in self._blocks:
            while self._blocks.pop() != tag:
                pass
        elif tag == "table" and self._depth:
            self._depth -= 1
            self._cell = self._cell and self._depth > 0
        elif self._depth == 1 and tag in _SECTIONS:
            self._section = self._cell = False
        elif self._depth == 1 and tag in ("td", "tr"):
            self._cell = False

    def handle_data(self, data):
        text = data.strip()
        if not text or self._skip:
            return
        if self._open == "title":
            self.title.append(text)
        elif self._open == "h5":
            self.headings[-1].append(text)
        if self._cell:
            self.tables[-1][-1][-1].append(text)
        elif self._blocks:
            self.body[self._behind].append(text)


class _ListingParser(HTMLParser):
    """Entries of a search result and the query of its next page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries: list[dict[str, list[str] | str]] = []
        self.next = ""
        self._inside = False
        self._link = False
        self._field: str | None = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "tbody" and values.get("id") == LISTING_ID:
            self._inside = True
        elif self._inside and tag == "tr":
            self.entries.append({"href": "", "title": [], "subtitle": []})
        elif self._inside and self.entries and tag == "a":
            self._link = True
            self.entries[-1]["href"] = values.get("href") or ""
        elif self._inside and self._link and tag == "strong":
            self._field = "title"
        elif self._inside and self.entries and not self._link and tag == "font":
            self._field = "subtitle"
        if tag == "a" and not self._inside and values.get("class") == NEXT_CLASS and values.get("href"):
            self.next = urlsplit(values["href"]).query

    def handle_endtag(self, tag):
        if tag == "tbody":
            self._inside = False
        elif tag == "a":
            self._link = False
        elif tag in ("strong", "font"):
            self._field = None

    def handle_data(self, data):
        text = data.strip()
        if text and self._inside and self._field and self.entries:
            self.entries[-1][self._field].append(text)


# A tag as most pages have them, and the text behind it.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z-]+="[^"<>&]*")*)[ \t\n\r\f]*>([^<]*)""")
_ATTRIBUTE = re.compile(r'([a-zA-Z-]+)="([^"]*)"')
#: Elements whose text is read by rules of its own.
_RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _plain_tags(html: str) -> list[tuple[bool, str, list[tuple[str, str]], str]] | None:
    """(closing, tag, attributes, text behind) of a page that is all plain tags and text; None for any other page."""
    found, at, title = [], 0, False
    for m in _TAG.finditer(html):
        closing, tag, attributes, text = m.groups()
        tag = tag.lower()
        if m.start() != at or tag in _RAW or (closing and attributes) or (title and not (closing and tag == "title")):
            return None
        at, title = m.end(), tag == "title" and not closing
        given = [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else []
        found.append((bool(closing), tag, given, unescape(text) if "&" in text else text))
    return found if at == len(html) and found and not found[-1][3] else None


def _parse(parser: HTMLParser, html: str | None):
    """Feed a page to a parser; one of plain tags only is cut by one expression, several times as fast."""
    tags = _plain_tags(html or "")
    if tags is None:
        parser.feed(html or "")
        parser.close()
        return parser
    for closing, tag, attributes, text in tags:
        if closing:
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, attributes)
        if text:
            parser.handle_data(text)
    return parser


def _map_pages(pages: DataFrame, keep: Sequence[str], fields: list[T.StructField], column: str, rows_of) -> DataFrame:
    """Replace the page text by the rows ``rows_of`` makes of it, keeping other columns."""
    kept = pages.select(*keep, column)
    schema = T.StructType([*kept.schema.fields[:-1], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            values: dict[str, list] = {n: [] for n in names}
            for i, html in enumerate(batch.column(len(keep)).to_pylist()):
                for row in rows_of(html):
                    index.append(i)
                    for n in names:
                        values[n].append(row[n])
            taken = batch.select(list(keep)).take(pa.array(index, pa.int64())) if keep else None
            columns = list(taken.columns) if taken is not None else []
            columns += [pa.array(values[f.name], _arrow_type(f.dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return kept.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return pa.list_(_arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else pa.string()


_TEXTS = T.ArrayType(T.StringType())
_NOTICE = [
    T.StructField("title", T.StringType()),
    T.StructField("headings", _TEXTS),
    T.StructField("body", _TEXTS),
    T.StructField("tables", T.ArrayType(T.ArrayType(_TEXTS))),
]
_LISTING = [
    T.StructField("title", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("subtitle", T.StringType()),
    T.StructField("next_query", T.StringType()),
]


def _notice_rows(html: str | None, references: Sequence[str] | None = None) -> list[dict]:
    if html is None:
        return [{f.name: None for f in _NOTICE}]
    if references is not None:  # every other ampersand is text
        html = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)" if references else "&", "&amp;", html)
    page = _parse(_NoticeParser(), html)
    return [
        {
            "title": " ".join(page.title),
            "headings": [" ".join(h) for h in page.headings],
            "body": [" ".join(b) for b in page.body],
            "tables": [[[" ".join(c) for c in row] for row in table] for table in page.tables],
        }
    ]


def notice_texts(
    pages: DataFrame, keep: Sequence[str], column: str = "html", references: Sequence[str] | None = None
) -> DataFrame:
    """(…keep, title, headings, body array<text>, tables array<array<array<text>>>) of each page.

    A NULL page has NULL in all of them. Character references are read as HTML has them, also without their semicolon; given a
    list of names such as ``amp``, only those with a semicolon are, and the others stay as they are written.
    """
    return _map_pages(pages, keep, _NOTICE, column, partial(_notice_rows, references=references))


def extract_listing(pages: DataFrame, base_url: str, keep: Sequence[str] = (), column: str = "html") -> DataFrame:
    """(…keep, title, href, subtitle, next_query): the entries of search result pages, links made absolute."""

    def rows_of(html: str | None) -> list[dict]:
        page = _parse(_ListingParser(), html)
        return [
            {
                "title": " ".join(e["title"]),
                "href": urljoin(base_url, e["href"]),
                "subtitle": " ".join(e["subtitle"]),
                "next_query": page.next,
            }
            for e in page.entries
        ]

    return _map_pages(pages, keep, _LISTING, column, rows_of)
