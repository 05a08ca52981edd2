"""Raw pages and XML: visible text, links, TEI text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CHROME = ("script", "style", "nav", "header", "footer")


#: Elements that have no content and no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Node:
    """An element: its tag, attributes, the element around it, and its content in order (elements and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.content = tag, attrs, parent, []

    def elements(self) -> Iterator[Node]:
        """This element and those within, in document order."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.content) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                yield e
            else:
                todo += reversed(e.content)

    def text(self, between: str) -> str:
        """Stripped texts that aren't empty, joined."""
        return between.join(x for t in self.texts() if (x := t.strip()))

    def around(self, *tags: str) -> Node | None:
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e


class _Tree(HTMLParser):
    """Elements as written: an end tag closes the last open element of its name, and what is open within; without one it means nothing.
    All entities are decoded. A text of white space alone is one line feed if it has any, else one space, but not in preformatted elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.data: list[str] = []

    def _text(self) -> None:
        if not self.data:
            return
        text, self.data = "".join(self.data), []
        if not text.strip(" \t\n\r\f") and self.open.tag not in ("pre", "textarea") and self.open.around("pre", "textarea") is None:
            text = "\n" if "\n" in text else " "
        self.open.content.append(text)

    def handle_starttag(self, tag, attrs):
        self._text()
        own: dict[str, str] = {}
        for k, v in attrs:
            own[k] = v or ""
        e = Node(tag, own, self.open)
        self.open.content.append(e)
        if tag not in VOID:
            self.open = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._text()
        e: Node | None = self.open
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.open = e.parent

    def handle_data(self, data):
        self.data.append(data)

    def close(self):
        super().close()
        self._text()


def parsed(html: str | None) -> Node:
    p = _Tree()
    p.feed(html or "")
    p.close()
    return p.root


def tree(html: str | None) -> Node:
    """The page without script, style and furniture."""
    root = parsed(html)
    for e in list(root.elements()):
        e.content = [c for c in e.content if isinstance(c, str) or c.tag not in CHROME]
    return root


def text_of(html: str | None) -> str:
    return "\n".join(tree(html).texts())


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Text nodes outside scripts, styles and page furniture, as they are, with a line feed between them; empty for null."""
    return html.map(text_of)


def links(base: str | None, html: str | None) -> list[tuple[str, str, str]]:
    """(url, text, context) of the first link to each address outside page furniture. The context is the text of the nearest list item, row or
    paragraph around the link, else the link's own; links without either don't count, nor do places in the page, scripts, and addresses that are none."""
    out: dict[str, tuple[str, str, str]] = {}
    for e in tree(html).elements():
        if e.tag != "a" or "href" not in e.attrs:
            continue
        href = e.attrs["href"].strip()
        if not href or href.startswith("#") or href.lower().startswith("javascript:"):
            continue
        try:
            url = urljoin(base or "", href)
        except ValueError:
            continue
        if url in out:
            continue
        text, near = e.text(" "), e.around("li", "tr", "p")
        context = near.text(" ") if near is not None else text
        if text or context:
            out[url] = (url, text, context)
    return list(out.values())


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("url", "text", "context")])))
def page_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for base, html in batches:
        yield pd.Series([[{"url": u, "text": t, "context": c} for u, t, c in links(b, h)] for b, h in zip(base, html, strict=True)])


def page_scope(html: str | None, url: str | None, chars: int = 500) -> tuple[str, str]:
    """(title, excerpt) by which a page is judged to be of one work or a listing: the title element's text, else the address."""
    root = tree(html)
    title = next((e for e in root.elements() if e.tag == "title"), None)
    return ("".join(x.strip() for x in title.texts()) if title is not None else url or ""), root.text(" ")[:chars]


def is_document(url: Column) -> Column:
    """Whether an address that nobody has fetched yet looks like a document: by its path's suffix."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))).rlike(r"[^/]\.(txt|pdf)$"), F.lit(False))


def is_author_listing(url: Column) -> Column:
    """A page that lists all works of an author is not followed."""
    return F.coalesce(F.startswith(F.try_parse_url(url, F.lit("PATH")), F.lit("/browse/authors/")), F.lit(False))


#: Elements whose content makes a line, and elements whose content is dropped.
TEI_BLOCKS = ("l", "p", "head", "ab", "item", "speaker")
TEI_SKIP = ("note", "milestone", "pb", "cb", "gap", "del", "figure")


def parse_xml(xml: str | None) -> ElementTree.Element | None:
    """The root; named entities that XML lacks stand for their characters. None for what is no XML."""
    named = re.sub(r"&(?!(?:amp|lt|gt|quot|apos);)(\w+;)", lambda m: html5.get(m[1], m[0]), xml or "")
    try:
        return ElementTree.fromstring(named)
    except ElementTree.ParseError:
        return None


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def tei_lines(xml: str | None) -> list[str]:
    """A line for each block of the body, blocks within blocks too, white space collapsed; what follows a skipped element stays."""

    def text(e: ElementTree.Element) -> str:
        return (e.text or "") + "".join(("" if local(c) in TEI_SKIP else text(c)) + (c.tail or "") for c in e)

    root = parse_xml(xml)
    body = None if root is None else next((e for e in root.iter() if local(e) == "body"), None)
    if body is None:
        return []
    lines = (" ".join(text(e).split()) for e in body.iter() if local(e) in TEI_BLOCKS)
    return [x for x in lines if x]


@F.pandas_udf(ArrayType(StringType()))
def tei_text(xml: pd.Series) -> pd.Series:
    return xml.map(tei_lines)


#: Rows of a library record that say who and what.
RECORD_LABELS = ("Author", "Editor", "Translator", "Title", "Language", "Subject")


#: Classes of links to an e-book's files, and kinds of those that are taken.
FORMAT_CLASSES = ("featured-format-link", "other-format-link")
FORMAT_KINDS = ("text/plain", "application/pdf")


def library_record(base: str, html: str | None, table: str = "bibrec") -> tuple[list[str], str | None]:
    """(text and PDF download links, `label: value` hints of the record table; None without one)."""
    root = parsed(html)
    files, record = [], None
    for e in root.elements():
        if e.tag == "a" and "href" in e.attrs and set(FORMAT_CLASSES) & set(e.attrs.get("class", "").split()) and e.attrs.get("type", "").split(";")[0].strip().lower() in FORMAT_KINDS:
            files.append(urljoin(base, e.attrs["href"]))
        if record is None and e.attrs.get("id") == table:
            record = e
    hints = []
    for row in record.elements() if record is not None else ():
        cells = [next((c for c in row.elements() if c.tag == tag), None) for tag in ("th", "td")] if row.tag == "tr" else [None]
        if None not in cells and cells[0].text(" ") in RECORD_LABELS:
            hints.append(f"{cells[0].text(' ')}: {cells[1].text(' ')}")
    return files, "; ".join(hints) or None


@F.pandas_udf(StructType([StructField("files", ArrayType(StringType())), StructField("hint", StringType())]))
def library_records(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for base, html in batches:
        yield pd.DataFrame([library_record(b or "", h) for b, h in zip(base, html, strict=True)], columns=["files", "hint"])
