"""Parsers of uploaded files: one row a file with its text, sections and metadata."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pieces

SUPPORTED = ("txt", "md", "pdf", "doc", "docx", "html", "htm", "csv", "xls", "xlsx")
PARSED = "text_content string, sections array<struct<title: string, content: string, level: int, position: int>>, metadata map<string, string>"

_SPACE = "".join(map(chr, range(33)))
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def parser_of(name: Column, mime: Column) -> Column:
    """Which parser takes a file: by MIME type or extension; plain text for anything else."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.contains("markdown") | ext.isin("md", "markdown", "mdown", "mkd"), "markdown")
        .when(m.contains("html") | ext.isin("html", "htm"), "html")
        .when(m.contains("pdf") | (ext == "pdf"), "pdf")
        .when(ext == "docx", "docx").when(ext == "xlsx", "xlsx").when(ext.isin("doc", "xls"), "binary")
        .otherwise("txt")
    )


def _section(title, content, level, position):
    return {"title": title, "content": content, "level": level, "position": position}


def clean_text(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n"))
    return re.sub(r"[ \t]+$", "", text).strip(_SPACE)


def parse_txt(text: str) -> dict:
    """Text as it is (a CSV too), cleaned; sections are the pieces between blank lines."""
    text = clean_text(text)
    pieces = [p for p in (x.strip(_SPACE) for x in re.split(r"\n\n+", text)) if p]
    return {"text_content": text, "sections": [_section(None, p, 0, i) for i, p in enumerate(pieces)], "metadata": {"format": "txt", "charCount": str(len(text))}}


_FENCE = re.compile(r"```[\s\S]*?```")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def parse_markdown(text: str) -> dict:
    """Sections begin at headings, which they keep. Headings inside code fences are none, and sections keep the code itself."""
    hidden = _FENCE.sub(lambda m: re.sub(r"[^\n]", "\x00", m[0]), text)
    heads = list(_HEADING.finditer(hidden))
    edges = [0, *(h.start() for h in heads), len(text)]
    titles = [(None, 0), *((text[h.start(2) : h.end(2)].strip(_SPACE), len(h[1])) for h in heads)]
    sections = []
    for (title, level), a, b in zip(titles, edges, edges[1:], strict=False):
        content = text[a:b].strip(_SPACE)
        if content:
            sections.append(_section(title, content, level, len(sections)))
    plain = text
    for pattern, keep in (
        (r"!\[([^\]]*)\]\([^\)]+\)", r"\1"),
        (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
        (r"\*\*([^\*]+)\*\*|__([^_]+)__", lambda m: m[1] or m[2]),
        (r"\*([^\*]+)\*|_([^_]+)_", lambda m: m[1] or m[2]),
        (r"`([^`]+)`", r"\1"),
        (r"\A[-*_]{3,}\s*\Z", ""),
        (r"\A>\s*", ""),
    ):
        plain = re.sub(pattern, keep, plain)
    plain = clean_text(plain)
    return {"text_content": plain, "sections": sections, "metadata": {"format": "markdown", "encoding": "UTF-8", "sectionCount": str(len(sections)), "charCount": str(len(plain))}}


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What is no content of a page.
_DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside"}
_DROPPED_CLASSES = {"sidebar", "menu", "navigation"}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
                if n.tag in _BLOCKS:
                    out.append(" ")
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, _Node)]


_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "body", "main", "blockquote", "pre"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        n = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _dropped(n: _Node) -> bool:
    return n.tag in _DROPPED_TAGS or bool(_DROPPED_CLASSES & set(n.attrs.get("class", "").split()))


def parse_html(text: str) -> dict:
    """Title, text without navigation, and sections: a heading with the texts of its siblings up to the next heading.

    Without headings every block of over 20 characters is a section, nested ones as well; else the whole page.
    """
    tree = _Tree()
    tree.feed(text)
    tree.close()
    root = tree.root
    nodes = list(root.walk())
    meta = {f"meta_{n.attrs['name']}": n.attrs["content"] for n in nodes if n.tag == "meta" and n.attrs.get("name") and n.attrs.get("content")}
    title = next((n.text() for n in nodes if n.tag == "title" and n.text()), None) or next((n.text() for n in nodes if n.tag == "h1" and n.text()), None)
    for n in nodes:
        n.children = [c for c in n.children if not (isinstance(c, _Node) and _dropped(c))]
    body = next((n for n in root.walk() if n.tag == "body"), root)
    if body is root:
        root.children = [c for c in root.children if not (isinstance(c, _Node) and c.tag == "head")]
    heading = re.compile(r"^h[1-6]$")
    sections = []
    for parent in body.walk():
        kids = parent.children
        for i, n in enumerate(kids):
            if isinstance(n, _Node) and heading.match(n.tag):
                texts = []
                for k in kids[i + 1 :]:
                    if isinstance(k, _Node) and heading.match(k.tag):
                        break
                    t = k.text() if isinstance(k, _Node) else ""
                    if t:
                        texts.append(t)
                if texts:
                    sections.append(_section(n.text(), "\n".join(texts), int(n.tag[1]), len(sections)))
    if not any(heading.match(n.tag) for n in body.walk()):
        for n in body.walk():
            if n.tag in ("p", "div", "article", "section") and len(n.text()) > 20:
                sections.append(_section(None, n.text(), 0, len(sections)))
    plain = _CONTROL.sub("", body.text())
    if not sections and plain:
        sections.append(_section(title, plain, 0, 0))
    return {"text_content": plain, "sections": sections, "metadata": meta | {"format": "html"} | ({"title": title} if title else {})}


def parse_docx(content: bytes) -> dict:
    """Paragraphs under headings; a heading's text is the title only; table cells stand in a row with tabs between.

    A heading is what has a style named heading and a number, title (level 1) or subtitle (level 2); names come from the file's styles, else the style's id stands for its name.
    """
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    styles = ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style") if "word/styles.xml" in z.namelist() else []
    named = {s.get(f"{w}styleId"): s.find(f"{w}name").get(f"{w}val", "") for s in styles if s.find(f"{w}name") is not None}
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    sections, title, level, lines, every = [], None, 0, [], []

    def close():
        if lines:
            sections.append(_section(title, "\n".join(lines), level, len(sections)))

    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            own = style.get(f"{w}val", "") if style is not None else ""
            own = named.get(own, own)
            m = re.match(r"(?i)heading\s*(\d)", own)
            depth = int(m[1]) if m else {"title": 1, "subtitle": 2}.get(own.lower(), 0)
            t = said(e).strip()
            every.append(t)
            if depth and t:
                close()
                title, level, lines = t, depth, []
            elif t:
                lines.append(t)
        elif e.tag == f"{w}tbl":
            for row in e.iter(f"{w}tr"):
                t = "\t".join(said(c).strip() for c in row.iter(f"{w}tc"))
                every.append(t)
                if t.strip():
                    lines.append(t)
    close()
    return {"text_content": clean_text("\n".join(every)), "sections": sections, "metadata": {"format": "docx"}}


def parse_xlsx(content: bytes) -> dict:
    """A section a sheet, in the workbook's order: its name, then a line a row with tabs between the cells that are not blank.

    The workbook's relationships tell a sheet's file; without them the n-th sheet is in the n-th file.
    """
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{n}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    sheets = [(s.get("name"), s.get(f"{r}id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{n}sheet")]
    told = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if "xl/_rels/workbook.xml.rels" in names else []
    files = {x.get("Id"): posixpath.normpath(posixpath.join("/xl", x.get("Target", ""))).lstrip("/") for x in told}
    sections = []
    for i, (name, relation) in enumerate(sheets):
        lines = [f"Sheet: {name}"]
        path = files.get(relation, f"xl/worksheets/sheet{i + 1}.xml")
        for row in ElementTree.fromstring(z.read(path)).iter(f"{n}row") if path in names else []:
            cells = []
            for c in row.iter(f"{n}c"):
                v = c.find(f"{n}v")
                text = "".join(t.text or "" for t in c.iter(f"{n}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            cells = [c for c in cells if c.strip()]
            if cells:
                lines.append("\t".join(cells))
        sections.append(_section(name, "\n".join(lines), 1, i))
    return {"text_content": clean_text("\n\n".join(s["content"] for s in sections)), "sections": sections, "metadata": {"format": "xlsx", "sheetCount": str(len(sheets))}}


def page_sections(pages: list[str]) -> list[dict]:
    """Sections of a paged text: those that say something, titled by their number."""
    return [_section(f"第 {i + 1} 页", p.strip(_SPACE), 1, i) for i, p in enumerate(pages) if p.strip(_SPACE)]


def parse_pdf_text(text: str) -> dict:
    """The extracted text of a paged file, whose pages end with form feeds."""
    plain = clean_text(_CONTROL.sub("", text.replace("\f", "\n")))
    return {"text_content": plain, "sections": page_sections(text.split("\f")), "metadata": {"format": "pdf"}}


def parse_any(kind: str, content: bytes) -> dict:
    """A file's content by its parser; formats without a parser here (and broken files) have an error in their metadata."""
    try:
        if kind in ("docx", "xlsx"):
            return {"docx": parse_docx, "xlsx": parse_xlsx}[kind](content)
        if kind in ("pdf", "binary"):
            raise ValueError(f"no parser for {kind}")
        return {"markdown": parse_markdown, "html": parse_html, "txt": parse_txt}[kind](content.decode("utf-8", "replace"))
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return {"text_content": "", "sections": [], "metadata": {"error": str(e)[:500]}}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, file_name, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.lit(None).cast("string").alias("mime_type"))


def parsed(files: DataFrame) -> DataFrame:
    """files (file_name, mime_type, content as bytes) with text_content, sections and metadata."""
    kept = [c for c in files.columns if c != "content"]
    kinds = dict(files.dtypes)
    rows = files.withColumn("_kind", parser_of(F.col("file_name"), F.col("mime_type")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (piece for whole in batches for piece in pieces(whole, "content")):
            own = [parse_any(k, bytes(c) if c is not None else b"") for k, c in zip(pdf["_kind"], pdf["content"], strict=True)]
            yield pd.concat([pdf[kept], pd.DataFrame(own, columns=["text_content", "sections", "metadata"], index=pdf.index)], axis=1)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", " + PARSED
    return rows.mapInPandas(run, schema)


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text_content, sections) of HTML in a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [parse_html(h if isinstance(h, str) else "") for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [o["metadata"].get("title") for o in own], "text_content": [o["text_content"] for o in own], "sections": [o["sections"] for o in own]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, title string, text_content string, sections array<struct<title: string, content: string, level: int, position: int>>")
