"""Books in EPUB files read into spine units, one file per task row, with the standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

UNIT_SCHEMA = (
    "path string, spine_index int, unit_id string, manifest_id string, href string, original_title string, toc_title string, heading_title string, paragraphs array<string>, text_length int, link_text_length int, image_count int, class_hints array<string>, body_text string"
)
# Elements that are never text, and those that make a paragraph.
SKIP, BLOCK, HEAD = {"script", "style", "nav", "head"}, {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "figcaption"}, {"h1", "h2", "h3", "h4"}
# Elements before which a paragraph that is still open ends, as a browser reads them, and lists that hold items.
ENDS_P, LISTS = BLOCK | {"div", "ul", "ol", "dl", "dt", "dd", "table", "section", "article", "aside", "header", "footer", "main", "nav", "figure", "form", "hr", "address", "fieldset"}, {"ul", "ol"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Page(HTMLParser):
    """Collects leaf blocks, leaf divs, headings, link text, images and hints in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.blocks: list[str] = []
        self.divs: list[str] = []
        self.heads: list[str] = []
        self.text: list[str] = []
        self.shown: list[str] = []
        self.links = self.images = self.skip = 0
        self.hints: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        found = dict(attrs)
        for name in ("id", "class", "epub:type", "type", "role"):
            self.hints += (found.get(name) or "").split()
        self.images += tag in ("img", "image", "svg")
        open_tags = [t["tag"] for t in self.stack]
        if tag in ENDS_P and "p" in open_tags:
            self.handle_endtag("p")
        elif tag == "li" and "li" in open_tags and not LISTS & set(open_tags[len(open_tags) - open_tags[::-1].index("li") :]):
            self.handle_endtag("li")
        if tag in VOID:
            self.handle_data("\n" if tag == "br" else "")
            return
        self.skip += tag in SKIP
        if tag in BLOCK or tag == "div":
            for open_tag in self.stack:
                open_tag["leaf"] = False if tag in BLOCK or open_tag["tag"] == "div" else open_tag["leaf"]
        self.stack.append({"tag": tag, "text": [], "leaf": True})

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not self.skip:
            self.shown.append(data)
            for open_tag in self.stack:
                open_tag["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if not any(t["tag"] == tag for t in self.stack):
            return
        while self.stack:
            done = self.stack.pop()
            self.skip -= done["tag"] in SKIP
            words = squeezed("".join(done["text"]))
            if done["tag"] in HEAD and words:
                self.heads.append(words)
            if done["tag"] == "a":
                self.links += len(words)
            if done["leaf"] and len(words) > 1:
                (self.blocks if done["tag"] in BLOCK else self.divs if done["tag"] == "div" else []).append(words)
            if done["tag"] == tag:
                break


def read_page(html: str) -> dict:
    """Paragraphs and figures of one page: leaf blocks, else leaf divs, else lines of what is shown.

    body_text is all text of the page, that of its head and scripts too; it serves to tell what kind of page it is.
    """
    page = _Page()
    page.feed(html)
    page.close()
    while page.stack:
        page.handle_endtag(page.stack[-1]["tag"])
    lines = [x for x in map(squeezed, "".join(page.shown).split("\n")) if len(x) > 1]
    paragraphs = page.blocks or page.divs or lines
    generic = re.compile(r"^(item|id|xhtml|html|body|text|page|file|section|chapter)[\s._-]*\d*$", re.I)
    return {
        "heading_title": next((h for h in page.heads if len(h) <= 140 and not generic.match(h)), page.heads[0] if page.heads else None), "paragraphs": paragraphs, "text_length": sum(map(len, paragraphs)), "link_text_length": page.links,
        "image_count": page.images, "class_hints": list(dict.fromkeys(page.hints))[:40], "body_text": squeezed("".join(page.text)),
    }


def read_book(path: str, raw: bytes) -> Iterator[dict]:
    """The spine of one book; pages that cannot be read are left out, a broken archive gives nothing."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package_path = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(archive.read(package_path))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return
    base = posixpath.dirname(package_path)
    items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item") and "id" in e.attrib}
    titles: dict[str, str] = {}
    for item in items.values():
        if item.get("media-type") == "application/x-dtbncx+xml":
            try:
                ncx = ElementTree.fromstring(archive.read(posixpath.join(base, item["href"])))
            except (KeyError, ElementTree.ParseError):
                continue
            for point in (e for e in ncx.iter() if e.tag.endswith("navPoint")):
                label = next((e.text for e in point.iter() if e.tag.endswith("}text") and e.text), None)
                content = next((e.attrib.get("src", "") for e in point.iter() if e.tag.endswith("content")), "")
                if label:
                    titles.setdefault(content.split("#")[0].lower(), squeezed(label))
    refs = [e.attrib.get("idref", "") for e in package.iter() if e.tag.endswith("itemref")]
    for k, ref in enumerate(refs):
        item = items.get(ref)
        if item is None:
            continue
        try:
            html = archive.read(posixpath.normpath(posixpath.join(base, unquote(item["href"])))).decode("utf-8", "replace")
        except KeyError:
            continue
        yield {"path": path, "spine_index": k, "unit_id": f"spine:{k}:{ref}", "manifest_id": ref, "href": item["href"], "original_title": posixpath.basename(item["href"]), "toc_title": titles.get(item["href"].lower()), **read_page(html)}


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """Spine units of all books at a path; books are spread over the tasks by their files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in UNIT_SCHEMA.split(", ")]
        for rows in batches:
            for where, raw in zip(rows["path"], rows["content"], strict=True):
                yield pd.DataFrame(list(read_book(where, raw)), columns=names)

    return files.mapInPandas(parse, UNIT_SCHEMA)
