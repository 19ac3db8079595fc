"""EPUB books as tables, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

ITEMS = "path string, title string, item_no int, name string, kind string, html string, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read(content: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """(title, [(name, kind, text)]) of a book; kind is document or navigation. The old NCX contents are ignored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        title = next((e.text or "" for e in package.iter() if _local(e.tag) == "title"), "")
        items = []
        for e in package.iter():
            if _local(e.tag) != "item" or e.attrib.get("media-type") != "application/xhtml+xml":
                continue
            href = unquote(e.attrib["href"])
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
            kind = "navigation" if "nav" in e.attrib.get("properties", "").split() else "document"
            items.append((href, kind, z.read(name).decode("utf-8", "replace")))
    return title, items


def body(html: str) -> str:
    """What stands in the body."""
    m = re.search(r"(?is)<body[^>]*>(.*?)</body\s*>", html)
    return m.group(1) if m else html


def book_items(files: DataFrame) -> DataFrame:
    """The items of every book of (path, content); a file that isn't a book has one row with an error."""

    def run(batches):
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    title, items = read(bytes(content))
                    rows += [(path, title, k, name, kind, text, None) for k, (name, kind, text) in enumerate(items)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "title", "item_no", "name", "kind", "html", "error"]).astype({"item_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, ITEMS)
