"""Office containers as rows: paragraphs, cells and slides."""
from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, part string, pos int, address string, text string, formula string, error string"
_FIELDS = ("path", "kind", "part", "pos", "address", "text", "formula", "error")
#: Most bytes of one entry that are read; a larger one gives an error row.
MAX_ENTRY = 256 << 20


def detect(names: list[str]) -> str | None:
    """Kind of a container by the names of its entries."""
    have = set(names)
    for kind, entry in (("word", "word/document.xml"), ("spreadsheet", "xl/workbook.xml"), ("presentation", "ppt/presentation.xml")):
        if entry in have:
            return kind
    return "opendocument" if "content.xml" in have and "mimetype" in have else None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element, leaf: str = "t") -> str:
    out = []
    for x in node.iter():
        name = _local(x.tag)
        if name == leaf and x.text:
            out.append(x.text)
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "line-break"):
            out.append("\n")
    return "".join(out)


def _word(read) -> Iterator[tuple]:
    """Paragraphs and table rows in order."""
    body = next((x for x in ElementTree.fromstring(read("word/document.xml")) if _local(x.tag) == "body"), None)
    for pos, x in enumerate(body if body is not None else ()):
        if _local(x.tag) == "p":
            if text := _texts(x):
                yield "body", pos, None, text, None
        elif _local(x.tag) == "tbl":
            for k, row in enumerate(r for r in x if _local(r.tag) == "tr"):
                yield "table", pos, f"R{k + 1}", "\t".join(_texts(c) for c in row if _local(c.tag) == "tc"), None


def _spreadsheet(read, names: list[str]) -> Iterator[tuple]:
    """Cells with their value and formula, sheet by sheet."""
    shared = [_texts(x) for x in ElementTree.fromstring(read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [x.get("name") for x in ElementTree.fromstring(read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for k, name in enumerate(sheets):
        part = titles[k] if k < len(titles) else name
        for pos, c in enumerate(x for x in ElementTree.fromstring(read(name)).iter() if _local(x.tag) == "c"):
            parts = {_local(x.tag): x for x in c}
            value = parts["v"].text if "v" in parts else _texts(parts["is"]) if "is" in parts else None
            if c.get("t") == "s" and value is not None:
                at = int(value)
                value = shared[at] if at < len(shared) else None
            formula = parts["f"].text if "f" in parts else None
            if value is not None or formula is not None:
                yield part, pos, c.get("r"), value, formula


def _presentation(read, names: list[str]) -> Iterator[tuple]:
    """Paragraphs of each slide."""
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for k, name in enumerate(slides):
        for pos, p in enumerate(x for x in ElementTree.fromstring(read(name)).iter() if _local(x.tag) == "p"):
            if text := _texts(p):
                yield f"slide {k + 1}", pos, None, text, None


def _opendocument(read) -> Iterator[tuple]:
    """Headings, paragraphs and table rows of an OpenDocument text, sheet or presentation."""
    for pos, x in enumerate(ElementTree.fromstring(read("content.xml")).iter()):
        if _local(x.tag) in ("p", "h") and (text := "".join(x.itertext())):
            yield _local(x.tag), pos, None, text, None


def read_office(path: str, content: bytes | None) -> list[tuple]:
    """Rows of one container; one row with an error where it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            names = z.namelist()
            kind = detect(names)

            def read(name: str) -> bytes:
                if z.getinfo(name).file_size > MAX_ENTRY:
                    raise ValueError(f"{name} is too large")
                data = z.read(name)
                if b"<!DOCTYPE" in data[:4096]:  # no entities are expanded
                    raise ValueError(f"{name} has a document type")
                return data

            if kind is None:
                return [(path, None, None, 0, None, None, None, "no office container")]
            rows = {"word": lambda: _word(read), "spreadsheet": lambda: _spreadsheet(read, names), "presentation": lambda: _presentation(read, names), "opendocument": lambda: _opendocument(read)}[kind]()
            return [(path, kind, part, pos, address, text, formula, None) for part, pos, address, text, formula in rows]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, RuntimeError, NotImplementedError) as e:
        return [(path, None, None, 0, None, None, None, str(e) or type(e).__name__)]


def office_rows(files: DataFrame) -> DataFrame:
    """Rows of the containers of ``files`` (path, content), as ``binaryFile`` gives them; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cols = list(zip(*read_office(path, content))) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(_FIELDS))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
