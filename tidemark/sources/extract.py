"""Text of files of many kinds, from Spark's binaryFile source.

Readers use the standard library only (Office files are zipped XML). Kinds that need a
model or another library (PDF, OCR, media tags) take a reader from ``readers``; without
one they give the empty text, and the file is still indexed by name.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.settings import notebook_text

MOST_CHARS, SLIDES, SHEETS, ROWS, COLUMNS, ENTRIES = 8000, 200, 10, 2000, 50, 20
Reader = Callable[[bytes], str]


def _texts(node: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith(tag))


def read_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def read_document(raw: bytes) -> str:
    """Paragraphs outside tables, then table rows with cells joined by ``|``."""
    body = next(x for x in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")) if x.tag.endswith("}body"))
    lines = [_texts(p, "}t") for p in body if p.tag.endswith("}p")]
    for row in (r for t in body if t.tag.endswith("}tbl") for r in t.iter() if r.tag.endswith("}tr")):
        lines.append(" | ".join(_texts(c, "}t") for c in row if c.tag.endswith("}tc")))
    return "\n".join(x for x in lines if x.strip())


def read_slides(raw: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(raw))
    number = lambda n: int("".join(c for c in n.rpartition("/")[2] if c.isdigit()) or 0)
    names = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=number)[:SLIDES]
    out = []
    for k, name in enumerate(names, 1):
        root = ElementTree.fromstring(z.read(name))
        rows = [r for r in root.iter() if r.tag.endswith("}tr")]
        inside = {id(p) for r in rows for p in r.iter()}
        parts = [_texts(p, "}t") for p in root.iter() if p.tag.endswith("}p") and id(p) not in inside]
        parts += [" | ".join(_texts(c, "}t") for c in r if c.tag.endswith("}tc")) for r in rows]
        out.append(f"Slide {k}: " + " ".join(x for x in parts if x.strip()))
    return "\n".join(out)[:MOST_CHARS]


def read_sheets(raw: bytes) -> str:
    """Rows of the first sheets that hold any, in the workbook's order; a sheet's file is the one its relation names."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    held = set(z.namelist())
    xml = lambda name: ElementTree.fromstring(z.read(name)) if name in held else ()
    shared = [_texts(x, "}t") for x in xml("xl/sharedStrings.xml")]
    files = {x.attrib["Id"]: x.attrib["Target"] for x in xml("xl/_rels/workbook.xml.rels")}
    sheets = [(x.attrib["name"], next((v for k, v in x.attrib.items() if k.endswith("}id")), "")) for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
    out, size = [], 0
    for name, relation in sheets[:SHEETS]:
        target = files.get(relation, "")
        at = target.removeprefix("/") if target.startswith("/") else f"xl/{target}"
        lines = []
        for row in [r for s in xml(at) for r in s.iter() if r.tag.endswith("}row")][:ROWS]:
            cells = []
            for place, c in enumerate(x for x in row if x.tag.endswith("}c")):
                if _column(c.attrib.get("r", ""), place) >= COLUMNS:
                    break
                value = _texts(c, "}v") or _texts(c, "}t")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            if any(x.strip() for x in cells):
                lines.append(" | ".join(x for x in cells if x.strip()))
        if lines:
            out.append(f"Sheet {name}: " + "\n".join(lines))
            size += len(out[-1])
        if size > MOST_CHARS:
            break
    return "\n".join(out)[:MOST_CHARS]


def _column(reference: str, place: int) -> int:
    """The column from 0 of a cell's reference, or its place in the row if it has none."""
    found = 0
    for letter in reference.rstrip("0123456789"):
        found = 26 * found + ord(letter) - 64
    return found - 1 if found else place


def archive_entries(raw: bytes) -> str:
    """The first names in a zip or tar file."""
    if zipfile.is_zipfile(io.BytesIO(raw)):
        return " ".join(zipfile.ZipFile(io.BytesIO(raw)).namelist()[:ENTRIES])
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        return " ".join(m.name for _, m in zip(range(ENTRIES), t, strict=False))


#: Larger archives are known by name only.
ARCHIVE_BYTES = 100 << 20
READERS: dict[str, Reader] = {"text": read_text, "docx": read_document, "slides": read_slides, "spreadsheet": read_sheets, "archive": archive_entries}


def extract(rows: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``rows`` (path, content) with ``kind`` and ``text``; a file that can't be read has the empty text."""
    known = READERS | (readers or {})

    @F.arrow_udf("string")
    def text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, contents in columns:
            out = []
            for kind, raw in zip(kinds.to_pylist(), contents.to_pylist(), strict=True):
                try:
                    readable = kind in known and raw and (kind != "archive" or len(raw) <= ARCHIVE_BYTES)
                    out.append(known[kind](raw) if readable else "")
                except Exception:  # a broken file of any kind; its name is indexed all the same
                    out.append("")
            yield pa.array(out, pa.string())

    kind = F.coalesce(T.binary_kind(F.col("path")), F.when(T.suffix(F.col("path")).isin(T.IMAGE_SUFFIXES), "image"), T.text_kind(F.col("path")))
    rows = rows.withColumn("kind", kind)
    own = text("kind", "content")
    if "notebook" not in known:  # read in the JVM
        own = F.when(F.col("kind") == "notebook", notebook_text(F.col("content"), MOST_CHARS)).otherwise(own)
    return rows.withColumn("text", own)


def indexable(path: Column) -> Column:
    """Whether a scan takes a file of this name."""
    return T.suffix(path).isin(T.INDEXABLE) | T.binary_kind(path).isNotNull()


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, mtime, size_bytes, content) of the indexable files below a folder; ``content`` is read only if
    it is selected."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.select("path", F.unix_timestamp("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size_bytes"), "content")
    return rows.where(indexable(F.col("path")))
