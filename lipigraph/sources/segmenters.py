"""Files to segments (doc_id, sequence, segment_type, source_text, location). Files of one suffix are read as whole values,
each by the task that has it; segments come in the order of the file, numbered without gaps."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.functions.text import display_form

LOCATION = "struct<kind:string,block_index:int,table_index:int,row_index:int,cell_index:int,paragraph_index:int>"
SEGMENT = f"doc_id string, sequence int, segment_type string, source_text string, location {LOCATION}"
Piece = tuple[str, str, dict]
SUFFIXES = {"txt": "txt", "md": "txt", "csv": "csv", "tsv": "tsv", "docx": "docx", "html": "html", "htm": "html"}


def text_blocks(text: str) -> Iterator[Piece]:
    """Blocks between blank lines, each in one line."""
    blocks = re.split(r"\n\s*\n+", re.sub(r"\r\n?", "\n", text))
    kept = filter(None, (" ".join(filter(None, map(display_form, b.split("\n")))) for b in blocks))
    for i, t in enumerate(kept):
        yield "paragraph", t, {"kind": "block", "block_index": i}


def cells(text: str, delimiter: str) -> Iterator[Piece]:
    """Cells row by row, header included; rows may differ in length, blank cells are left out but counted."""
    for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)):
        for c, value in enumerate(row):
            if t := display_form(value):
                yield "table_cell", t, {"kind": "cell", "row_index": r, "cell_index": c}


class _Blocks(HTMLParser):
    BREAKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "title", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.hidden = [], [], 0

    def close_block(self) -> None:
        if t := display_form("".join(self.now)):
            self.blocks.append(t)
        self.now = []

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style")
        if tag in self.BREAKS:
            self.close_block()

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BREAKS:
            self.close_block()

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.now.append(data)


def html_blocks(text: str) -> Iterator[Piece]:
    p = _Blocks()
    p.feed(text)
    p.close()
    p.close_block()
    for i, t in enumerate(p.blocks):
        yield "paragraph", html.unescape(t), {"kind": "block", "block_index": i}


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: A place in a document: paragraph, table, row and cell; None for what doesn't apply.
Place = tuple[int | None, int | None, int | None, int | None]


def docx_places(root: ElementTree.Element) -> Iterator[tuple[Place, ElementTree.Element]]:
    """Paragraphs in the order of the document, those of tables cell by cell, with their places."""
    body, n, tables = root.find(f"{W}body"), 0, 0
    for element in [] if body is None else body:
        if element.tag == f"{W}p":
            yield (n, None, None, None), element
            n += 1
        elif element.tag == f"{W}tbl":
            for r, row in enumerate(element.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    for k, p in enumerate(cell.findall(f"{W}p")):
                        yield (k, tables, r, c), p
            tables += 1


def docx_pieces(content: bytes) -> Iterator[Piece]:
    """Paragraphs and table cells in the order of the document."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    for (k, table, r, c), p in docx_places(root):
        if t := display_form("".join(x.text or "" for x in p.iter(f"{W}t"))):
            if table is None:
                yield "paragraph", t, {"kind": "paragraph", "paragraph_index": k}
            else:
                yield "table_cell", t, {"kind": "table_cell_paragraph", "table_index": table, "row_index": r, "cell_index": c, "paragraph_index": k}


def pieces(content: bytes, kind: str) -> Iterable[Piece]:
    if kind == "docx":
        return docx_pieces(content)
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    return {"txt": text_blocks, "html": html_blocks, "csv": lambda t: cells(t, ","), "tsv": lambda t: cells(t, "\t")}[kind](text)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, checksum, content) of the files below a folder; the type is null for an unknown suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return files.select("path", known[suffix].alias("file_type"), F.sha2("content", 256).alias("checksum"), "content")


def unsupported(files: DataFrame) -> DataFrame:
    """(path, error): files of types that no segmenter reads; these fail, and only these."""
    return files.where("file_type IS NULL").select("path", F.lit("unsupported file type").alias("error"))


def segment_files(files: DataFrame) -> DataFrame:
    """Segments of files of known types; doc_id is the checksum of the file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = dict.fromkeys(("kind", "block_index", "table_index", "row_index", "cell_index", "paragraph_index"))
        for pdf in parts:
            rows = [(r.checksum, i + 1, k, t, {**empty, **loc}) for r in pdf.itertuples() for i, (k, t, loc) in enumerate(pieces(bytes(r.content), r.file_type))]
            yield pd.DataFrame(rows, columns=["doc_id", "sequence", "segment_type", "source_text", "location"])

    return files.where("file_type IS NOT NULL").select("checksum", "file_type", "content").mapInPandas(run, SEGMENT)


def segment_texts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sequence, source_text): blocks of texts that are columns already, without leaving the engine."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?U:\s)*\n+")
    shown = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " ")))
    kept = F.filter(shown, lambda b: b != "")
    return texts.select(key, F.posexplode(kept).alias("sequence", "source_text")).withColumn("sequence", F.col("sequence") + 1)


def segment_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sequence, source_text): lines that aren't blank."""
    shown = F.filter(F.transform(F.split(text, "\n"), lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " "))), lambda b: b != "")
    return texts.select(key, F.posexplode(shown).alias("sequence", "source_text")).withColumn("sequence", F.col("sequence") + 1)
