"""Segments back to files. Rows are grouped on the cluster; a file is made from one document's rows."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.operators.metrics import numbered
from lipigraph.sources.segmenters import W, docx_places

# Formats that a file of each type can leave as.
FORMATS = {"csv": ["csv", "docx", "pdf", "txt"], "tsv": ["tsv", "docx", "pdf", "txt"], "pdf": ["pdf", "docx", "txt"]}
OTHER_FORMATS = ["docx", "pdf", "txt"]


def export_formats(file_type: Column) -> Column:
    out = F.array(*map(F.lit, OTHER_FORMATS))
    for k, v in FORMATS.items():
        out = F.when(file_type == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def not_ready(segments: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n_open): documents with a segment that is open or has no text; these can't be exported."""
    return segments.where((F.col("status") != "approved") | (F.coalesce(F.trim("text"), F.lit("")) == "")).groupBy(key).agg(F.count(F.lit(1)).alias("n_open"))


#: Texts in one value of a text export; a longer document is several parts that follow each other.
PART = 10_000


def as_text(segments: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, part, value): texts (document_id, sequence, id, text) of a document in order with blank lines between, in parts of bounded size."""
    n = numbered(segments.select("document_id", "sequence", "id", F.col(text).alias("t")))
    rows = n.withColumn("part", F.floor((F.col("n") - 1) / PART).cast("int"))
    return rows.groupBy("document_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("value"))


def export(documents: DataFrame, segments: DataFrame, translations: DataFrame, fmt: str) -> DataFrame:
    """(document_id, allowed, n_open, status): whether each document can leave as fmt now: all its segments approved with a text, and a format of its type; else its export has failed."""
    t = translations.select(F.col("segment_id").alias("id"), F.col("approved_text").alias("text"))
    open_ = not_ready(segments.select("id", "document_id", "status").join(t, "id", "left")).withColumnRenamed("document_id", "id")
    any_ = segments.select(F.col("document_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    d = documents.select("id", "file_type").join(open_, "id", "left").join(any_, "id", "left")
    allowed, n = F.array_contains(export_formats(F.col("file_type")), fmt), F.coalesce("n_open", F.lit(0))
    return d.select(F.col("id").alias("document_id"), allowed.alias("allowed"), n.alias("n_open"), F.when(allowed & (n == 0) & F.col("_has").isNotNull(), "exported").otherwise("export_failed").alias("status"))


def table_of(cells: pd.DataFrame) -> list[list[str]]:
    """The rows of a table from its cells; what no cell fills is blank."""
    rows = [[""] * (int(cells.cell_index.max()) + 1) for _ in range(int(cells.row_index.max()) + 1)] if len(cells) else []
    for c in cells.itertuples():
        rows[int(c.row_index)][int(c.cell_index)] = c.text or ""
    return rows


def grid(cells: pd.DataFrame, delimiter: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(table_of(cells))
    return out.getvalue()


def as_grid(cells: DataFrame, delimiter: str = ",", key: str = "document_id") -> DataFrame:
    """(key, value): a table from cells (row_index, cell_index, text); cells that were blank stay blank."""

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], grid(pdf, delimiter))], columns=[key, "value"])

    return cells.select(key, "row_index", "cell_index", "text").groupBy(key).applyInPandas(one, f"{key} string, value string")


def _paragraph(text: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def docx(paragraphs: list[str]) -> bytes:
    """A document of paragraphs."""
    return _package("".join(map(_paragraph, paragraphs)))


def docx_table(rows: list[list[str]]) -> bytes:
    """A document of one table; rows may differ in length."""
    width = max(map(len, rows), default=0)
    cells = lambda row: "".join(f"<w:tc>{_paragraph(x)}</w:tc>" for x in [*row, *[""] * (width - len(row))])
    return _package("<w:tbl>" + "".join(f"<w:tr>{cells(row)}</w:tr>" for row in rows) + "</w:tbl>" if width else "")


def docx_with(content: bytes, texts: dict[tuple, str]) -> bytes:
    """A document with the texts of its places (paragraph: its number; cell paragraph: table, row, cell, paragraph) replaced: a paragraph's first run gets the text, its others are emptied, all else stays."""
    old = zipfile.ZipFile(io.BytesIO(content))
    # Prefixes stay as they were, since parts of a document may name them in attributes.
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(old.read("word/document.xml")), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    root = ElementTree.fromstring(old.read("word/document.xml"))
    for place, paragraph in docx_places(root):
        if place in texts:
            held = list(paragraph.iter(f"{W}t"))
            if not held:
                held = [ElementTree.SubElement(ElementTree.SubElement(paragraph, f"{W}r"), f"{W}t")]
            for t in held:
                t.text = ""
            held[0].text = texts[place]
            held[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in old.namelist():
            z.writestr(name, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if name == "word/document.xml" else old.read(name))
    return out.getvalue()


def _package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def as_docx(segments: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, content): a document of one paragraph for each segment."""

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], docx(pdf.sort_values("sequence").t.fillna("").tolist()))], columns=[key, "content"])

    return segments.select(key, "sequence", F.col(text).alias("t")).groupBy(key).applyInPandas(one, f"{key} string, content binary")


def as_docx_table(cells: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, content): a document of one table from cells (row_index, cell_index, text)."""

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], docx_table(table_of(pdf)))], columns=[key, "content"])

    return cells.select(key, "row_index", "cell_index", "text").groupBy(key).applyInPandas(one, f"{key} string, content binary")


PLACE = ["paragraph_index", "table_index", "row_index", "cell_index"]


def write_back_docx(files: DataFrame, texts: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, content): files (key, content) with the texts (key, location, text) of their places; a file without any stays."""
    at = texts.select(key, *(F.col(f"location.{c}").alias(c) for c in PLACE), "text")

    def one(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        new = {tuple(None if pd.isna(x) else int(x) for x in p): t or "" for *p, t in right[[*PLACE, "text"]].itertuples(index=False)}
        return pd.DataFrame([(k[0], docx_with(bytes(c), new)) for c in left.content], columns=[key, "content"])

    return files.select(key, "content").groupBy(key).cogroup(at.groupBy(key)).applyInPandas(one, f"{key} string, content binary")


def write_pack(approved: DataFrame, corrections: DataFrame, manifest: DataFrame, path: str) -> None:
    """The three parts of a feedback pack, by document: tab-separated with a header, and JSON."""
    approved.write.mode("overwrite").partitionBy("document_id").option("sep", "\t").option("header", True).csv(f"{path}/approved_segments")
    corrections.write.mode("overwrite").partitionBy("document_id").option("sep", "\t").option("header", True).csv(f"{path}/review_corrections")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
