"""Lines of pages to segments: single lines in a short document, regions of text in a long one. Regions are a fold in order,
since their limits depend on what the region holds so far."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a region, and the lines up to which a document keeps them apart.
MAX_LINES, MAX_CHARS = 24, 2800
GAP, SHIFT, LEADING = 50.0, 90.0, 0.7
FEW_LINES = 180
REGION = "doc_id string, region_id int, segment_type string, page_index int, block_index int, line_index int, text string, line_count int, x0 double, y0 double, x1 double, y1 double, font_size double"


def not_footer(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Lines that aren't a page number at the foot of their page."""
    centre = (x0 + x1) / 2
    return ~(text.rlike(r"^\s*\p{Nd}{1,3}\s*$") & (y0 >= 0.88 * height) & centre.between(0.35 * width, 0.65 * width) & ((x1 - x0) <= 0.08 * width) & ((y1 - y0) <= 0.04 * height))


def join_lines(lines: list[str]) -> str:
    """Lines with single spaces; a word broken by a hyphen before a small letter is whole again."""
    out = ""
    for line in filter(None, map(str.strip, lines)):
        if out.endswith("-") and line[:1].islower():
            out = out[:-1] + line
        else:
            out = f"{out} {line}" if out else line
    return out


def stands_alone(text: str) -> bool:
    """A number, with or without #, or a leader of dots: no part of a region."""
    t = text.strip()
    return not t or t.removeprefix("#").isdigit() or not t.strip(". ·•-–—") and any(c in ".·•" for c in t)


def apart(region: list, line) -> bool:
    """Whether a line begins a region of its own behind these lines."""
    last = region[-1]
    gap = line.y0 - last.y1
    full = len(region) >= MAX_LINES or sum(len(x.text) for x in region) + len(line.text) > MAX_CHARS
    return last.page_index != line.page_index or full or gap > GAP or abs(line.x0 - last.x0) > SHIFT and gap > LEADING * (last.font_size or 0)


def fold(lines: pd.DataFrame) -> list[list]:
    regions: list[list] = []
    open_ = False
    for r in lines.sort_values(["page_index", "block_index", "line_index"]).itertuples():
        alone = stands_alone(r.text)
        if open_ and not alone and not apart(regions[-1], r):
            regions[-1].append(r)
        else:
            regions.append([r])
        open_ = not alone
    return regions


def regions(lines: DataFrame, few: int = FEW_LINES) -> DataFrame:
    """Segments of each document (doc_id) from its lines (page, block and line index, text, box, font size): its lines, or where they are more than few, its regions. A document is folded in one task, its pages being bounded."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [[r] for r in pdf.sort_values(["page_index", "block_index", "line_index"]).itertuples()] if len(pdf) <= few else fold(pdf)
        rows = [
            (
                key[0], i + 1, "pdf_line" if len(g) == 1 else "pdf_text_region", g[0].page_index, g[0].block_index, g[0].line_index, g[0].text if len(g) == 1 else join_lines([x.text for x in g]), len(g),
                min(x.x0 for x in g), min(x.y0 for x in g), max(x.x1 for x in g), max(x.y1 for x in g), round(sum(x.font_size for x in g) / len(g), 2),
            )
            for i, g in enumerate(groups)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGION.split(", ")])

    return lines.where(F.trim("text") != "").groupBy("doc_id").applyInPandas(one, REGION)


def sessions(rows: DataFrame, key: str, at: str, gap: Column, tie: str) -> DataFrame:
    """rows with session: where only the gap to the row before parts regions, a lag and a running sum do."""
    w = Window.partitionBy(key).orderBy(at, tie)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_start", starts).withColumn("session", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
