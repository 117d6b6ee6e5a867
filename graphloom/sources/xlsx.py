"""Workbooks as cell rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.sheet import parse_ref

CELLS = "model string, sheet string, reference string, row int, column int, formula string, number double, text string, cached double, number_format string"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _name(t) == "t")


def workbook_cells(data: bytes) -> list[tuple]:
    """(sheet, reference, row, column, formula, number, text, cached, number_format) of every cell that has something."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    xml = lambda p: ElementTree.fromstring(z.read(p)) if p in names else None
    shared = [_text(s) for s in xml("xl/sharedStrings.xml") or ()]
    formats: dict[str, str] = {}
    styles: list[str | None] = []
    if (st := xml("xl/styles.xml")) is not None:
        formats = {e.get("numFmtId"): e.get("formatCode") for e in st.iter() if _name(e) == "numFmt"}
        for x in st:
            if _name(x) == "cellXfs":
                styles = [formats.get(e.get("numFmtId")) for e in x]
    rels = {e.get("Id"): e.get("Target") for e in xml("xl/_rels/workbook.xml.rels") or ()}
    out = []
    for s in xml("xl/workbook.xml").iter():
        if _name(s) != "sheet":
            continue
        target = rels[s.get(REL)].lstrip("/")
        for c in xml(target if target.startswith("xl/") else f"xl/{target}").iter():
            if _name(c) != "c":
                continue
            ref, kind = c.get("r").replace("$", ""), c.get("t", "n")
            part = {_name(e): e for e in c}
            formula = part["f"].text if "f" in part else None
            raw = part["v"].text if "v" in part else None
            number = text = cached = None
            if kind == "s" and raw is not None:
                text = shared[int(raw)]
            elif kind == "inlineStr":
                text = _text(c)
            elif kind in ("str", "e") and raw is not None:
                text = raw
            elif raw is not None and re.fullmatch(r"[-+.\deE]+", raw):
                number = float(raw)
            if formula is not None:
                number, cached, text = None, number, None
            if formula is not None or number is not None or text is not None:
                row, col = parse_ref(ref)
                style = int(c.get("s", 0))
                out.append((s.get("name"), ref, row, col, formula, number, text, cached, styles[style] if style < len(styles) else None))
    return out


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks below path; the model is the file's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                if rows := [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], *r) for r in workbook_cells(data)]:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")]).astype({"number": "float64", "cached": "float64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, CELLS)
