"""Workbooks (.xlsx, .xlsm) as rows of raw cells: zip and XML only, the first tab."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DATE_FORMATS = {14, 15, 16, 17, 22}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _first_tab(z: zipfile.ZipFile, names: set[str]) -> str:
    """The part of the sheet that the workbook lists first; without such a list, that of the lowest number."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter() if r.get("Id")}
        for tab in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_N}sheet"):
            target = targets.get(next((v for k, v in tab.items() if k.endswith("}id")), None), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names and "worksheets/" in part:  # a tab may also be a chart
                return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def parse_workbook(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first tab as text; dates as dd/MM/yyyy; absent rows as empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_N}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in root.iter(f"{_N}numFmt") if re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            cells = root.find(f"{_N}cellXfs")
            dated = [int(x.get("numFmtId", 0)) in _DATE_FORMATS | own for x in (cells if cells is not None else [])]
        sheet = _first_tab(z, names)
        last = 0
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_N}row":
                    continue
                number = int(row.get("r", last + 1))
                for _ in range(last + 1, number):
                    yield []
                last, out = number, []
                for cell in row.iter(f"{_N}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    v, kind = cell.find(f"{_N}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_N}t"))
                    elif v is not None and v.text is not None:
                        style = int(cell.get("s", 0))
                        if kind == "s":
                            out[at] = shared[int(v.text)]
                        elif kind is None and style < len(dated) and dated[style]:
                            out[at] = (datetime(1899, 12, 30) + timedelta(days=float(v.text))).strftime("%d/%m/%Y")
                        else:
                            out[at] = v.text
                yield out
                row.clear()
