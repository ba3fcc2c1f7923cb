"""Workbooks as normalised tables: binary files are parsed on executors with the standard library.

A workbook comes out as flat rows of one wide schema, some thousand at a time, each row of the table that its first column
names; they are written once to the shared folder, parted by table, so that a table's readers read its columns only. A part
that can't be read (a sheet, a drawing, a chart, the styles or strings) is a row of the errors table and the other parts
go on; a file that can't be read at all is one such row.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import KEY
from ..operators.lineage import folder

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_XDR = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
#: Chart elements and the names that they are reported under.
CHART_KINDS = {
    "barChart": "BarChart", "bar3DChart": "BarChart3D", "lineChart": "LineChart", "line3DChart": "LineChart3D", "pieChart": "PieChart", "pie3DChart": "PieChart3D", "areaChart": "AreaChart",
    "area3DChart": "AreaChart3D", "scatterChart": "ScatterChart", "bubbleChart": "BubbleChart", "doughnutChart": "DoughnutChart", "radarChart": "RadarChart", "stockChart": "StockChart", "surfaceChart": "SurfaceChart",
}
_SERIES = "array<struct<cat_f:string,cat_cache:array<string>,val_f:string,val_cache:array<string>>>"
#: Columns of each table behind workbook and sheet.
TABLES = {
    "sheets": "sheet_idx int, state string, print_area string, max_row int, max_col int",
    "cells": "row int, col int, text string, cached string, type string, left string, right string, top string, bottom string, fill string",
    "merges": "r0 int, c0 int, r1 int, c1 int",
    "row_dims": "row int, height double, hidden boolean",
    "col_dims": "col int, width double, hidden boolean",
    "images": """idx int, name string, media_path string, data binary, from_row int, from_col int, from_row_off bigint, from_col_off bigint, to_row int, to_col int, to_row_off bigint, to_col_off bigint,
ext_cx bigint, ext_cy bigint, child_rel_x double, child_rel_y double, child_rel_w double, child_rel_h double, is_group_child boolean, px_width int, px_height int, anchored boolean""",
    "charts": f"idx int, title string, kind string, from_row int, from_col int, to_row int, to_col int, series {_SERIES}",
    "errors": "part string, error string",
}
_COLUMNS = {name: [c.split()[0] for c in re.split(r",\s+", text)] for name, text in TABLES.items()}
#: All tables' columns, each once.
WIDE = "table string, workbook string, sheet string, " + ", ".join(dict.fromkeys(c.strip() for text in TABLES.values() for c in re.split(r",\s+", text)))
#: Rows of a batch.
ROWS = 4096


def _cell_at(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def _number(text, default=None, kind=int):
    try:
        return kind(float(text))
    except (TypeError, ValueError, OverflowError):
        return default


def image_pixels(data: bytes) -> tuple[int, int]:
    """Width and height of PNG, GIF, BMP, JPEG, WEBP and TIFF data; 64 by 64 if it can't be told."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at < len(data):
                marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = struct.unpack("<I", data[21:25])[0]
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:4] in (b"II*\0", b"MM\0*"):
            end = "<" if data[:2] == b"II" else ">"
            at, found = struct.unpack(end + "I", data[4:8])[0], {}
            for k in range(struct.unpack(end + "H", data[at : at + 2])[0]):
                tag, kind = struct.unpack(end + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
                found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), data[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])[0]
            return found[256], found[257]
    except (struct.error, IndexError, KeyError):
        pass
    return 64, 64


class Workbook:
    """One package: relations, strings, styles and sheets."""

    def __init__(self, content: bytes, path: str):
        self.path, self.late = path, []
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.strings = self._try([], "xl/sharedStrings.xml", lambda: ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in self._xml("xl/sharedStrings.xml", f"{_S}si")])
        self.styles = self._try([], "xl/styles.xml", self._styles)

    def _try(self, default, part: str, read, sheet: str | None = None):
        """What read() gives; where a part can't be read, an error row and the default."""
        try:
            return read()
        except Exception as e:  # noqa: BLE001  any part may be damaged in any way
            self.late.append(self._row("errors", sheet, part=part, error=f"{type(e).__name__}: {e}"))
            return default

    def _row(self, table: str, sheet: str | None, **values) -> dict:
        return {"table": table, "workbook": self.path, "sheet": sheet} | values

    def _root(self, path: str):
        return ET.fromstring(self.zip.read(path)) if path in self.names else None

    def _xml(self, path: str, tag: str):
        root = self._root(path)
        return [] if root is None else root.findall(tag)

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(part)
        root = self._root(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in [] if root is None else root:
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], path)
        return out

    def _styles(self) -> list[dict]:
        """Border styles and fill of each cell format."""
        root = self._root("xl/styles.xml")
        if root is None:
            return []
        sides = [{s: (b.find(_S + s).get("style") if b.find(_S + s) is not None else None) for s in ("left", "right", "top", "bottom")} for b in root.findall(f"{_S}borders/{_S}border")]
        fills = []
        for f in root.findall(f"{_S}fills/{_S}fill"):
            color = f.find(f"{_S}patternFill/{_S}fgColor")
            solid = color is not None and f.find(f"{_S}patternFill").get("patternType") not in (None, "none")
            fills.append({"fill": (color.get("rgb") or ("theme" if color.get("theme") else None)) if solid else None})
        at = lambda items, k: items[k] if 0 <= k < len(items) else {}
        return [at(sides, _number(xf.get("borderId"), 0)) | at(fills, _number(xf.get("fillId"), 0)) for xf in root.findall(f"{_S}cellXfs/{_S}xf")]

    def rows(self, sheet: str | None = None, visible_only: bool = False) -> Iterator[dict]:
        """The rows of all tables, of one sheet or of all, or of those that aren't hidden."""
        book, rels = self._root("xl/workbook.xml"), self.rels("xl/workbook.xml")
        areas = {_number(d.get("localSheetId"), -1): d.text for d in book.findall(f"{_S}definedNames/{_S}definedName") if d.get("name") == "_xlnm.Print_Area"}
        for k, s in enumerate(book.findall(f"{_S}sheets/{_S}sheet")):
            kind, part = rels.get(s.get(f"{_R}id"), ("", ""))
            name, found = s.get("name"), []
            if kind != "worksheet" or (sheet and name != sheet) or (visible_only and not sheet and s.get("state", "visible") != "visible"):
                continue
            if part not in self.names:
                found = self._try([], part or "xl/workbook.xml", lambda: self.zip.read(part) and [], name)
                continue
            found = self._try([], part, lambda: [*self._sheet(k, name, s.get("state", "visible"), areas.get(k), part)], name)
            yield from found
            drawing = self._try(None, part, lambda: self._root(part).find(f"{_S}drawing"), name) if found else None
            if drawing is not None:
                _, path = self._try({}, part, lambda: self.rels(part), name).get(drawing.get(f"{_R}id"), ("", ""))
                if path in self.names:
                    yield from self._try([], path, lambda: [*self._drawing(name, path)], name)
        yield from self.late

    def _value(self, c) -> tuple[str | None, str | None, str | None]:
        """The cell's text (a formula as such), its cached one and the type of the text: n, s, b, e or f."""
        kind, v, f = c.get("t", "n"), c.find(f"{_S}v"), c.find(f"{_S}f")
        cached = None if v is None else v.text
        if kind == "s" and cached is not None:
            cached = self.strings[int(cached)]
        elif kind == "inlineStr":
            cached = "".join(t.text or "" for t in c.iter(f"{_S}t"))
        elif kind == "b":
            cached = {"1": "True", "0": "False"}.get(cached, cached)
        kind = {"inlineStr": "s", "str": "s", "d": "s"}.get(kind, kind)
        return (f"={f.text or ''}", cached, "f") if f is not None else (cached, cached, kind)

    def _sheet(self, k: int, name: str, state: str, area: str | None, part: str) -> Iterator[dict]:
        root, last_row, last_col, r = self._root(part), 1, 1, 0
        for row in root.iter(f"{_S}row"):
            r = _number(row.get("r"), r + 1)  # rows and cells without a place follow the one before
            if row.get("ht") or row.get("hidden"):
                yield self._row("row_dims", name, row=r, height=_number(row.get("ht"), None, float), hidden=row.get("hidden") in ("1", "true"))
            col = 0
            for c in row.findall(f"{_S}c"):
                at = _cell_at(c.get("r")) if c.get("r") else (r, col + 1)
                col = at[1]
                text, cached, kind = self._value(c)
                style = _number(c.get("s"), 0)
                yield self._row("cells", name, row=at[0], col=at[1], text=text, cached=cached, type=kind, **(self.styles[style] if 0 <= style < len(self.styles) else {}))
                last_row, last_col = max(last_row, at[0]), max(last_col, at[1])
        for col in root.findall(f"{_S}cols/{_S}col"):
            for c in range(_number(col.get("min"), 1), min(_number(col.get("max"), 1), 16384) + 1):
                yield self._row("col_dims", name, col=c, width=_number(col.get("width"), None, float), hidden=col.get("hidden") in ("1", "true"))
        for m in root.findall(f"{_S}mergeCells/{_S}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r0, c0), (r1, c1) = _cell_at(a), _cell_at(b or a)
            yield self._row("merges", name, r0=r0, c0=c0, r1=r1, c1=c1)
            last_row, last_col = max(last_row, r1), max(last_col, c1)
        yield self._row("sheets", name, sheet_idx=k, state=state, print_area=area, max_row=last_row, max_col=last_col)

    def _drawing(self, name: str, path: str) -> Iterator[dict]:
        """Images and charts of a drawing. Only images whose place is told in full are numbered; anchored ones are an anchor's first."""
        rels, images, charts = self.rels(path), 0, 0

        def mark(anchor, tag):
            m = anchor.find(_XDR + tag)
            if m is None:
                return {}
            get = lambda t: _number(m.findtext(_XDR + t), 0)
            return {f"{tag}_row": get("row") + 1, f"{tag}_col": get("col") + 1, f"{tag}_row_off": get("rowOff"), f"{tag}_col_off": get("colOff")}

        def picture(pic, place, share, child, drawn, anchored):
            nonlocal images
            blip = pic.find(f".//{_A}blip")
            _, media = rels.get(blip.get(f"{_R}embed") if blip is not None else None, ("", ""))
            if media not in self.names or not (drawn or anchored):
                return
            data, label = self.zip.read(media), pic.find(f".//{_XDR}cNvPr")
            w, h = image_pixels(data)
            images += drawn
            row = {"idx": images if drawn else None, "name": label.get("name") if label is not None else None, "media_path": media, "data": data, "is_group_child": child, "px_width": w, "px_height": h, "anchored": anchored}
            row |= {c: v for c, v in place.items() if c not in ("cx", "cy")}
            row |= {"ext_cx": place.get("cx") or (None if child else w * 9525), "ext_cy": place.get("cy") or (None if child else h * 9525)}
            yield self._row("images", name, **row, **dict(zip(("child_rel_x", "child_rel_y", "child_rel_w", "child_rel_h"), share, strict=True)))

        for anchor in self._root(path):
            if anchor.tag not in (f"{_XDR}oneCellAnchor", f"{_XDR}twoCellAnchor"):
                continue
            ext = anchor.find(f"{_XDR}ext")
            place = mark(anchor, "from") | mark(anchor, "to") | ({} if ext is None else {"cx": _number(ext.get("cx")), "cy": _number(ext.get("cy"))})
            begun, first = "from_row" in place, True
            for pic in anchor.findall(f"{_XDR}pic"):
                yield from picture(pic, place, (None,) * 4, False, begun, begun and first)
                first = False
            for group in anchor.findall(f"{_XDR}grpSp"):
                xf = group.find(f"{_XDR}grpSpPr/{_A}xfrm")
                at = lambda x, tag, key, default: _number(x.find(_A + tag).get(key), default) if x is not None and x.find(_A + tag) is not None else default
                ox, oy, w, h = at(xf, "chOff", "x", 0), at(xf, "chOff", "y", 0), max(1, at(xf, "chExt", "cx", 1)), max(1, at(xf, "chExt", "cy", 1))
                for pic in group.iter(f"{_XDR}pic"):
                    own = pic.find(f".//{_XDR}spPr/{_A}xfrm")
                    told = begun and xf is not None and own is not None
                    share = ((at(own, "off", "x", 0) - ox) / w, (at(own, "off", "y", 0) - oy) / h, at(own, "ext", "cx", 0) / w, at(own, "ext", "cy", 0) / h) if told else (None,) * 4
                    yield from picture(pic, place, share, True, told, begun and first)
                    first = False
            for ref in anchor.iter(f"{_C}chart"):
                _, part = rels.get(ref.get(f"{_R}id"), ("", ""))
                if part in self.names and (row := self._try(None, part, lambda part=part, n=charts + 1, place=place: self._chart(name, part, place, n), name)):
                    charts += 1
                    yield row

    def _chart(self, name: str, part: str, place: dict, number: int) -> dict | None:
        root = self._root(part)
        plot = next((e for e in root.iter() if e.tag.removeprefix(_C) in CHART_KINDS), None)
        if plot is None:
            return None
        first = root.find(f"{_C}chart/{_C}title/{_C}tx/{_C}rich/{_A}p/{_A}r/{_A}t")
        title = first.text if first is not None and first.text not in ("", "None") else None

        def source(series, tag):
            refs = [(r, cache) for ref, cache in (("numRef", "numCache"), ("strRef", "strCache")) if (r := series.find(f"{_C}{tag}/{_C}{ref}")) is not None]
            formula = next((f for r, _ in refs if (f := r.findtext(f"{_C}f"))), None)
            for r, cache in refs:
                points = {_number(p.get("idx"), 0): p.findtext(f"{_C}v") for p in r.findall(f"{_C}{cache}/{_C}pt")}
                count = r.find(f"{_C}{cache}/{_C}ptCount")
                n = _number(count.get("val"), 0) if count is not None else 0
                if points:
                    return formula, [points.get(k) for k in range(n)] if n else [points[k] for k in sorted(points)]
            return formula, []

        series = [dict(zip(("cat_f", "cat_cache", "val_f", "val_cache"), (*source(s, "cat"), *source(s, "val")), strict=True)) for s in plot.findall(f"{_C}ser")]
        return self._row("charts", name, idx=number, title=title, kind=CHART_KINDS[plot.tag.removeprefix(_C)], series=series, **{k: place.get(k) for k in ("from_row", "from_col", "to_row", "to_col")})


def _rows(path: str, content: bytes, sheet: str | None, visible_only: bool) -> Iterator[dict]:
    try:
        yield from Workbook(content, path).rows(sheet, visible_only)
    except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others go on
        yield {"table": "errors", "workbook": path, "sheet": None, "part": None, "error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame, sheet: str | None = None, visible_only: bool = False) -> DataFrame:
    """Rows of all tables, in the wide schema, of files given by path and content; a named sheet is taken whatever its state."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(WIDE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for row in _rows(path.as_py(), content.as_py(), sheet, visible_only):
                    held.append(row)
                    size += len(row.get("data") or b"")
                    if len(held) >= ROWS or size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path", "content").mapInArrow(run, WIDE)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of parsed workbooks."""
    out = {name: parsed.where(F.col("table") == name).select(*KEY, *columns) for name, columns in _COLUMNS.items()}
    return out | {"sheets": out["sheets"].drop("max_row", "max_col"), "sheet_size": out["sheets"].select(*KEY, "max_row", "max_col")}


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, visible_only: bool = False) -> dict[str, DataFrame]:
    """The tables of all workbooks at a path. A named sheet is taken whatever its state; else hidden ones may be left out.

    The errors table holds what couldn't be read of these.
    """
    to = f"{folder(spark)}/workbooks-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").load(path)
    parse_files(files, sheet, visible_only).write.partitionBy("table").parquet(to)  # each file is parsed once
    return tables(spark.read.schema(WIDE).parquet(to))
