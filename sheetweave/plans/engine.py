"""The facade: workbooks in, regions and their files out. What is collected for files is one workbook's results."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..functions.boxes import KEY, SIDES, Box, image_extension, is_non_empty, safe_filename_part
from ..operators.borders import cell_sides
from ..operators.drawings import PALETTE, PLOT, PREVIEW, bars, chart_boxes, chart_sources, image_boxes, pixel_axis
from ..operators.lineage import cut
from ..operators.occupancy import clip_boxes, print_area, visible_boxes
from ..operators.regions import information_regions, summary
from ..operators.snapshots import snapshot_plan
from ..operators.tree import inner_tables, region_tree, root_boxes
from ..png import Canvas, decode, rgb
from ..sources.xlsx import read_workbooks


def extract_regions(spark: SparkSession, path: str, sheet: str | None = None, config: Config | None = None) -> DataFrame:
    """Regions of every sheet of every workbook at the path; files that can't be read have none (see workbook_errors)."""
    cfg = config or Config()
    return information_regions(read_workbooks(spark, path, sheet, cfg.respect_hidden_sheets), cfg)


def workbook_errors(spark: SparkSession, path: str) -> DataFrame:
    """workbook, sheet, part, error of what couldn't be read at the path; the sheet and part are null for a whole file."""
    return read_workbooks(spark, path)["errors"]


def _one_workbook(t: dict[str, DataFrame], sheet: str | None) -> list:
    """The sheets in order, of the one workbook that was read; a file or sheet that can't be read raises, and so does an unknown sheet."""
    failed = t["errors"].where("part is null or part not like 'xl/drawings/%' and part not like 'xl/charts/%'").orderBy("workbook", "part").first()
    if failed:
        raise ValueError(f"{failed.workbook}: {failed.part or 'file'}: {failed.error}")
    rows = t["sheets"].orderBy("sheet_idx").collect()
    if len({r.workbook for r in rows}) > 1:
        raise ValueError("the path matches more than one workbook")
    if sheet and not rows:
        raise KeyError(sheet)
    return rows


def extract_workbook_info_regions(spark: SparkSession, path: str, sheet: str | None = None, config: Config | None = None) -> dict[str, Any]:
    """One workbook's regions as {"workbook", "sheets": {name: {"sheet_name", "info_regions"}}}. An unknown sheet raises."""
    cfg = config or Config()
    t = read_workbooks(spark, path, sheet, cfg.respect_hidden_sheets)
    order = [r.sheet for r in _one_workbook(t, sheet)]
    found = {r.sheet: [*r.info_regions] for r in summary(information_regions(t, cfg), t["sheets"]).collect()}
    return {"workbook": str(path), "sheets": {name: {"sheet_name": name, "info_regions": found[name]} for name in order}}


def write_json(path: Path, value: Any) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), "utf-8")


def placed_images(t: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """Images with range_ref and file name; numbers count those left out too."""
    out = image_boxes(t["images"].where("idx is not null"), t["row_dims"], t["col_dims"], t["sheet_size"])
    if cfg.respect_hidden_rows_cols:
        out = visible_boxes(out, t["row_dims"].where("hidden"), t["col_dims"].where("hidden"))
    if cfg.use_print_area_bounds:
        area = print_area(t["sheets"])
        out = clip_boxes(out, area).unionByName(out.join(area.select(*KEY), [*KEY], "left_anti"))
    number = F.concat(F.lit("IMG"), F.when(F.col("idx") < 1000, F.lpad(F.col("idx").cast("string"), 3, "0")).otherwise(F.col("idx").cast("string")))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), number)
    file = F.concat_ws("_", number, safe_filename_part(Box().range_ref), safe_filename_part(name))
    return out.select(*KEY, "idx", name.alias("name"), Box().range_ref.alias("range_ref"), F.concat(file, image_extension(F.col("media_path"), F.col("data"))).alias("file"), "data")


def chart_table(t: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """name, kind, range_ref and sources of each chart."""
    placed = chart_boxes(t["charts"]).select(*KEY, "idx", F.coalesce("title", F.concat(F.lit("Chart "), "idx")).alias("name"), "kind", Box().range_ref.alias("range_ref"))
    sources = chart_sources(t["charts"], t["cells"] if cfg.include_chart_source_values else None)
    fields = ["n", "role", "range_ref", *(["values", "cached_values"] if cfg.include_chart_source_values else [])]
    listed = sources.groupBy(*KEY, "idx").agg(F.array_sort(F.collect_list(F.struct("n", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("source")))).alias("x"))
    return placed.join(listed.select(*KEY, "idx", F.transform("x", lambda x: x["source"]).alias("sources")), [*KEY, "idx"], "left")


def typed(value: dict | None) -> Any:
    """A cell's text as a number, a truth value or a string by its type; formulas stay texts."""
    text = (value or {}).get("text")
    if text is None or value["type"] not in ("n", "b"):
        return text
    if value["type"] == "b":
        return text == "True"
    number = float(text)
    return int(number) if number.is_integer() and not re.search(r"[.eE]", text) else number


def chart_item(row) -> dict[str, Any]:
    """name, kind, range_ref and sources; values are typed, and caches that hold nothing are left out."""
    item = {"name": row.name, "kind": row.kind, "range_ref": row.range_ref, "sources": []}
    for s in map(json.loads, row.sources or []):
        own = {"role": s["role"], "range_ref": s["range_ref"]}
        if "values" in s:
            own["values"] = [[typed(v) for v in line] for line in s["values"] or []]
        if s.get("cached_values"):
            own["cached_values"] = s["cached_values"]
        item["sources"].append(own)
    return item


def chart_preview(item: dict[str, Any]) -> Canvas | None:
    """Bars of the first categories and values of a chart: cached ones, or the first row of live ones."""
    roles = {s["role"]: s for s in reversed(item["sources"])}
    if not {"cat", "val"} <= roles.keys():
        return None
    labels, values = (s.get("cached_values") or (s.get("values") or [[]])[0] for s in (roles["cat"], roles["val"]))
    if not labels or not values:
        return None
    canvas, (left, top, width, height) = Canvas(*PREVIEW), PLOT
    for k in range(6):
        y = top + int(height * k / 5)
        canvas.rectangle(left, y, left + width, y, (220, 220, 220))
    canvas.rectangle(left, top + height, left + width, top + height + 1, (80, 80, 80))
    canvas.rectangle(left, top, left + 1, top + height, (80, 80, 80))
    canvas.text(left, 18, item["name"], (30, 30, 30), 3, width)
    numbers = [float(v or 0) for v in values]
    for k, (x0, y0, x1, y1) in enumerate(bars(numbers)):
        canvas.rectangle(x0, y0, x1, y1, PALETTE[k % len(PALETTE)])
        canvas.outline(x0, y0, x1, y1, (70, 70, 70))
        canvas.text(x0, y0 - 14, f"{numbers[k]:g}", (40, 40, 40))
        canvas.text(x0, y1 + 8, str(labels[k] if k < len(labels) and labels[k] is not None else "")[:14], (40, 40, 40))
    return canvas


def draw_list(views: DataFrame, regions: DataFrame, t: dict[str, DataFrame], merged: bool = True, preserve: bool = True, text: bool = True) -> DataFrame:
    """Rectangles of each view's picture in pixels, by layer: fills of merged ranges, of cells, lines of borders, pasted pictures, texts, regions.

    views has a row for each picture: workbook, sheet, view and the sides shown; regions, and pictures
    to be pasted, have a layer and a label. A text lies on its cell's merged range, if there is one, and is cut at its end. All axes are worked out once a sheet.
    """
    seen_in = views.select(*KEY, "view", *(F.col(s).alias("v_" + s) for s in SIDES))
    last = views.groupBy(*KEY).agg(F.max("r1").alias("bottom"), F.max("c1").alias("far"))
    # a size of zero or less is shown as the least there is
    shown_as = lambda c: F.when(F.col(c) <= 0, F.lit(-1.0)).otherwise(F.col(c)).alias("size")
    dims = (lambda df: df) if preserve else (lambda df: df.limit(0))
    rows = pixel_axis(last.select(*KEY, F.col("bottom").alias("last")), dims(t["row_dims"].select(*KEY, "row", shown_as("height"))), "row")
    cols = pixel_axis(last.select(*KEY, F.col("far").alias("last")), dims(t["col_dims"].select(*KEY, "col", shown_as("width"))), "col")
    none = F.lit(None).cast("string")
    cell = [F.col(x).alias(s) for s, x in zip(SIDES, ("row", "col", "row", "col"), strict=True)]
    shown = t["cells"].where(is_non_empty(F.col("cached")) | F.col("fill").isNotNull())
    parts = shown.select(*KEY, F.lit(1).alias("layer"), *cell, F.col("fill").alias("color"), none.alias("note"))
    if merged:
        parts = parts.unionByName(t["merges"].select(*KEY, F.lit(0).alias("layer"), *SIDES, none.alias("color"), none.alias("note")))
    parts = parts.unionByName(cell_sides(t["cells"]).select(*KEY, F.lit(2).alias("layer"), *cell, none.alias("color"), F.col("side").alias("note")))
    if text:
        spans = t["merges"].select(*KEY, *SIDES) if merged else t["merges"].limit(0).select(*KEY, *SIDES)
        own = t["cells"].where(is_non_empty(F.col("cached"))).select(*KEY, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("cached").alias("note"))
        own = own.join(spans, [*KEY, "r0", "c0"], "left").withColumn("r1", F.coalesce("r1", "r0")).withColumn("c1", F.coalesce("c1", "c0"))
        parts = parts.unionByName(own.select(*KEY, F.lit(4).alias("layer"), *SIDES, none.alias("color"), "note"))
    parts = parts.withColumn("view", none).unionByName(regions.select(*KEY, "layer", *SIDES, none.alias("color"), F.col("label").alias("note"), "view"))
    seen = parts.withColumnRenamed("view", "only").join(seen_in, [*KEY]).where(F.col("only").isNull() | (F.col("only") == F.col("view"))).drop("only")
    clip = Box().clip(Box("v_"))
    seen = seen.where(clip.valid).select(*KEY, "view", "layer", "color", "note", *clip.columns(), F.col("v_r0").alias("top"), F.col("v_c0").alias("left_"))
    for side, axis, name, to, end in (("r0", rows, "row", "y0", False), ("c0", cols, "col", "x0", False), ("r1", rows, "row", "y1", True), ("c1", cols, "col", "x1", True), ("top", rows, "row", "oy", False), ("left_", cols, "col", "ox", False)):
        line = axis.select(*KEY, F.col(name).alias(side), ((F.col("start") + F.col("size") - 1) if end else F.col("start")).alias(to))
        seen = seen.join(line, [*KEY, side])
    px = lambda a, o: (F.col(a) - F.col(o)).cast("int").alias(a)
    return seen.select(*KEY, "view", "layer", "color", "note", px("x0", "ox"), px("y0", "oy"), px("x1", "ox"), px("y1", "oy"))


#: Layers of a picture.
PASTED, REGION = 3, 5


def picture(rects: list, scale: float = 1.0, pasted: dict[str, Canvas | None] | None = None) -> bytes:
    """A view's rectangles as a PNG, pasted pictures by their labels; a few white points where there are none."""
    at = lambda x: round(x * scale)
    canvas = Canvas(max((at(r.x1) for r in rects), default=0) + 2, max((at(r.y1) for r in rects), default=0) + 2)
    for r in sorted(rects, key=lambda r: (r.layer, r.y0, r.x0)):
        x0, y0, x1, y1 = map(at, (r.x0, r.y0, r.x1, r.y1))
        if r.layer == 0:
            canvas.rectangle(x0, y0, x1, y1, (238, 238, 248))
        elif r.layer == 1:
            canvas.rectangle(x0, y0, x1, y1, rgb(r.color) or (225, 232, 245))
        elif r.layer == 2:
            edge = {"top": (x0, y0, x1, y0), "bottom": (x0, y1, x1, y1), "left": (x0, y0, x0, y1), "right": (x1, y0, x1, y1)}
            canvas.rectangle(*edge[r.note], (90, 90, 90))
        elif r.layer == PASTED:
            canvas.rectangle(x0, y0, x1, y1, (245, 245, 245))
            if other := (pasted or {}).get(r.note):
                canvas.paste(other, x0, y0, x1, y1)
            canvas.outline(x0, y0, x1, y1, (160, 160, 160))
        elif r.layer == 4:
            canvas.text(x0 + 3, max(y0 + 1, y1 - 12), r.note.replace("\n", " "), (30, 30, 30), room=x1 - x0 - 3)
        else:
            canvas.outline(x0, y0, x1, y1, (220, 40, 40), 2)
            canvas.text(x0 + 3, y0 + 3, r.note, (220, 40, 40), 1)
    return canvas.png()


def _view(name: str, view: str, box: tuple[int, int, int, int], most: tuple[int, int], pad: tuple[int, int]) -> tuple:
    """A picture's sides: the box, padded and cut to so many rows and columns."""
    r0, c0 = max(1, box[0] - pad[0]), max(1, box[1] - pad[1])
    return name, view, r0, c0, min(box[2] + pad[0], r0 + most[0] - 1, 1_048_576), min(box[3] + pad[1], c0 + most[1] - 1, 16_384)


def run_and_write(spark: SparkSession, path: str, out_dir: str, sheet: str | None = None, config_path: str | None = None, overrides: dict[str, Any] | None = None, write_images: bool = True, write_snapshots: bool = False) -> dict[str, Any]:
    """Regions, trees, drawings, plans and snapshots of one workbook, and their files below out_dir."""
    cfg = load_config(config_path, overrides)
    t = read_workbooks(spark, path, sheet, cfg.respect_hidden_sheets)
    order = [r.sheet for r in _one_workbook(t, sheet)]
    found = cut(information_regions(t, cfg))
    trees = region_tree(found, t["cells"]).orderBy(*SIDES).collect()
    placed = cut(placed_images(t, cfg)) if cfg.extract_embedded_images else None
    charts = chart_table(t, cfg).orderBy("idx").collect() if cfg.include_charts else []
    out, v, everything = Path(out_dir), cfg.visualization, {}
    drawn = write_images and v.get("enabled", True)
    for name in order:
        roots = [r for r in trees if r.sheet == name]
        tree = [{"range_ref": r.range_ref, "children": [{"range_ref": c} for c in r.children]} for r in roots]
        everything[name] = {"sheet_name": name, "regions": [r.range_ref for r in roots], "region_tree": tree, "region_images": [], "snapshot_plan": [], "snapshots": [], "images": _images(placed, name, out, cfg) if placed is not None else []}
        everything[name]["charts"] = _charts([r for r in charts if r.sheet == name], out / _folder(name), cfg)
    if drawn:
        _pictures(spark, t, found, placed, {name: own for name, own in everything.items() if own["regions"]}, out, cfg, write_snapshots)
    for name, own in everything.items():
        if write_snapshots:
            write_json(out / _folder(name) / "snapshot_plan.json", own["snapshot_plan"])
        write_json(out / _folder(name) / "info_regions.json", own)
    result = {"workbook": str(path), "sheets": everything}
    write_json(out / "info_regions_full.json", result)
    write_json(out / "info_regions_summary.json", summarize(result))
    return result


def summarize(result: dict[str, Any]) -> dict[str, Any]:
    """A row for each sheet: its regions, images and charts, counted and listed."""
    rows = []
    for name, own in result["sheets"].items():
        row = {"sheet_name": name}
        for one, many, listed in (("region", "regions", own.get("regions", own.get("info_regions", []))), ("image", "images", own.get("images", [])), ("chart", "charts", own.get("charts", []))):
            row |= {f"{one}_count": len(listed), many: listed}
        rows.append(row)
    return {"workbook": result["workbook"], "sheets": rows}


def _folder(name: str) -> str:
    return re.sub(r'[\\/:*?"<>|]', "_", name)


def _images(placed: DataFrame, name: str, out: Path, cfg: Config) -> list[dict[str, Any]]:
    """The sheet's image files, written one by one as they come; a name used before gets a number."""
    items, used, to = [], set(), out / _folder(name) / cfg.embedded_image_dir
    for r in placed.where(F.col("sheet") == name).orderBy("idx").toLocalIterator():
        file, n = r.file, 2
        while file in used:
            file, n = f"{Path(r.file).stem}_{n}{Path(r.file).suffix}", n + 1
        used.add(file)
        to.mkdir(parents=True, exist_ok=True)
        (to / file).write_bytes(bytes(r.data))
        items.append({"name": r.name, "range_ref": r.range_ref, "path": f"{cfg.embedded_image_dir}/{file}"})
    return items


def _charts(rows: list, folder: Path, cfg: Config) -> list[dict[str, Any]]:
    """The sheet's charts; bar charts get a picture. A folder that stays empty is removed."""
    items, to = [], folder / cfg.chart_image_dir
    safe = lambda s: re.sub(r"[^\w.()\-]", "_", s).strip("_") or "chart"
    for k, row in enumerate(rows, 1):
        item = chart_item(row)
        if cfg.extract_chart_images and row.kind == "BarChart" and (canvas := chart_preview(item)):
            file = f"CHART{k:03d}_{safe(row.range_ref)}_{safe(row.name)}.png"
            to.mkdir(parents=True, exist_ok=True)
            (to / file).write_bytes(canvas.png())
            item["path"] = f"{cfg.chart_image_dir}/{file}"
        items.append(item)
    if to.is_dir() and not any(to.iterdir()):
        to.rmdir()
    return items


def _pictures(spark: SparkSession, t: dict[str, DataFrame], found: DataFrame, placed: DataFrame | None, everything: dict[str, dict], out: Path, cfg: Config, snapshots: bool) -> None:
    """Overlays of all sheets and, if asked for, plans and snapshots: one draw list for all of them."""
    v, views, outlines, pasted = cfg.visualization, [], [], {}
    ids = {name: _ids(own["region_tree"]) for name, own in everything.items()}
    boxes = {name: {region: _sides(ref) for region, ref in own} for name, own in ids.items()}
    for name, own in boxes.items():
        around = [f(b[k] for b in own.values()) for k, f in enumerate((min, min, max, max))]
        views.append(_view(name, "", tuple(around), (v.get("max_rows", 160), v.get("max_cols", 90)), (v.get("pad_rows", 1), v.get("pad_cols", 1))))
        outlines += [(name, "", *b, REGION, region) for region, b in own.items()]
        if v.get("include_images", True):
            here = everything[name]
            for item in here["images"]:
                pasted[item["path"]] = decode((out / _folder(name) / item["path"]).read_bytes())
                outlines.append((name, "", *_sides(item["range_ref"]), PASTED, item["path"]))
            for k, item in enumerate(here["charts"]):
                pasted[f"{name} {k}"] = chart_preview(item)  # of any kind
                outlines.append((name, "", *_sides(item["range_ref"]), PASTED, f"{name} {k}"))
    workbook, shots = t["sheets"].select("workbook").first().workbook, {}
    if snapshots:
        # plans of all boxes of the trees; each region has its own, equal boxes of two roots too
        refs = placed.select(*KEY, "range_ref") if placed is not None else found.limit(0).select(*KEY, F.lit("").alias("range_ref"))
        roots = cut(root_boxes(found))
        both = cut(roots.select(*KEY, *SIDES).unionByName(inner_tables(roots, t["cells"]).select(*KEY, *SIDES)).distinct())
        plans = {(p.sheet, p.region_range): p for p in snapshot_plan(both, t["cells"].withColumn("text", F.col("cached")), t["merges"], refs).collect()}
        most = (v.get("snapshot_max_rows", v.get("max_rows", 160)), v.get("snapshot_max_cols", v.get("max_cols", 90)))
        for name, own in everything.items():
            for region, ref in ids[name]:
                p = plans[name, ref]
                plan = {"sheet_name": name, "region_id": region, "region_range": ref} | {k: p[k] for k in ("row_count", "col_count", "merged_cell_count", "formula_count", "strategy", "snapshot_mode", "is_split")}
                plan["snapshots"] = [s.asDict() for s in p.snapshots]
                own["snapshot_plan"].append(plan)
                for s in plan["snapshots"]:
                    if s["render"]:
                        file = _folder(f"{region}_{s['snapshot_id']}_{s['kind']}_{s['range_ref']}.png")
                        s["path"], shots[name, file] = f"snapshots/{file}", s
                        views.append(_view(name, file, _sides(s["range_ref"]), most, (v.get("snapshot_pad_rows", 0), v.get("snapshot_pad_cols", 0))))
                        own["snapshots"].append({"region_id": region} | {k: s[k] for k in ("snapshot_id", "kind", "range_ref", "snapshot_mode", "is_split", "path")})
            own["region_images"] = own["snapshots"]
    if not views:
        return
    table = lambda rows, more="": spark.createDataFrame([(workbook, *r) for r in rows], "workbook string, sheet string, view string, r0 int, c0 int, r1 int, c1 int" + more)
    rects: dict[tuple[str, str], list] = {}
    for r in draw_list(table(views), table(outlines, ", layer int, label string"), t, v.get("include_merged_cells", True), v.get("preserve_dimensions", True), v.get("include_cell_text", True)).toLocalIterator():
        rects.setdefault((r.sheet, r.view), []).append(r)
    for name in everything:
        folder = out / _folder(name)
        for old in (folder / "snapshots").glob("*.png") if snapshots else ():
            old.unlink()
        for sheet, view, *_ in views:
            if sheet == name:
                to = folder / "snapshots" / view if view else folder / "info_regions.png"
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(picture(rects.get((name, view), []), v.get("scale", 1.0), pasted))


def _sides(ref: str) -> tuple[int, int, int, int]:
    """The sides of a range of two cells."""
    (a, r0), (b, r1) = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in ref.split(":"))
    number = lambda letters: sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters)))
    return int(r0), number(a), int(r1), number(b)


def _ids(tree: list[dict]) -> list[tuple[str, str]]:
    """Region ids with their ranges: each root, then its children."""
    out = []
    for k, root in enumerate(tree, 1):
        out.append((f"R{k:03d}", root["range_ref"]))
        out += [(f"R{k:03d}.C{j:02d}", c["range_ref"]) for j, c in enumerate(root["children"], 1)]
    return out
