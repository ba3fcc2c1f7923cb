"""Images and charts: pixel axes, positions of drawings on the grid, chart anchors and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import KEY, SIDES, Box, column_pixels, local_range_ref, parse_range, row_pixels
from .lineage import cut

EMU_PER_PIXEL = 9525
#: Pixels of an axis that are looked up together.
TILE = 4096


def pixel_axis(extent: DataFrame, dims: DataFrame, name: str) -> DataFrame:
    """name, start, size in pixels of lines 1 to last + 1 of each sheet; extent has last, dims have name and size."""
    size = (column_pixels if name == "col" else row_pixels)(F.col("_size"))
    lines = extent.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("last") + 1)).alias(name))
    sized = lines.join(dims.select(*KEY, name, F.col("size").cast("double").alias("_size")), [*KEY, name], "left").select(*KEY, name, size.alias("size"))
    before = Window.partitionBy(*KEY).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def line_at(points: DataFrame, axis: DataFrame, name: str, at: str, out: str, last: str) -> DataFrame:
    """The last line, up to the column last, that starts at or before the pixel; line 1 if there is none. An as-of join.

    Lines and points meet by tiles of TILE pixels, so a point looks at the lines near it and not at all of a sheet.
    """
    tile = lambda x: F.floor(x / TILE).cast("long")
    end = F.col("start") + F.col("size")
    spans = axis.select(*KEY, F.col(name).alias("_line"), F.col("start").alias("_start"), end.alias("_end"), F.explode(F.sequence(tile(F.col("start")), tile(end - 1))).alias("_tile"))
    here = points.withColumn("_id", F.xxhash64(*points.columns)).withColumn("_tile", tile(F.col(at)))
    hit = here.select(*KEY, "_id", "_tile", F.col(at).alias("_at")).distinct().join(spans, [*KEY, "_tile"]).where((F.col("_start") <= F.col("_at")) & (F.col("_end") > F.col("_at"))).select("_id", "_line").distinct()
    beyond = F.when(F.col(at) >= 0, F.col(last)).otherwise(1)
    return here.join(hit, "_id", "left").withColumn(out, F.least(F.col(last), F.coalesce("_line", beyond)).cast("int")).drop("_id", "_line", "_tile")


def image_pixels(images: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of each image: by its markers or its size, or its share of a group's box; a pixel at least."""
    out = images
    for mark in ("from", "to"):
        for axis, name, to in ((cols, "col", "x"), (rows, "row", "y")):
            lines = axis.select(*KEY, F.col(name).alias(f"{mark}_{name}"), F.col("start").alias(f"_{mark}_{to}"))
            out = out.join(lines, [*KEY, f"{mark}_{name}"], "left")
    px = lambda mark, to, name: F.coalesce(f"_{mark}_{to}", F.lit(0)) + F.coalesce(f"{mark}_{name}_off", F.lit(0)) / EMU_PER_PIXEL
    ext = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)) / EMU_PER_PIXEL
    out = out.withColumn("x0", px("from", "x", "col")).withColumn("y0", px("from", "y", "row"))
    two = F.col("to_row").isNotNull() & F.col("to_col").isNotNull()
    out = out.withColumn("x1", F.when(two, px("to", "x", "col")).otherwise(F.col("x0") + ext("ext_cx"))).withColumn("y1", F.when(two, px("to", "y", "row")).otherwise(F.col("y0") + ext("ext_cy")))
    w, h = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    share = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.01))
    cx, cy = F.col("x0") + F.col("child_rel_x") * w, F.col("y0") + F.coalesce("child_rel_y", F.lit(0.0)) * h
    child = F.struct(cx.alias("x0"), cy.alias("y0"), (cx + share("child_rel_w") * w).alias("x1"), (cy + share("child_rel_h") * h).alias("y1"))
    grouped = F.col("is_group_child") & F.col("child_rel_x").isNotNull()
    return out.withColumn("p", F.when(grouped, child).otherwise(F.struct("x0", "y0", "x1", "y1"))).drop("x0", "y0", "x1", "y1", *(f"_{m}_{a}" for m in ("from", "to") for a in "xy")).select("*", "p.*").drop("p")


def image_boxes(images: DataFrame, row_dims: DataFrame, col_dims: DataFrame, sheet_size: DataFrame) -> DataFrame:
    """The images with the cells they cover; sheet_size has max_row, max_col."""
    far = images.groupBy(*KEY).agg(F.max(F.coalesce("to_row", F.col("from_row") + 50)).alias("far_row"), F.max(F.coalesce("to_col", F.col("from_col") + 30)).alias("far_col"))
    last = far.join(sheet_size, [*KEY], "left").select(*KEY, (F.greatest(F.coalesce("max_row", F.lit(1)), "far_row") + 2).alias("last_row"), (F.greatest(F.coalesce("max_col", F.lit(1)), "far_col") + 2).alias("last_col"))
    rows = pixel_axis(last.select(*KEY, F.col("last_row").alias("last")), row_dims.select(*KEY, "row", F.col("height").alias("size")), "row")
    rows = cut(rows)
    cols = pixel_axis(last.select(*KEY, F.col("last_col").alias("last")), col_dims.select(*KEY, "col", F.col("width").alias("size")), "col")
    cols = cut(cols)
    out = cut(image_pixels(images, cols, rows).join(last, [*KEY]))
    for axis, name, at, side, most in ((rows, "row", "y0", "r0", "last_row"), (cols, "col", "x0", "c0", "last_col"), (rows, "row", "y1", "r1", "last_row"), (cols, "col", "x1", "c1", "last_col")):
        out = line_at(out, axis, name, at, side, most)
    return out.withColumn("r1", F.greatest("r0", "r1")).withColumn("c1", F.greatest("c0", "c1")).drop("last_row", "last_col")


def anchor_boxes(images: DataFrame) -> DataFrame:
    """The first image of each anchor with the anchor's cells; without an end marker its size in cells of 64 by 20 pixels."""
    cells = lambda size, unit: F.greatest(F.lit(1), F.floor(F.col(size) / unit).cast("int"))
    end = lambda side, size, unit: F.when(F.col("to_row").isNotNull(), F.greatest(f"from_{side}", f"to_{side}")).otherwise(F.col(f"from_{side}") + cells(size, unit) - 1)
    return images.where("anchored").select("*", F.col("from_row").alias("r0"), F.col("from_col").alias("c0"), end("row", "px_height", 20).alias("r1"), end("col", "px_width", 64).alias("c1"))


def image_regions(images: DataFrame, row_dims: DataFrame, col_dims: DataFrame, sheet_size: DataFrame, grouped: bool = True) -> DataFrame:
    """Boxes of images: by their pixels where a sheet has any whose place is told in full, else (or if not grouped) by their anchors."""
    if not grouped:
        return anchor_boxes(images).select(*KEY, *SIDES).distinct()
    told = images.where("idx is not null")
    rest = images.join(told.select(*KEY).distinct(), [*KEY], "left_anti")
    return image_boxes(told, row_dims, col_dims, sheet_size).select(*KEY, *SIDES).unionByName(anchor_boxes(rest).select(*KEY, *SIDES)).distinct()


def chart_boxes(charts: DataFrame) -> DataFrame:
    """Charts with the cells of their anchor; without an end marker 11 rows by 7 columns. Charts without an anchor go."""
    return charts.where("from_row is not null").select(
        "*", F.col("from_row").alias("r0"), F.col("from_col").alias("c0"),
        F.greatest("from_row", F.coalesce("to_row", F.col("from_row") + 10)).alias("r1"), F.greatest("from_col", F.coalesce("to_col", F.col("from_col") + 6)).alias("c1"),
    )


def chart_sources(charts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """workbook, sheet, idx, n, role, range_ref, cached_values and values of each source of each chart, first ones of a range.

    charts.series is an array of (cat_f, cat_cache, val_f, val_cache). Values, each a text with its type, are read from the chart's own sheet, whatever
    sheet the formula names, as a dense grid.
    """
    one = charts.select(*KEY, "idx", F.posexplode("series").alias("s", "x"))
    role = lambda k, name: F.struct((F.col("s") * 2 + k).alias("n"), F.lit(name).alias("role"), local_range_ref(F.col(f"x.{name}_f")).alias("range_ref"), F.col(f"x.{name}_cache").alias("cached_values"))
    both = one.select(*KEY, "idx", F.explode(F.array(role(0, "cat"), role(1, "val"))).alias("r")).select(*KEY, "idx", "r.*").where("range_ref is not null")
    first = Window.partitionBy(*KEY, "idx", "range_ref").orderBy("n")
    out = both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    if cells is None:
        return out
    grid = out.select(*KEY, "idx", "n", parse_range(F.col("range_ref")).alias("b")).where("b is not null").select(*KEY, "idx", "n", "b.*")
    spine = grid.select(*KEY, "idx", "n", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select(*KEY, "idx", "n", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    filled = spine.join(cells.select(*KEY, "row", "col", F.struct("text", "type").alias("value")), [*KEY, "row", "col"], "left")
    per_row = filled.groupBy(*KEY, "idx", "n", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("v"))
    values = per_row.groupBy(*KEY, "idx", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"]).alias("values"))
    return out.join(values, [*KEY, "idx", "n"], "left")


#: A chart preview's size, the plot's place in it and the bars' colours.
PREVIEW, PLOT = (900, 420), (70, 50, 800, 260)
PALETTE = ((237, 125, 49), (112, 48, 160), (155, 187, 89), (255, 192, 0), (91, 155, 213), (165, 165, 165), (68, 114, 196), (112, 173, 71))


def bars(values: list[float]) -> list[tuple[int, int, int, int]]:
    """x0, y0, x1, y1 of each value's bar in a chart preview."""
    left, top, width, height = PLOT
    slot, most = width / max(1, len(values)), max(values, default=0) or 1.0
    wide = max(8, int(slot * 0.62))
    at = [int(left + k * slot + (slot - wide) / 2) for k in range(len(values))]
    return [(x, top + height - int(v / most * height), x + wide, top + height) for x, v in zip(at, values, strict=True)]
