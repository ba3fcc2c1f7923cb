"""Which cells count: emptiness, hidden rows and columns, bounds, print areas, occupied and bordered cells.

Tables: cells(workbook, sheet, row, col, text, and border styles left, right, top, bottom), merges and boxes(workbook,
sheet, r0, c0, r1, c1), hidden_rows(workbook, sheet, row), hidden_cols(workbook, sheet, col).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import KEY, MAX_COL, MAX_ROW, SIDES, Box, has_style, is_non_empty, parse_range
from .lineage import cut

_SIDE_NAMES = ("left", "right", "top", "bottom")


def visible_cells(cells: DataFrame, hidden_rows: DataFrame, hidden_cols: DataFrame) -> DataFrame:
    return cells.join(hidden_rows.select(*KEY, "row").distinct(), [*KEY, "row"], "left_anti").join(hidden_cols.select(*KEY, "col").distinct(), [*KEY, "col"], "left_anti")


def non_empty_cells(cells: DataFrame) -> DataFrame:
    return cells.where(is_non_empty(F.col("text")))


def valued_merges(merges: DataFrame, cells: DataFrame) -> DataFrame:
    """Merged ranges whose top-left cell isn't empty."""
    head = non_empty_cells(cells).select(*KEY, F.col("row").alias("r0"), F.col("col").alias("c0")).distinct()
    return merges.select(*KEY, *SIDES).join(head, [*KEY, "r0", "c0"], "left_semi")


def box_cells(boxes: DataFrame) -> DataFrame:
    """Every cell of each box."""
    rows = boxes.select(*KEY, "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row"))
    return rows.select(*KEY, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def edge_cells(boxes: DataFrame) -> DataFrame:
    """The boxes with row and col of each cell on their edge."""
    at = lambda r, c: F.struct(r.alias("row"), c.alias("col"))
    across = F.transform(F.sequence("c0", "c1"), lambda k: F.array(at(F.col("r0"), k), at(F.col("r1"), k)))
    down = F.transform(F.sequence("r0", "r1"), lambda k: F.array(at(k, F.col("c0")), at(k, F.col("c1"))))
    return boxes.select(*KEY, *SIDES, F.explode(F.flatten(F.concat(across, down))).alias("_x")).select(*KEY, *SIDES, "_x.*")


def visible_boxes(boxes: DataFrame, hidden_rows: DataFrame, hidden_cols: DataFrame) -> DataFrame:
    """Boxes shrunk to their visible rows and columns; boxes with none are dropped. One axis at a time, not cell by cell."""
    out = boxes.withColumn("_id", F.xxhash64(*KEY, *SIDES))
    for lo, hi, hidden, name in (("r0", "r1", hidden_rows, "row"), ("c0", "c1", hidden_cols, "col")):
        seen = out.select(*KEY, "_id", F.explode(F.sequence(lo, hi)).alias(name)).distinct().join(hidden.select(*KEY, name).distinct(), [*KEY, name], "left_anti")
        shrunk = seen.groupBy(*KEY, "_id").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
        out = out.join(shrunk, [*KEY, "_id"]).withColumn(lo, F.col("_lo")).withColumn(hi, F.col("_hi")).drop("_lo", "_hi")
    return out.drop("_id")


def print_area(sheets: DataFrame) -> DataFrame:
    """The box around all parts of each sheet's print area."""
    part = F.regexp_replace(F.regexp_replace(F.trim(F.col("part")), r"^.*!", ""), r"\$", "")
    parts = sheets.where("print_area is not null").select(*KEY, F.explode(F.split("print_area", ",")).alias("part")).select(*KEY, parse_range(part).alias("b")).where("b is not null")
    return parts.groupBy(*KEY).agg(F.min("b.r0").alias("r0"), F.min("b.c0").alias("c0"), F.max("b.r1").alias("r1"), F.max("b.c1").alias("c1"))


#: Parts that a sheet's rows are dealt to.
DEAL = 64


def by_sheet(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """rows joined to sheets, a table of few rows a sheet, by parts of a sheet's rows: no task holds a whole sheet."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*(c for c in rows.columns if c not in KEY)), F.lit(DEAL)).cast("int"))
    every = sheets.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    return dealt.join(every, [*KEY, "_deal"]).drop("_deal")


def clip_boxes(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Boxes clipped to the bounds of their sheet; those outside are dropped."""
    b = bounds.select(*KEY, *(F.col(s).alias("b_" + s) for s in SIDES))
    clip = Box().clip(Box("b_"))
    rest = [c for c in boxes.columns if c not in (*KEY, *SIDES)]
    return by_sheet(boxes, b).where(clip.valid).select(*KEY, *rest, *clip.columns())


def effective_bounds(content: list[DataFrame], pad_rows: int = 0, pad_cols: int = 0, area: DataFrame | None = None) -> DataFrame:
    """The padded box around all content boxes of a sheet, within the format's limits and the print area.

    A print area without content counts alone; content wholly outside it leaves the sheet without bounds.
    """
    all_of = reduce(DataFrame.unionByName, (c.select(*KEY, *SIDES) for c in content))
    out = all_of.groupBy(*KEY).agg(
        F.greatest(F.lit(1), F.min("r0") - pad_rows).alias("r0"), F.greatest(F.lit(1), F.min("c0") - pad_cols).alias("c0"),
        F.least(F.lit(MAX_ROW), F.max("r1") + pad_rows).alias("r1"), F.least(F.lit(MAX_COL), F.max("c1") + pad_cols).alias("c1"),
    )
    if area is None:
        return out
    a = area.select(*KEY, *(F.col(s).alias("a_" + s) for s in SIDES))
    both = out.join(a, [*KEY], "full")
    clip = Box().clip(Box("a_"))
    picked = F.when(F.col("a_r0").isNull(), Box().struct()).when(F.col("r0").isNull(), Box("a_").struct()).when(clip.valid, clip.struct())
    return both.select(*KEY, picked.alias("b")).where("b is not null").select(*KEY, "b.*")


def cell_boxes(cells: DataFrame) -> DataFrame:
    return cells.select(*KEY, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row").alias("r1"), F.col("col").alias("c1"))


def within(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells inside the bounds of their sheet; bounds have one row a sheet."""
    b = bounds.select(*KEY, *(F.col(s).alias("b_" + s) for s in SIDES))
    return by_sheet(cells, b).where(Box("b_").contains_cell(F.col("row"), F.col("col"))).drop(*("b_" + s for s in SIDES))


def occupied_cells(cells: DataFrame, merges: DataFrame, bounds: DataFrame, cfg, hidden: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Non-empty cells, and all cells of merged ranges with a value, within the bounds."""
    parts = []
    if cfg.include_values:
        parts.append(within(non_empty_cells(cells).select(*KEY, "row", "col"), bounds))
    if cfg.include_merged_cells:
        parts.append(box_cells(clip_boxes(valued_merges(merges, cells), bounds)))
    if not parts:
        return cells.select(*KEY, "row", "col").limit(0)
    out = reduce(DataFrame.unionByName, parts).distinct()
    return visible_cells(out, *hidden) if cfg.respect_hidden_rows_cols and hidden else out


def border_occupied_cells(cells: DataFrame, merges: DataFrame, bounds: DataFrame, cfg, hidden: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cells with a border, and whole merged ranges with one on any cell of their edge, within the bounds."""
    any_side = reduce(lambda a, b: a | b, (has_style(F.col(s), cfg.strong_borders_only) for s in _SIDE_NAMES))
    bordered = cells.where(any_side).select(*KEY, "row", "col").distinct()
    out = within(bordered, bounds)
    if cfg.include_merged_cells:
        m = merges.select(*KEY, *SIDES).distinct()
        touched = edge_cells(m).join(bordered, [*KEY, "row", "col"], "left_semi")
        out = out.unionByName(box_cells(clip_boxes(touched.select(*KEY, *SIDES).distinct(), bounds))).distinct()
    return visible_cells(out, *hidden) if cfg.respect_hidden_rows_cols and hidden else out


def dedupe_boxes(boxes: DataFrame, order: str) -> DataFrame:
    """The first of equal boxes."""
    first = Window.partitionBy(*KEY, *SIDES).orderBy(order)
    return boxes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


#: Sizes of tiles are powers of two up to the longest side that the format allows.
LEVELS = MAX_ROW.bit_length()


def without_holders(boxes: DataFrame, holders: DataFrame, more, also: list[str] | None = None) -> DataFrame:
    """Boxes that no holder of the same sheet (and of the same also columns) contains under more(box, holder).

    A holder is written to the tiles of its own size that it covers, four at most; a box looks its first cell's tile of
    each size up, so boxes meet those near them and not all of a sheet.
    """
    same = [*KEY, *(also or [])]
    level = F.ceil(F.log2(F.greatest(Box().height, Box().width).cast("double"))).cast("int")
    tile = lambda x: F.expr(f"shiftright({x}, _level)")
    held = holders.select(*same, *SIDES).distinct().withColumn("_level", level)
    held = held.select("*", F.explode(F.sequence(tile("r0"), tile("r1"))).alias("_tr")).select("*", F.explode(F.sequence(tile("c0"), tile("c1"))).alias("_tc"))
    held = held.select(*same, "_level", "_tr", "_tc", *(F.col(s).alias("_h_" + s) for s in SIDES))
    asked = boxes.select(*same, *SIDES).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level"))
    asked = asked.withColumn("_tr", tile("r0")).withColumn("_tc", tile("c0"))
    found = asked.join(held, [*same, "_level", "_tr", "_tc"]).where(Box("_h_").contains(Box()) & more(Box(), Box("_h_")))
    return boxes.join(found.select(*same, *SIDES).distinct(), [*same, *SIDES], "left_anti").select(*boxes.columns)


#: So many boxes of the same place are one row of the tiles at most, and so many boxes make a part of the join.
COPIES, PART = 1_024, 4_096


def meeting_pairs(boxes: DataFrame, name: str, gap: int = 0, also: list[str] | None = None, near=None, flat: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes of a sheet that meet, or would if one were larger by gap on all sides: name < o_<name>, sides under "" and "o_".

    Each pair is found in the tiles of the larger box's size, so its cost follows the boxes that lie near each other.
    Boxes of the same place go through the tiles as one row and are written out once places have met, under
    near(box, other) too, which must hold both ways or not at all. Sides named in flat don't place a box.
    """
    same, edge = [*KEY, *(also or [])], gap + 1 if gap else 0
    place = [F.lit(1) if s in flat else F.col(s) for s in SIDES]
    own = boxes.select(*same, name, *SIDES, *(x.cast("int").alias("_p_" + s) for s, x in zip(SIDES, place, strict=True)))
    by = [*same, *("_p_" + s for s in SIDES)]
    dealt = own.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(name)) - 1) / COPIES))
    units = dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct(name, *(s for s in SIDES if flat))).alias("_all"))
    p = Box("_p_")
    grown = [F.greatest(F.lit(1), p.r0 - edge), F.greatest(F.lit(1), p.c0 - edge), p.r1 + edge, p.c1 + edge]
    units = units.select("*", *(x.cast("int").alias("_g_" + s) for s, x in zip(SIDES, grown, strict=True)))
    units = cut(units.withColumn("_own", F.ceil(F.log2(F.greatest(Box("_g_").height, Box("_g_").width).cast("double"))).cast("int")))
    used = units.groupBy("_own").agg(F.sum(F.size("_all")).alias("n")).collect()
    parts = 1 + min(sum(r.n for r in used) // PART, 4_095)
    levels = F.array(*(F.lit(k) for k in sorted(r["_own"] for r in used))) if used else F.array(F.lit(0))
    tile = lambda x: F.expr(f"shiftright({x}, _level)")
    met = [*same, "_level", "_tr", "_tc"]
    tiled = lambda df: df.select("*", F.explode(F.sequence(tile("_g_r0"), tile("_g_r1"))).alias("_tr")).select("*", F.explode(F.sequence(tile("_g_c0"), tile("_g_c1"))).alias("_tc")).repartition(parts, *met)
    large = tiled(units.withColumn("_level", F.col("_own"))).select(*met, F.col("_part").alias("_o_part"), F.col("_all").alias("_o_all"), *(F.col("_p_" + s).alias("_q_" + s) for s in SIDES), *(F.col("_g_" + s).alias("_h_" + s) for s in SIDES))
    small = tiled(units.select("*", F.explode(F.filter(levels, lambda k: k >= F.col("_own"))).alias("_level")))
    both, q = Box("_g_").clip(Box("_h_")), Box("_q_")
    # a pair counts in one tile only: that of the first cell that both cover; of equal sizes, from the smaller place
    once = (F.expr("shiftright(greatest(_g_r0, _h_r0), _level)") == F.col("_tr")) & (F.expr("shiftright(greatest(_g_c0, _h_c0), _level)") == F.col("_tc"))
    here, there = (F.struct(*(b + s for s in SIDES), part) for b, part in (("_p_", "_part"), ("_q_", "_o_part")))
    first = (F.col("_own") < F.col("_level")) | (here <= there)
    found = small.join(large, met).where(both.valid & once & first & (near(p, q) if near else F.lit(True)))
    found = found.withColumn("_self", p.same(q) & (F.col("_part") == F.col("_o_part")))
    names = [name, *SIDES]
    every = found.withColumn("_x", F.explode("_all")).withColumn("_y", F.explode("_o_all"))
    at = lambda x, b, n: F.col(f"{x}.{n}") if flat or n == name else F.col(b + n)
    every = every.select(*same, "_self", *(at("_x", "_p_", n).alias("_a_" + n) for n in names), *(at("_y", "_q_", n).alias("_b_" + n) for n in names))
    a, b = F.col("_a_" + name), F.col("_b_" + name)
    every = every.where(F.when(F.col("_self"), a < b).otherwise(a != b))
    side = lambda n, x, y: F.when(a > b, F.col(y + n)).otherwise(F.col(x + n))
    return every.select(*same, *(side(n, "_a_", "_b_").alias(n) for n in names), *(side(n, "_b_", "_a_").alias("o_" + n) for n in names))


def meeting(boxes: DataFrame, others: DataFrame, near=None) -> DataFrame:
    """Each of boxes as a row for every one of others, on its sheet, that it meets, with the other's further columns.

    Boxes must be distinct rows, and so must others; near(box, other) is looked at as they meet. As in meeting_pairs, a
    pair is found in the tile of the larger one's size in which the first cell lies that both cover.
    """
    level = F.ceil(F.log2(F.greatest(Box().height, Box().width).cast("double"))).cast("int")
    more = [c for c in others.columns if c not in (*KEY, *SIDES)]
    asked, held = boxes.withColumn("_own", level), others.withColumn("_own", level)
    used = sorted({r["_own"] for df in (asked, held) for r in df.select("_own").distinct().collect()})
    levels = F.array(*map(F.lit, used)) if used else F.array(F.lit(0))
    tile = lambda x: F.expr(f"shiftright({x}, _level)")
    at = lambda df: df.select("*", F.explode(F.filter(levels, lambda k: k >= F.col("_own"))).alias("_level")).select("*", F.explode(F.sequence(tile("r0"), tile("r1"))).alias("_tr")).select("*", F.explode(F.sequence(tile("c0"), tile("c1"))).alias("_tc"))
    met = [*KEY, "_level", "_tr", "_tc"]
    named = lambda df: df.select(*met, *(F.col(s).alias("_h_" + s) for s in SIDES), *more)
    a, b = Box(), Box("_h_")
    once = (F.expr("shiftright(greatest(r0, _h_r0), _level)") == F.col("_tr")) & (F.expr("shiftright(greatest(c0, _h_c0), _level)") == F.col("_tc"))
    test = a.intersects(b) & once & (near(a, b) if near else F.lit(True))
    asked, held = at(asked), at(held)
    # one of the two lies at its own size: the box at the other's, or the other, if smaller, at the box's
    found = asked.join(named(held.where("_level = _own")), met).where(test)
    found = found.unionByName(asked.where("_level = _own").join(named(held.where("_level > _own")), met).where(test))
    return found.select(*boxes.columns, *more)


def remove_contained(boxes: DataFrame) -> DataFrame:
    """Boxes that no larger box of the sheet contains."""
    return without_holders(boxes, boxes, lambda held, holder: holder.area > held.area)
