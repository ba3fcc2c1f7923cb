"""Region trees: outer ranges and the closed inner tables within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import KEY, SIDES, Box, has_style
from .borders import has_closed_border
from .components import component_boxes
from .occupancy import without_holders


def root_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that no other, different box of the sheet contains."""
    own = boxes.select(*KEY, *SIDES).distinct()
    return without_holders(own, own, lambda held, holder: ~held.same(holder))


def inner_tables(roots: DataFrame, cells: DataFrame) -> DataFrame:
    """Closed tables strictly inside roots, with the root's sides as p_r0 to p_c1.

    Cells below a root's first row with both horizontal and vertical borders are grouped by 4 neighbours, 4 cells at
    least; each box may then take one row more, or else one column more, if that closes it. Nested ones are dropped. A
    merged range draws no line of a box but by its own edge cells, so merges aren't needed.
    """
    style = lambda *names: sum((has_style(F.col(n), False).cast("int") for n in names), F.lit(0)) > 0
    grid = cells.where(style("top", "bottom") & style("left", "right")).select(*KEY, "row", "col")
    p = roots.select(*KEY, *(F.col(s).alias("p_" + s) for s in SIDES)).distinct()
    inside = grid.join(p, [*KEY]).where(Box("p_").contains_cell(F.col("row"), F.col("col")) & (F.col("row") > F.col("p_r0")))
    # a root is a sheet of its own to the kernel
    own = F.concat_ws("\x1f", "sheet", "p_r0", "p_c0", "p_r1", "p_c1")
    parts = component_boxes(inside.select("workbook", own.alias("sheet"), "row", "col"), 4, 4)
    key = F.split("sheet", "\x1f")
    parts = parts.select("workbook", key[0].alias("sheet"), *SIDES, *(key[k + 1].cast("int").alias("p_" + s) for k, s in enumerate(SIDES)))
    tried = parts.select(*KEY, *("p_" + s for s in SIDES), Box().struct().alias("own"), F.posexplode(F.array(
        Box().struct(),
        F.struct("r0", "c0", F.least(F.col("p_r1"), F.col("r1") + 1).alias("r1"), "c1"),
        F.struct("r0", "c0", "r1", F.least(F.col("p_c1"), F.col("c1") + 1).alias("c1")),
    )).alias("n", "t")).select("*", "t.*").drop("t")
    closed = has_closed_border(tried, cells).withColumn("closed", F.lit(True))
    # a try equal to the box itself changes nothing; of two that close it the later counts; the box stays if none does
    order = F.struct((F.coalesce("closed", F.lit(False)) & ((F.col("n") == 0) | ~F.struct(*SIDES).eqNullSafe(F.col("own")))).alias("ok"), F.col("n"))
    best = tried.join(closed, [*KEY, *SIDES], "left").groupBy(*KEY, *("p_" + s for s in SIDES), "own").agg(F.max_by(F.struct(*SIDES, F.coalesce("closed", F.lit(False)).alias("closed")), order).alias("t"))
    picked = best.select(*KEY, *("p_" + s for s in SIDES), "t.*")
    isolated = (Box().width >= 2) & (Box().height >= 2) & (F.col("r0") > F.col("p_r0")) & (F.col("c0") > F.col("p_c0")) & (F.col("r1") < F.col("p_r1")) & (F.col("c1") < F.col("p_c1"))
    kept = picked.where(F.col("closed") & isolated).drop("closed").distinct()
    return without_holders(kept, kept, lambda held, holder: ~held.same(holder), also=[f"p_{s}" for s in SIDES])


def region_tree(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """workbook, sheet, range_ref, children (array of range_ref, by row and column), with sides for the order."""
    roots = root_boxes(boxes)
    found = inner_tables(roots, cells)
    listed = found.groupBy(*KEY, *(F.col("p_" + s).alias(s) for s in SIDES)).agg(F.array_sort(F.collect_list(F.struct("r0", "c0", Box().range_ref.alias("range_ref")))).alias("c"))
    children = F.coalesce(F.transform("c", lambda x: x["range_ref"]), F.array().cast("array<string>"))
    return roots.join(listed, [*KEY, *SIDES], "left").select(*KEY, *SIDES, Box().range_ref.alias("range_ref"), children.alias("children"))
