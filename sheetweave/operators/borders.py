"""Border edges, growth of boxes to their border shells, and merging of boxes that touch the same border lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import KEY, SIDES, Box, has_style
from .components import edge_components, pair_components
from .lineage import cut
from .occupancy import by_sheet, meeting, meeting_pairs, visible_cells, within


def cell_sides(cells: DataFrame, strong: bool = False) -> DataFrame:
    """workbook, sheet, side, row, col of every styled side of a cell."""
    sides = F.array(*(F.struct(F.lit(name).alias("side"), F.col(name).alias("style")) for name in ("top", "bottom", "left", "right")))
    every = cells.select(*KEY, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.explode(sides).alias("e"))
    return every.where(has_style(F.col("e.style"), strong)).select(*KEY, "e.side", "row", "col").distinct()


def edges_of_sides(sides: DataFrame) -> DataFrame:
    """kind, a, b of each cell's side: ("h", line, col) above row line, ("v", row, line) left of column line."""
    across = F.col("side").isin("top", "bottom")
    return sides.select(*KEY, F.when(across, "h").otherwise("v").alias("kind"), (F.col("row") + (F.col("side") == "bottom").cast("int")).alias("a"), (F.col("col") + (F.col("side") == "right").cast("int")).alias("b"))


def border_edges(cells: DataFrame, merges: DataFrame | None, bounds: DataFrame, strong: bool = False, hidden: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Edges of the styled sides of visible cells within the bounds.

    A merged range that meets the bounds also has the styled outer sides of its edge cells, beyond the bounds too: its
    outline is written out and joined to the cells' sides cell by cell.
    """
    seen = visible_cells(cells, *hidden) if hidden else cells
    out = edges_of_sides(cell_sides(within(seen, bounds), strong))
    if merges is not None:
        b = bounds.select(*KEY, *(F.col(s).alias("b_" + s) for s in SIDES))
        near = by_sheet(merges.select(*KEY, *SIDES).distinct(), b).where(Box().intersects(Box("b_"))).select(*KEY, *SIDES)
        outer = outline_cells(near).select(*KEY, "side", "row", "col").distinct()
        out = out.unionByName(edges_of_sides(cell_sides(seen, strong).join(outer, [*KEY, "side", "row", "col"], "left_semi")))
    return out.distinct()


def perimeter(boxes: DataFrame, tolerance: int = 0) -> DataFrame:
    """side, kind, a, b of each box's outline; a tolerance moves the outline outwards, no further than line 1."""
    r0, c0 = F.greatest(F.lit(1), F.col("r0") - tolerance), F.greatest(F.lit(1), F.col("c0") - tolerance)
    r1, c1 = F.col("r1") + tolerance, F.col("c1") + tolerance
    line = lambda side, kind, span, at: F.transform(span, lambda k: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), (at if kind == "h" else k).alias("a"), (k if kind == "h" else at).alias("b")))
    across, down = F.sequence(c0, c1), F.sequence(r0, r1)
    every = F.flatten(F.array(line("top", "h", across, r0), line("bottom", "h", across, r1 + 1), line("left", "v", down, c0), line("right", "v", down, c1 + 1)))
    return boxes.select("*", F.explode(every).alias("e")).select(*boxes.columns, "e.*")


def outline_cells(boxes: DataFrame) -> DataFrame:
    """perimeter(), with the row and col of the box's own cell that has the side."""
    lines = perimeter(boxes)
    return lines.withColumn("row", F.col("a") - (F.col("side") == "bottom").cast("int")).withColumn("col", F.col("b") - (F.col("side") == "right").cast("int"))


def expand_to_shells(boxes: DataFrame, shells: DataFrame, cfg) -> DataFrame:
    """Boxes after growing, in the order of the shells' first cells, to each shell that suits what they have grown to.

    In a round every box finds, among the shells that it meets, the first after the one it took last that suits it and
    is not within it: those before leave it as it is. Rounds go on with the boxes that grew, until none does.
    """
    order = F.struct("label_row", "label_col", *SIDES)
    ranked = cut(shells.select(*KEY, *SIDES, order.alias("o")).distinct())
    label = [F.coalesce("label_row", "r0").cast("int").alias("label_row"), F.coalesce("label_col", "c0").cast("int").alias("label_col")]
    # boxes of a sheet that lie alike grow alike
    first = cut(boxes.groupBy(*KEY, *SIDES).agg(F.min(F.struct(*label)).alias("l")).withColumn("id", F.monotonically_increasing_id()))
    left, done = first.select(*KEY, "id", "l", *Box().columns(), F.lit(None).cast(ranked.schema["o"].dataType).alias("last")), []
    after = lambda: F.col("last").isNull() | (F.col("o") > F.col("last"))
    while True:
        met = meeting(left, ranked, lambda a, b: a.takes_shell(b, cfg) & ~a.contains(b) & after())
        step = cut(left.join(met.groupBy("id").agg(F.min("o").alias("o")), "id", "left"))
        done.append(step.where("o is null").select(*KEY, "l", *SIDES))
        grew = step.where("o is not null")
        if grew.isEmpty():
            break
        left = grew.select(*KEY, "id", "l", *Box().union(Box(F.col("o"))).columns(), F.col("o").alias("last"))
    out = reduce(DataFrame.unionByName, done)
    if cfg.add_border_only_regions:
        alone = ranked.join(meeting(ranked, first).select(*KEY, *SIDES, "o").distinct(), [*KEY, *SIDES, "o"], "left_anti")
        out = out.unionByName(alone.select(*KEY, F.struct("o.label_row", "o.label_col").alias("l"), *SIDES))
    return out.groupBy(*KEY, *SIDES).agg(F.min("l").alias("l")).select(*KEY, "l.*", *SIDES)


def touched_components(boxes: DataFrame, edges: DataFrame, cfg) -> DataFrame:
    """node, component, n_sides: how many sides of a box lie on a border component."""
    numbered = edge_components(edges)
    hits = perimeter(boxes.select(*KEY, "node", *SIDES), cfg.border_contact_tolerance_cells).join(numbered, [*KEY, "kind", "a", "b"])
    sides = hits.groupBy(*KEY, "node", "component", "side").count().where(F.col("count") >= cfg.edges_per_side)
    return sides.groupBy(*KEY, "node", "component").agg(F.count("*").alias("n_sides"))


def contact_pairs(boxes: DataFrame, edges: DataFrame, cfg) -> DataFrame:
    """a, b: nodes of boxes that touch the same border component and are neighbours."""
    touched = touched_components(boxes, edges, cfg).where(F.col("n_sides") >= cfg.border_contact_min_touched_sides)
    placed = touched.join(boxes.select(*KEY, "node", *SIDES), [*KEY, "node"]).select(*KEY, "component", "node", *SIDES)
    near = lambda a, b: a.contact_neighbour(b, cfg.border_contact_merge_max_gap, cfg.border_contact_merge_min_axis_overlap)
    met = meeting_pairs(placed, "node", cfg.border_contact_merge_max_gap, ["component"], near)
    return met.select(*KEY, F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def merge_by_contact(boxes: DataFrame, edges: DataFrame, cfg) -> DataFrame:
    """Groups of boxes joined over contact become one box, unless that is too large for the sum of their areas."""
    if not cfg.use_border_contact_merge:
        return boxes
    numbered = boxes.withColumn("node", F.xxhash64(*SIDES))
    groups = pair_components(numbered, contact_pairs(numbered, edges, cfg))
    member = numbered.join(groups, [*KEY, "node"])
    merged = member.groupBy(*KEY, "root").agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"), F.sum(Box().area).alias("total"))
    fits = merged.where(Box().area <= F.col("total") * cfg.border_contact_merge_max_area_ratio)
    whole = member.join(fits.select(*KEY, "root"), [*KEY, "root"], "left_anti")
    return fits.select(*KEY, *SIDES).unionByName(whole.select(*KEY, *SIDES)).distinct()


def has_closed_border(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes whose whole outline is drawn by their own cells; lines of cells beside a box don't count.

    A cell of the outline is one row with a bit for each side that it must have, and so is a cell with its sides.
    """
    bit = {"top": 1, "bottom": 2, "left": 4, "right": 8}
    flag = lambda on, name: F.when(on, F.lit(bit[name])).otherwise(F.lit(0))
    r, c = F.col("row"), F.col("col")
    at = lambda row, col: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"))
    rows = F.when(F.col("r0") < F.col("r1"), F.array("r0", "r1")).otherwise(F.array("r0"))
    across = F.flatten(F.transform(F.sequence("c0", "c1"), lambda k: F.transform(rows, lambda x: at(x, k))))
    cols = F.when(F.col("c0") < F.col("c1"), F.array("c0", "c1")).otherwise(F.array("c0"))
    inner = F.when(F.col("r1") - F.col("r0") > 1, F.sequence(F.col("r0") + 1, F.col("r1") - 1)).otherwise(F.array().cast("array<int>"))
    down = F.flatten(F.transform(inner, lambda k: F.transform(cols, lambda x: at(k, x))))
    tried = boxes.select(*KEY, *Box().columns()).distinct().select("*", F.explode(F.concat(across, down)).alias("e")).select(*KEY, *SIDES, "e.*")
    need = flag(r == F.col("r0"), "top") + flag(r == F.col("r1"), "bottom") + flag(c == F.col("c0"), "left") + flag(c == F.col("c1"), "right")
    drawn = sum((flag(has_style(F.col(n), False), n) for n in bit), F.lit(0))
    seen = cells.select(*KEY, r.cast("int").alias("row"), c.cast("int").alias("col"), drawn.alias("drawn")).where("drawn > 0")
    seen = seen.groupBy(*KEY, "row", "col").agg(F.bit_or("drawn").alias("drawn"))
    kept = tried.withColumn("need", need).join(seen, [*KEY, "row", "col"]).where(F.col("drawn").bitwiseAND(F.col("need")) == F.col("need"))
    size = F.when(Box().height == 1, Box().width).when(Box().width == 1, Box().height).otherwise(2 * (Box().height + Box().width) - 4)
    return kept.groupBy(*KEY, *SIDES).count().where(F.col("count") == size).select(*KEY, *SIDES)
