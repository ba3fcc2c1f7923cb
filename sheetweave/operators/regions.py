"""Information regions of sheets, from cells to ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.boxes import KEY, SIDES, Box
from .borders import border_edges, expand_to_shells, merge_by_contact
from .components import component_boxes
from .drawings import chart_boxes, image_regions
from .lineage import cut
from .occupancy import border_occupied_cells, cell_boxes, clip_boxes, effective_bounds, non_empty_cells, occupied_cells, print_area, remove_contained, valued_merges, visible_boxes, visible_cells


def information_regions(t: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """workbook, sheet, ordinal, sides, range_ref; t holds the normalised tables of sources.xlsx.

    Branches that the settings switch off, or for which there are no drawings at all, are not built.
    """
    hidden = (t["row_dims"].where("hidden").select(*KEY, "row"), t["col_dims"].where("hidden").select(*KEY, "col"))
    respect = cfg.respect_hidden_rows_cols
    cells, merges, size = t["cells"], t["merges"], t["sheet_size"]
    see = (lambda b: visible_boxes(b, *hidden)) if respect else (lambda b: b)
    drawings = []
    if cfg.include_images and not t["images"].isEmpty():
        drawings.append(image_regions(t["images"], t["row_dims"], t["col_dims"], size, cfg.include_grouped_drawing_images))
    if cfg.include_charts and not t["charts"].isEmpty():
        drawings.append(chart_boxes(t["charts"]).select(*KEY, *SIDES).distinct())
    drawings = [cut(see(d)) for d in drawings]
    filled = non_empty_cells(cells)
    content = [cell_boxes(visible_cells(filled, *hidden) if respect else filled), see(valued_merges(merges, cells)), *drawings]
    bounds = cut(effective_bounds(content, cfg.bounds_padding_rows, cfg.bounds_padding_cols, print_area(t["sheets"]) if cfg.use_print_area_bounds else None))
    boxes = component_boxes(occupied_cells(cells, merges, bounds, cfg, hidden), cfg.grid_connectivity, cfg.min_occupied_cells).select(*KEY, "label_row", "label_col", *SIDES)
    if cfg.use_borders:
        shells = component_boxes(border_occupied_cells(cells, merges, bounds, cfg, hidden), cfg.border_grid_connectivity, cfg.min_border_cells).select(*KEY, "label_row", "label_col", *SIDES)
        boxes = expand_to_shells(boxes, shells, cfg)
    out = cut(boxes.select(*KEY, *SIDES))
    if cfg.use_border_contact_merge:
        edges = border_edges(cells, merges if cfg.include_merged_cells else None, bounds, cfg.border_contact_strong_only, hidden if respect else None)
        out = cut(merge_by_contact(out, edges, cfg))
    for d in drawings:
        out = out.unionByName(clip_boxes(d, bounds).select(*KEY, *SIDES))
    out = out.distinct()
    if cfg.remove_contained_duplicates:
        out = remove_contained(out)
    order = Window.partitionBy(*KEY).orderBy(*SIDES)
    return out.select(*KEY, F.row_number().over(order).alias("ordinal"), *SIDES, Box().range_ref.alias("range_ref"))


def summary(regions: DataFrame, sheets: DataFrame) -> DataFrame:
    """Regions of each sheet, counted and listed in order."""
    listed = regions.groupBy(*KEY).agg(F.count("*").alias("region_count"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "range_ref"))), lambda x: x["range_ref"]).alias("info_regions"))
    return sheets.select(*KEY).join(listed, [*KEY], "left").select(*KEY, F.coalesce("region_count", F.lit(0)).alias("region_count"), F.coalesce("info_regions", F.array().cast("array<string>")).alias("info_regions"))
