"""Settings: values for JSON-less calls, and the packaged ones of the command line over them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

#: Defaults of the packaged configuration that differ from those of a bare call.
PACKAGED = {
    "respect_hidden_sheets": True, "bounds_padding_rows": 2, "bounds_padding_cols": 2, "strong_borders_only": True,
    "border_connectivity": 4, "use_border_contact_merge": True, "border_contact_merge_max_gap": 5,
}
VISUALIZATION = {"enabled": True, "font_path": None, "max_rows": 160, "max_cols": 90, "pad_rows": 1, "pad_cols": 1, "preserve_dimensions": True, "include_images": True, "include_cell_text": True, "include_merged_cells": True, "scale": 1.0}


@dataclass(frozen=True)
class Config:
    include_values: bool = True
    include_merged_cells: bool = True
    include_images: bool = True
    include_grouped_drawing_images: bool = True
    include_charts: bool = True
    include_chart_source_values: bool = True
    extract_chart_images: bool = True
    chart_image_dir: str = "charts"
    respect_hidden_rows_cols: bool = False
    respect_hidden_sheets: bool = False
    use_print_area_bounds: bool = False
    bounds_padding_rows: int = 0
    bounds_padding_cols: int = 0
    connectivity: int = 8
    min_occupied_cells: int = 1
    remove_contained_duplicates: bool = False
    use_borders: bool = True
    strong_borders_only: bool = False
    border_connectivity: int | None = None
    min_border_cells: int = 2
    border_expand_min_value_overlap: float = 0.8
    border_expand_min_border_overlap: float = 0.1
    add_border_only_regions: bool = False
    border_expand_max_area_ratio: float = 3.0
    border_expand_max_extra_rows: int = 3
    border_expand_max_extra_cols: int = 3
    use_border_contact_merge: bool = False
    border_contact_strong_only: bool = False
    border_contact_tolerance_cells: int = 0
    border_contact_min_edges: int = 1
    border_contact_min_edges_per_side: int | None = None
    border_contact_min_touched_sides: int = 2
    border_contact_merge_max_gap: int = 1
    border_contact_merge_min_axis_overlap: float = 0.8
    border_contact_merge_max_area_ratio: float = 2.5
    extract_embedded_images: bool = True
    embedded_image_dir: str = "images"
    visualization: dict[str, Any] = field(default_factory=dict)

    @property
    def grid_connectivity(self) -> int:
        return 4 if self.connectivity == 4 else 8

    @property
    def border_grid_connectivity(self) -> int:
        return 4 if (self.border_connectivity or self.connectivity) == 4 else 8

    @property
    def edges_per_side(self) -> int:
        return self.border_contact_min_edges if self.border_contact_min_edges_per_side is None else self.border_contact_min_edges_per_side


_KNOWN = {f.name for f in fields(Config)}


def from_dict(values: dict[str, Any] | None) -> Config:
    """A bare call's settings; keys that mean nothing are ignored."""
    return Config(**{k: v for k, v in (values or {}).items() if k in _KNOWN})


def load_config(path: str | Path | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """The packaged settings, or a JSON file in place of all of them; overrides replace whole top-level values."""
    base = from_dict(json.loads(Path(path).read_text("utf-8"))) if path else replace(Config(), **PACKAGED, visualization=dict(VISUALIZATION))
    return replace(base, **{k: v for k, v in (overrides or {}).items() if k in _KNOWN})
