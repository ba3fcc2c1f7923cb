"""Operators on literal tables, and against a plain version on random grids."""

import random

from pyspark.sql import functions as F

from sheetweave.config import Config, load_config
from sheetweave.functions.boxes import Box, col_letter, local_range_ref, parse_range
from sheetweave.operators import borders, components, occupancy, snapshots, tree

K = ("b", "s")


def cells_of(spark, points, **styles):
    rows = [(*K, r, c, "x", *(styles.get(s) for s in ("left", "right", "top", "bottom"))) for r, c in points]
    return spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, text string, left string, right string, top string, bottom string")


def boxes_of(spark, boxes):
    return spark.createDataFrame([(*K, *b) for b in boxes], "workbook string, sheet string, r0 int, c0 int, r1 int, c1 int")


def refs(df):
    return sorted(r.x for r in df.select(Box().range_ref.alias("x")).collect())


def test_diagonal_cells_by_connectivity(spark):
    cells = cells_of(spark, [(1, 1), (2, 2)])
    assert refs(components.component_boxes(cells, 4)) == ["A1:A1", "B2:B2"]
    assert refs(components.component_boxes(cells, 8)) == ["A1:B2"]
    assert refs(components.component_boxes(cells, 8, 3)) == []


def test_components_match_a_plain_search(spark):
    rng = random.Random(1)
    points = {(rng.randint(1, 25), rng.randint(1, 25)) for _ in range(260)}
    for n, steps in ((4, [(0, 1), (1, 0), (0, -1), (-1, 0)]), (8, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])):
        left, expected = set(points), []
        while left:
            todo = [left.pop()]
            own = list(todo)
            while todo:
                r, c = todo.pop()
                for d in steps:
                    if (p := (r + d[0], c + d[1])) in left:
                        left.remove(p)
                        todo.append(p)
                        own.append(p)
            expected.append((min(p[0] for p in own), min(p[1] for p in own), max(p[0] for p in own), max(p[1] for p in own), len(own)))
        got = components.component_boxes(cells_of(spark, sorted(points)), n).select("r0", "c0", "r1", "c1", "n_cells").collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_contact_neighbours(spark):
    pairs = [((1, 1, 2, 4), (4, 1, 5, 4)), ((1, 1, 2, 4), (5, 1, 6, 4)), ((1, 1, 2, 4), (4, 4, 5, 7)), ((1, 1, 6, 6), (2, 2, 4, 4))]
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], "r0 int, c0 int, r1 int, c1 int, o_r0 int, o_c0 int, o_r1 int, o_c1 int")
    assert [r.x for r in df.select(Box().contact_neighbour(Box("o_"), 1, 0.8).alias("x")).collect()] == [True, False, False, False]


def test_contained_boxes_and_letters(spark):
    assert refs(occupancy.remove_contained(boxes_of(spark, [(1, 1, 4, 4), (2, 2, 3, 3)]))) == ["A1:D4"]
    n = spark.range(1, 18279).select(F.col("id").cast("int").alias("n")).select("n", col_letter(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in n}[702] == "ZZ" and {r.n: r.l for r in n}[703] == "AAA" and len({r.l for r in n}) == 18278
    row = spark.range(1).select(parse_range(F.lit("$B$2:AA10")).alias("a"), parse_range(F.lit("C3")).alias("b"), parse_range(F.lit("x")).alias("c"), local_range_ref(F.lit("'My sheet'!$A$1:$B$2")).alias("d")).first()
    assert tuple(row.a) == (2, 2, 10, 27) and tuple(row.b) == (3, 3, 3, 3) and row.c is None and row.d == "A1:B2"


def test_print_area_bounds(spark):
    content = boxes_of(spark, [(1, 1, 1, 26)])
    sheet = spark.createDataFrame([(*K, "s!$A$1:$B$2")], "workbook string, sheet string, print_area string")
    assert refs(occupancy.effective_bounds([content], area=occupancy.print_area(sheet))) == ["A1:B1"]
    away = spark.createDataFrame([(*K, "A5:B6")], "workbook string, sheet string, print_area string")
    assert refs(occupancy.effective_bounds([content], area=occupancy.print_area(away))) == []
    assert refs(occupancy.effective_bounds([content.limit(0)], area=occupancy.print_area(away))) == ["A5:B6"]


def test_shells_are_tried_in_order(spark):
    cfg = Config(border_expand_max_area_ratio=3.0)
    schema = "workbook string, sheet string, label_row int, label_col int, r0 int, c0 int, r1 int, c1 int"
    value = spark.createDataFrame([(*K, 2, 2, 2, 2, 3, 3)], schema)
    small, large = (*K, 1, 2, 1, 2, 4, 3), (*K, 4, 1, 1, 1, 4, 4)
    assert refs(borders.expand_to_shells(value, spark.createDataFrame([small, large], schema), cfg)) == ["A1:D4"]
    # the large one first is too large for the box as it is
    first = (*K, 0, 1, 1, 1, 4, 4)
    assert refs(borders.expand_to_shells(value, spark.createDataFrame([small, first], schema), cfg)) == ["B1:C4"]


def grid(box, style="thin"):
    return [(r, c) for r in range(box[0], box[2] + 1) for c in range(box[1], box[3] + 1)], {s: style for s in ("left", "right", "top", "bottom")}


def tree_of(spark, boxes, cells):
    return sorted((r.range_ref, tuple(r.children)) for r in tree.region_tree(boxes_of(spark, boxes), cells).collect())


def drawn(spark, *boxes):
    """Cells of the boxes, each with a thin border all around."""
    points = sorted({p for box in boxes for p in grid(box)[0]})
    return cells_of(spark, points, **grid((1, 1, 1, 1))[1])


def test_region_tree(spark):
    assert tree_of(spark, [(2, 2, 9, 9)], drawn(spark, (4, 3, 6, 5))) == [("B2:I9", ("C4:E6",))]
    plain = cells_of(spark, [(1, 1)])
    assert tree_of(spark, [(1, 1, 30, 12), (7, 9, 15, 12), (31, 1, 40, 8)], plain) == [("A1:L30", ()), ("A31:H40", ())]
    # a table with a merged last row, a single cell within a region, and regions side by side on bordered sheets
    assert tree_of(spark, [(1, 1, 12, 9)], drawn(spark, (4, 4, 7, 7), (8, 4, 8, 7))) == [("A1:I12", ("D4:G8",))]
    assert tree_of(spark, [(1, 1, 20, 6), (9, 5, 9, 5)], plain) == [("A1:F20", ())]
    assert tree_of(spark, [(1, 1, 3, 5), (8, 1, 10, 5)], drawn(spark, (1, 1, 10, 5))) == [("A1:E3", ()), ("A8:E10", ())]
    assert tree_of(spark, [(1, 1, 3, 5), (8, 1, 10, 5)], drawn(spark, (1, 1, 3, 5), (8, 1, 10, 5))) == [("A1:E3", ()), ("A8:E10", ())]


def test_a_line_of_the_cells_beside_a_table_does_not_close_it(spark):
    """The upper line is only the bottom border of the row above."""
    points = [(r, c) for r in range(4, 7) for c in range(3, 6)]
    full = {s: "thin" for s in ("left", "right", "top", "bottom")}
    rows = cells_of(spark, [p for p in points if p[0] > 4], **full).unionByName(cells_of(spark, [p for p in points if p[0] == 4], **(full | {"top": None})))
    above = cells_of(spark, [(3, c) for c in range(3, 6)], bottom="thin")
    assert tree_of(spark, [(1, 1, 9, 9)], rows.unionByName(above)) == [("A1:I9", ())]
    assert refs(borders.has_closed_border(boxes_of(spark, [(5, 3, 6, 5), (4, 3, 6, 5)]), rows.unionByName(above))) == ["C5:E6"]


def test_merged_ranges_draw_their_outer_sides(spark):
    cells = cells_of(spark, [(2, 2), (2, 3), (3, 2), (3, 3)], left="thin", right="thin", top="thin", bottom="thin")
    merges, far = boxes_of(spark, [(2, 2, 3, 3)]), boxes_of(spark, [(3, 3, 9, 9)])
    got = {(r.kind, r.a, r.b) for r in borders.border_edges(cells, merges, far).collect()}
    own = {("h", 3, 3), ("h", 4, 3), ("v", 3, 3), ("v", 3, 4)}
    assert got == own | {("h", 2, 2), ("h", 2, 3), ("h", 4, 2), ("v", 2, 2), ("v", 3, 2), ("v", 2, 4)}
    bounds = boxes_of(spark, [(1, 1, 9, 9)])
    occupied = occupancy.border_occupied_cells(cells_of(spark, [(2, 2)], top="thin"), boxes_of(spark, [(2, 2, 4, 4), (6, 6, 7, 7)]), bounds, Config())
    assert {(r.row, r.col) for r in occupied.collect()} == {(r, c) for r in range(2, 5) for c in range(2, 5)}


def test_bands_of_a_sheet_are_joined(spark):
    rng = random.Random(2)
    points = sorted({(rng.randint(1, 40), rng.randint(1, 9)) for _ in range(190)})
    cells = cells_of(spark, points)
    for n in (4, 8):
        whole, cut = ({tuple(r) for r in components.cell_components(cells, n, band).select("row", "col", "label_row", "label_col").collect()} for band in (1000, 5))
        assert whole == cut
    edges = borders.border_edges(cells_of(spark, points, top="thin", right="thin"), None, boxes_of(spark, [(1, 1, 50, 50)]))
    whole, cut = ({tuple(r) for r in components.edge_components(edges, band).select("kind", "a", "b", "component").collect()} for band in (1000, 5))
    assert whole == cut and len({x[3] for x in whole}) > 3


def test_pairs_and_containment_by_tiles_match_all_pairs(spark):
    rng = random.Random(5)
    boxes = [(k, r, c, r + rng.choice([0, 1, 3, 40]), c + rng.choice([0, 2, 30])) for k in range(90) for r, c in [(rng.randint(1, 90), rng.randint(1, 90))]]
    df = spark.createDataFrame([(*K, *b) for b in boxes], "workbook string, sheet string, id int, r0 int, c0 int, r1 int, c1 int")
    meet = lambda a, b, g: a[1] - g <= b[3] and b[1] - g <= a[3] and a[2] - g <= b[4] and b[2] - g <= a[4]
    rows = occupancy.meeting_pairs(df, "id").collect()
    assert len(rows) == len({(r.id, r.o_id) for r in rows}) and {(r.id, r.o_id) for r in rows} == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and meet(a, b, 0)}
    near = {(r.id, r.o_id) for r in occupancy.meeting_pairs(df, "id", 2).collect()}
    assert near >= {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and meet(a, b, 3)}
    area = lambda b: (b[3] - b[1] + 1) * (b[4] - b[2] + 1)
    holds = lambda a, b: a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[4] >= b[4]
    assert {r.id for r in occupancy.remove_contained(df).collect()} == {b[0] for b in boxes if not any(holds(a, b) and area(a) > area(b) for a in boxes)}


def test_copies_of_a_box_meet_as_one(spark, monkeypatch):
    """More copies than one row of the tiles takes: every pair of them once, places compared once."""
    monkeypatch.setattr(occupancy, "COPIES", 3)
    rng, place = random.Random(7), [(1, 1, 2, 2), (2, 2, 5, 3), (9, 9, 9, 9), (2, 8, 2, 12)]
    boxes = [(*K, k, *rng.choice(place)) for k in range(40)]
    df = spark.createDataFrame(boxes, "workbook string, sheet string, id long, r0 int, c0 int, r1 int, c1 int")
    meet = lambda a, b, lo: a[3 + lo] <= b[5 + lo] and b[3 + lo] <= a[5 + lo]
    pairs = [(a, b) for a in boxes for b in boxes if a[2] < b[2]]
    whole = lambda out: sorted((r.id, r.r0, r.c0, r.r1, r.c1, r.o_id, r.o_r0, r.o_c0, r.o_r1, r.o_c1) for r in out.collect())
    assert whole(occupancy.meeting_pairs(df, "id")) == sorted(a[2:] + b[2:] for a, b in pairs if meet(a, b, 0) and meet(a, b, 1))
    assert whole(occupancy.meeting_pairs(df, "id", flat=("c0", "c1"))) == sorted(a[2:] + b[2:] for a, b in pairs if meet(a, b, 0))
    assert whole(occupancy.meeting_pairs(df, "id", near=lambda a, b: a.contains(b) | b.contains(a))) == sorted(a[2:] + b[2:] for a, b in pairs if a[3:] == b[3:])


def test_boxes_grow_to_the_shells_they_meet(spark):
    """As a plain fold over all shells does, without a list of a sheet's shells for every box; one box grows twice."""
    rng, cfg = random.Random(5), Config(add_border_only_regions=True)
    one = lambda n, most: [(k, 1, r, c, r + rng.randint(0, most), c + rng.randint(0, most)) for k in range(n) for r, c in [(rng.randint(1, 30), rng.randint(1, 30))]]
    boxes, shells = one(60, 5) + [(60, 1, 52, 52, 55, 55)], one(90, 8) + [(90, 1, 51, 52, 55, 56), (91, 1, 51, 51, 57, 57), (92, 1, 70, 70, 71, 71)]
    cut = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    area = lambda a: (a[2] - a[0] + 1) * (a[3] - a[1] + 1)
    grown = [(*x[:2], *x[2:]) for x in shells if not any(cut(x[2:], y[2:]) for y in boxes)]
    for n, c, *a in boxes:
        for _, _, *b in sorted(shells):
            both = cut(a, b)
            if both and both / area(a) >= 0.8 and area(b) <= 3 * area(a) and max(a[0] - b[0], b[2] - a[2]) <= 3 and max(a[1] - b[1], b[3] - a[3]) <= 3 and both / area(b) >= 0.1:
                a = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
        grown.append((n, c, *a))
    expected = {}
    for n, c, *a in grown:
        expected[tuple(a)] = min(expected.get(tuple(a), (n, c)), (n, c))
    df = lambda rows: spark.createDataFrame([(*K, *r) for r in rows], "workbook string, sheet string, label_row int, label_col int, r0 int, c0 int, r1 int, c1 int")
    out = borders.expand_to_shells(df(boxes), df(shells), cfg)
    assert {(r.r0, r.c0, r.r1, r.c1): (r.label_row, r.label_col) for r in out.collect()} == expected and (51, 51, 57, 57) in expected and (70, 70, 71, 71) in expected
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_closed_borders_of_all_shapes(spark):
    """Lines, single cells and boxes, by cells that may be given twice."""
    rng, names = random.Random(3), ("left", "right", "top", "bottom")
    rows = [(*K, r, c, "x", *("thin" if rng.random() < 0.9 else None for _ in names)) for r in range(1, 9) for c in range(1, 9)] + [(*K, 1, 1, "x", "thin", None, None, None)] * 2
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, text string, left string, right string, top string, bottom string")
    sides = {(r[2], r[3], n) for r in rows for n, v in zip(names, r[5:], strict=True) if v}
    boxes = [(a, b, c, d) for a in range(1, 8) for b in range(1, 8) for c in range(a, min(a + 4, 9)) for d in range(b, min(b + 4, 9))]
    closed = lambda a, b, c, d: all((a, k, "top") in sides and (c, k, "bottom") in sides for k in range(b, d + 1)) and all((k, b, "left") in sides and (k, d, "right") in sides for k in range(a, c + 1))
    assert sorted((r.r0, r.c0, r.r1, r.c1) for r in borders.has_closed_border(boxes_of(spark, boxes), cells).collect()) == [x for x in sorted(boxes) if closed(*x)]


def test_rows_of_a_sheet_are_dealt(spark):
    """No task gets all of a sheet's rows with its bounds."""
    cells = cells_of(spark, [(r, c) for r in range(1, 101) for c in range(1, 6)])
    bounds = boxes_of(spark, [(1, 1, 90, 4)]).selectExpr("workbook", "sheet", "r1 as last")
    dealt = occupancy.by_sheet(cells, bounds)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, cells.join(bounds, ["workbook", "sheet"]).collect()))
    assert cells.count() == dealt.count() and "_deal" in dealt._jdf.queryExecution().toString()


def test_component_numbers_run_on_over_bands(spark):
    points = [(r, c) for r in range(1, 12) for c in range(1, 12) if (r * 7 + c * 3) % 5 < 2]
    edges = borders.border_edges(cells_of(spark, points, **grid((1, 1, 1, 1))[1]), None, boxes_of(spark, [(1, 1, 20, 20)]))
    numbered = lambda band: components.edge_components(edges, band)
    few, whole = numbered(2), numbered(1 << 14)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect())) and min(r.component for r in few.collect()) == 1
    assert "row_number() windowspecdefinition(workbook" in (plan := few._jdf.queryExecution().toString()) and ", at" in plan


def test_area_guard_keeps_a_group_apart(spark):
    points, styles = grid((1, 1, 9, 4))
    edges = borders.border_edges(cells_of(spark, points, **styles), None, boxes_of(spark, [(1, 1, 20, 20)]))
    pair = boxes_of(spark, [(1, 1, 2, 4), (8, 1, 9, 4)])
    assert refs(borders.merge_by_contact(pair, edges, Config(use_border_contact_merge=True, border_contact_merge_max_gap=5))) == ["A1:D9"]
    assert refs(borders.merge_by_contact(pair, edges, Config(use_border_contact_merge=True, border_contact_merge_max_gap=5, border_contact_merge_max_area_ratio=1.2))) == ["A1:D2", "A8:D9"]


def test_merge_structure(spark):
    rows = {1: ((1, 3), (4, 6), (7, 8)), 3: ((1, 2), (3, 5), (6, 8)), 7: ((1, 4), (5, 8))}
    merges = boxes_of(spark, [(r, a, r, b) for r, spans in rows.items() for a, b in spans])
    out = snapshots.merge_structure(boxes_of(spark, [(1, 1, 20, 8)]), merges).collect()
    assert [(r.m_r0, r.m_r1) for r in out] == [(1, 12)]


def test_large_regions_are_split(spark):
    cells = cells_of(spark, [(r, c) for r in range(1, 151) for c in range(1, 4)])
    none = cells.limit(0).select("workbook", "sheet", F.lit("").alias("range_ref"))
    row = snapshots.snapshot_plan(boxes_of(spark, [(1, 1, 150, 3)]), cells, boxes_of(spark, [(1, 1, 1, 1)]).limit(0), none).first()
    assert row.strategy == "large_table_sampled" and row.snapshot_mode == "split"
    assert [(s.kind, s.range_ref, s.render) for s in row.snapshots] == [("overview", "A1:C150", False), ("header+first_rows+change_points", "A1:C96", True), ("last_rows", "A103:C150", True)]


def test_config_layers():
    assert load_config().strong_borders_only and not Config().strong_borders_only
    assert load_config(overrides={"visualization": {"max_rows": 3}}).visualization == {"max_rows": 3}
