"""Hand-zipped workbooks through the source, the facade and its files."""

import json
import zipfile

import pytest

from sheetweave.config import Config
from sheetweave.plans.engine import extract_regions, extract_workbook_info_regions, run_and_write, workbook_errors
from sheetweave.png import Canvas
from sheetweave.sources.xlsx import image_pixels, read_workbooks, tables
from sheetweave.streaming.ingest import stream_workbooks

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def sheet_xml(cells, extra="", cols="", drawing=False):
    rows = {}
    for ref, v in cells.items():
        rows.setdefault(int("".join(ch for ch in ref if ch.isdigit())), []).append((ref, v))
    data = "".join(f'<row r="{r}">' + "".join((f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>') for ref, v in own) + "</row>" for r, own in sorted(rows.items()))
    return f'<worksheet xmlns="{M}" xmlns:r="{R}">{cols}<sheetData>{data}</sheetData>{extra}' + ('<drawing r:id="rId1"/>' if drawing else "") + "</worksheet>"


def workbook(path, sheets, more=None):
    """sheets: (name, state, xml)."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" state="{s}" r:id="rId{k}"/>' for k, (n, s, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{k}" Type="{R}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{P}">{rels}</Relationships>')
        for k, (_, _, xml) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", xml)
        for name, data in (more or {}).items():
            z.writestr(name, data)
    return str(path)


def test_hidden_columns_and_sheets(spark, tmp_path):
    cols = '<cols><col min="2" max="2" width="9" hidden="1"/></cols>'
    path = workbook(tmp_path / "a.xlsx", [("visible", "visible", sheet_xml({"A1": "visible", "B1": "hidden"}, cols=cols)), ("gone", "hidden", sheet_xml({"A1": "x"}))])
    out = extract_workbook_info_regions(spark, path, config=Config(respect_hidden_rows_cols=True, respect_hidden_sheets=True, use_borders=False, include_images=False))
    assert out["sheets"] == {"visible": {"sheet_name": "visible", "info_regions": ["A1:A1"]}}
    assert [*extract_workbook_info_regions(spark, path, "gone", Config(respect_hidden_sheets=True))["sheets"]] == ["gone"]
    with pytest.raises(KeyError):
        extract_workbook_info_regions(spark, path, "none")


def test_drawings_and_files(spark, tmp_path):
    xdr, a, c = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/chart"
    mark = lambda tag, row, col: f"<xdr:{tag}><xdr:col>{col}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:{tag}>"
    pic = '<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="1" name="logo"/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill><xdr:spPr/></xdr:pic>'
    frame = f'<xdr:graphicFrame><a:graphic><a:graphicData><c:chart xmlns:c="{c}" r:id="rId2"/></a:graphicData></a:graphic></xdr:graphicFrame>'
    drawing = f'<xdr:wsDr xmlns:xdr="{xdr}" xmlns:a="{a}" xmlns:r="{R}"><xdr:twoCellAnchor>{mark("from", 9, 0)}{mark("to", 11, 1)}{pic}</xdr:twoCellAnchor><xdr:oneCellAnchor>{mark("from", 1, 3)}<xdr:ext cx="9525" cy="9525"/>{frame}</xdr:oneCellAnchor></xdr:wsDr>'
    chart = f'<c:chartSpace xmlns:c="{c}"><c:chart><c:plotArea><c:barChart><c:ser><c:cat><c:strRef><c:f>S!$A$2:$A$3</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>S!$B$2:$B$3</c:f></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
    more = {
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="rId1" Type="{R}/drawing" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": drawing, "xl/charts/chart1.xml": chart, "xl/media/image1.png": Canvas(20, 20).png(),
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="rId1" Type="{R}/image" Target="../media/image1.png"/><Relationship Id="rId2" Type="{R}/chart" Target="../charts/chart1.xml"/></Relationships>',
    }
    cells = {"A1": "Label", "B1": "Score", "A2": "A", "B2": 1, "A3": "B", "B3": 2.5}
    path = workbook(tmp_path / "b.xlsx", [("S", "visible", sheet_xml(cells, drawing=True))], more)
    out = run_and_write(spark, path, str(tmp_path / "out"), write_snapshots=True)["sheets"]["S"]
    assert out["regions"] == ["A1:B3", "D2:J12", "A10:B12"]
    assert [i["path"] for i in out["images"]] == ["images/IMG001_A10_B12_logo.png"] and (tmp_path / "out/S/images/IMG001_A10_B12_logo.png").exists()
    chart = out["charts"][0]
    assert chart["kind"] == "BarChart" and [s["role"] for s in chart["sources"]] == ["cat", "val"] and chart["sources"][1]["values"] == [[1], [2.5]] and "cached_values" not in chart["sources"][1] and (tmp_path / "out/S" / chart["path"]).exists()
    assert {p["strategy"] for p in out["snapshot_plan"]} == {"full_region", "embedded_image"}
    assert chart["path"] == "charts/CHART001_D2_J12_Chart_1.png"
    rows = json.loads((tmp_path / "out/info_regions_summary.json").read_text())["sheets"]
    assert [(r["sheet_name"], r["region_count"], r["image_count"], r["chart_count"]) for r in rows] == [("S", 3, 1, 1)]
    assert [s["path"] for s in out["snapshots"]] == ["snapshots/R001_S001_full_region_A1_B3.png", "snapshots/R002_S001_full_region_D2_J12.png"]
    assert all((tmp_path / "out/S" / s["path"]).exists() for s in out["snapshots"]) and out["region_images"] == out["snapshots"]
    # one picture of an anchor by its cells, where grouped ones aren't wanted
    assert extract_workbook_info_regions(spark, path, config=Config(include_grouped_drawing_images=False, include_charts=False))["sheets"]["S"]["info_regions"] == ["A1:B3", "A10:B12"]


def test_files_of_a_bare_run(spark, tmp_path):
    path = workbook(tmp_path / "c.xlsx", [("One", "visible", sheet_xml({"A1": "hello"}))])
    (tmp_path / "out/One/charts").mkdir(parents=True)
    off = {"include_images": False, "extract_embedded_images": False, "extract_chart_images": False}
    run_and_write(spark, path, str(tmp_path / "out"), overrides=off)
    own = json.loads((tmp_path / "out/One/info_regions.json").read_text())
    assert own["region_images"] == [] and own["charts"] == [] and not (tmp_path / "out/One/snapshot_plan.json").exists()
    assert not (tmp_path / "out/One/charts").exists() and (tmp_path / "out/One/info_regions.png").exists()


def test_snapshots_of_a_large_table(spark, tmp_path):
    cells = {f"{c}{r}": r * k for r in range(2, 151) for k, c in enumerate("ABC", 1)} | {"A1": "A", "B1": "B", "C1": "C"}
    path = workbook(tmp_path / "d.xlsx", [("Large", "visible", sheet_xml(cells))])
    (tmp_path / "out/Large/snapshots").mkdir(parents=True)
    (tmp_path / "out/Large/snapshots/old.png").write_bytes(b"")
    run_and_write(spark, path, str(tmp_path / "out"), overrides={"include_images": False, "extract_embedded_images": False}, write_snapshots=True)
    plan = json.loads((tmp_path / "out/Large/snapshot_plan.json").read_text())
    assert [(p["region_id"], p["strategy"], p["snapshot_mode"], p["is_split"]) for p in plan] == [("R001", "large_table_sampled", "split", True)]
    assert [(s["kind"], s["render"]) for s in plan[0]["snapshots"]][0] == ("overview", False)
    shown = [s for s in plan[0]["snapshots"] if s["render"]]
    assert shown and all(s["snapshot_mode"] == "split" and s["is_split"] for s in shown)
    files = {s["path"] for s in shown}
    assert {f"snapshots/{f.name}" for f in (tmp_path / "out/Large/snapshots").iterdir()} == files
    assert all(image_pixels((tmp_path / "out/Large" / f).read_bytes())[0] > 100 for f in files)


def test_broken_files_leave_the_others(spark, tmp_path):
    good = sheet_xml({"A1": "x", "A2": "y"})
    workbook(tmp_path / "good.xlsx", [("S", "visible", good)])
    (tmp_path / "nozip.xlsx").write_bytes(b"not a zip")
    whole = (tmp_path / "good.xlsx").read_bytes()
    (tmp_path / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    workbook(tmp_path / "xml.xlsx", [("S", "visible", good[:-9]), ("T", "visible", good)])
    workbook(tmp_path / "string.xlsx", [("S", "visible", good.replace('t="inlineStr"><is><t>x</t></is>', 't="s"><v>7</v>'))])
    workbook(tmp_path / "style.xlsx", [("S", "visible", good)], {"xl/styles.xml": "<oops"})
    errors = workbook_errors(spark, f"{tmp_path}/*.xlsx").collect()
    assert sorted(r.workbook.rsplit("/", 1)[1] for r in errors) == ["cut.xlsx", "nozip.xlsx", "string.xlsx", "style.xlsx", "xml.xlsx"] and all(r.error for r in errors)
    found = {(r.workbook.rsplit("/", 1)[1], r.sheet, r.range_ref) for r in extract_regions(spark, f"{tmp_path}/*.xlsx").collect()}
    assert found == {("good.xlsx", "S", "A1:A2"), ("xml.xlsx", "T", "A1:A2"), ("style.xlsx", "S", "A1:A2")}
    for name in ("nozip", "cut", "xml", "string"):
        with pytest.raises(ValueError):
            extract_workbook_info_regions(spark, str(tmp_path / f"{name}.xlsx"))
    with pytest.raises(ValueError):
        extract_workbook_info_regions(spark, f"{tmp_path}/*.xlsx")


def test_cells_without_a_place_follow_each_other(spark, tmp_path):
    xml = f'<worksheet xmlns="{M}"><sheetData><row><c><v>1</v></c><c><v>2</v></c></row><row r="5"><c r="C5"><v>3</v></c><c><v>4</v></c></row><row><c><v>5</v></c></row></sheetData></worksheet>'
    path = workbook(tmp_path / "e.xlsx", [("S", "visible", xml)])
    cells = read_workbooks(spark, path)["cells"].select("row", "col", "text", "type").collect()
    assert sorted(map(tuple, cells)) == [(1, 1, "1", "n"), (1, 2, "2", "n"), (5, 3, "3", "n"), (5, 4, "4", "n"), (6, 1, "5", "n")]


def test_image_sizes():
    webp = b"RIFF\0\0\0\0WEBP" + b"VP8X" + b"\0" * 8 + (199).to_bytes(3, "little") + (99).to_bytes(3, "little")
    tiff = b"II*\0" + (8).to_bytes(4, "little") + b"\2\0" + b"".join(t.to_bytes(2, "little") + b"\4\0\1\0\0\0" + v.to_bytes(4, "little") for t, v in ((256, 320), (257, 240)))
    assert [image_pixels(x) for x in (Canvas(7, 5).png(), b"", webp, tiff, b"II*\0")] == [(7, 5), (64, 64), (200, 100), (320, 240), (64, 64)]


def test_texts_are_cut_at_their_room():
    canvas, dark = Canvas(40, 10), (0, 0, 0)
    canvas.text(1, 1, "I1é", dark, 1, room=8)
    shown = [[canvas.rows[y][3 * x] == 0 for x in range(12)] for y in range(1, 6)]
    assert [[int(v) for v in row[1:4]] for row in shown] == [[1, 1, 1], [0, 1, 0], [0, 1, 0], [0, 1, 0], [1, 1, 1]]
    assert any(any(row[5:8]) for row in shown) and not any(any(row[9:]) for row in shown)


def test_workbooks_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    workbook(tmp_path / "in/a.xlsx", [("S", "visible", sheet_xml({"B2": "x"}))])
    (tmp_path / "in/b.xlsx").write_bytes(b"bad")
    rows = stream_workbooks(spark, str(tmp_path / "in"))
    rows.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start().awaitTermination(120)
    t = tables(spark.table("arrived"))
    assert [tuple(r) for r in t["cells"].select("sheet", "row", "col", "text").collect()] == [("S", 2, 2, "x")] and t["errors"].count() == 1
