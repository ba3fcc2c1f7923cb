"""Command line: regions of a workbook as files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.engine import run_and_write


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--workbook", required=True)
    p.add_argument("--sheet")
    p.add_argument("--config")
    p.add_argument("--out", default="outputs/info_regions")
    p.add_argument("--no-overlay", "--no-images", dest="overlay", action="store_false")
    p.add_argument("--snapshots", action="store_true")
    p.add_argument("--respect-hidden", action="store_true")
    p.add_argument("--use-print-area", action="store_true")
    a = p.parse_args(argv)
    overrides = {"respect_hidden_rows_cols": True, "respect_hidden_sheets": True} if a.respect_hidden else {}
    overrides |= {"use_print_area_bounds": True} if a.use_print_area else {}
    spark = SparkSession.builder.appName("sheetweave").getOrCreate()
    result = run_and_write(spark, a.workbook, a.out, a.sheet, a.config, overrides, a.overlay, a.snapshots)
    print(f"[sheetweave] sheets={len(result['sheets'])} -> {a.out}")
    for name, own in result["sheets"].items():
        print(f"  - {name}: regions={len(own['regions'])}, ranges={own['regions']}, images={len(own['images'])}")


if __name__ == "__main__":
    main()
