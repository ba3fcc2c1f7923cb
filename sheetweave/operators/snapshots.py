"""Snapshot plans: structure changes down a region, their clusters, and which parts of a region to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import KEY, SIDES, Box

MARGIN = 5
RKEY = (*KEY, *SIDES)


def region_rows(regions: DataFrame) -> DataFrame:
    return regions.select(*RKEY, F.explode(F.sequence("r0", "r1")).alias("row"))


def row_signatures(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """For each row of a region the sorted columns that hold anything, an empty text included."""
    filled = cells.where("text is not null").select(*KEY, "row", "col")
    held = regions.select(*RKEY).join(filled, [*KEY]).where(Box().contains_cell(F.col("row"), F.col("col")))
    per_row = held.groupBy(*RKEY, "row").agg(F.array_sort(F.collect_set("col")).alias("signature"))
    return region_rows(regions).join(per_row, [*RKEY, "row"], "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<int>")))


def change_point(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """change_row: the first row past the twentieth unlike the one above, or else the middle."""
    w = Window.partitionBy(*RKEY).orderBy("row")
    rows = row_signatures(regions, cells).withColumn("before", F.lag("signature").over(w))
    start = F.least(F.col("r1"), F.col("r0") + 20)
    first = rows.where((F.col("row") > start) & ~F.col("signature").eqNullSafe(F.col("before"))).groupBy(*RKEY).agg(F.min("row").alias("found"))
    return regions.select(*RKEY).join(first, [*RKEY], "left").select(*RKEY, F.coalesce("found", F.col("r0") + F.floor(Box().height / 2).cast("int")).cast("int").alias("change_row"))


def merge_structure(regions: DataFrame, merges: DataFrame, margin: int = MARGIN) -> DataFrame:
    """m_r0, m_r1 around each cluster of rows where the layout of merged columns changes to another, not to none."""
    m = merges.select(*KEY, *(F.col(s).alias("m_" + s) for s in SIDES))
    lo, hi = F.greatest("c0", "m_c0"), F.least("c1", "m_c1")
    spans = regions.select(*RKEY).join(m, [*KEY]).where((lo < hi) & (F.col("m_r0") <= F.col("r1")) & (F.col("m_r1") >= F.col("r0")))
    spans = spans.select(*RKEY, F.struct(lo.alias("lo"), hi.alias("hi")).alias("span"), F.explode(F.sequence(F.greatest("r0", "m_r0"), F.least("r1", "m_r1"))).alias("row"))
    signed = spans.groupBy(*RKEY, "row").agg(F.array_sort(F.collect_list("span")).alias("signature"))
    w = Window.partitionBy(*RKEY).orderBy("row")
    # rows without merged columns aren't there: a gap before a row is a change
    changed = (F.lag("row").over(w).isNull()) | (F.lag("row").over(w) < F.col("row") - 1) | ~F.col("signature").eqNullSafe(F.lag("signature").over(w))
    rows = signed.withColumn("changed", changed).where("changed").drop("changed")
    island = F.sum(F.when(F.col("row") - F.lag("row").over(w) <= margin, 0).otherwise(1)).over(w)
    grouped = rows.withColumn("island", island).groupBy(*RKEY, "island").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    return grouped.select(*RKEY, F.greatest("r0", F.col("a") - margin).alias("m_r0"), F.least("r1", F.col("b") + margin).alias("m_r1"))


def coalesce_samples(samples: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Samples (kind, purpose, s_r0, s_r1, n) of a region joined where their gap is small; kinds and purposes in order."""
    w = Window.partitionBy(*RKEY).orderBy("s_r0", "n")
    top = F.max("s_r1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = samples.withColumn("island", F.sum(F.when(F.col("s_r0") - top <= margin, 0).otherwise(1)).over(w))
    listed = islands.groupBy(*RKEY, "island").agg(F.min("s_r0").alias("s_r0"), F.max("s_r1").alias("s_r1"), F.array_sort(F.collect_list(F.struct("s_r0", "n", "kind", "purpose"))).alias("x"))
    text = lambda name, glue: F.array_join(F.array_distinct(F.transform("x", lambda x: x[name])), glue)
    return listed.select(*RKEY, "island", text("kind", "+").alias("kind"), text("purpose", "; ").alias("purpose"), "s_r0", "s_r1")


#: What each sample of a large region is for.
PURPOSES = {
    "overview": "metadata only; do not render the full region", "header": "title, column headers, units, notes", "first_rows": "early data row pattern",
    "change_points": "possible structure change around the sampled row", "last_rows": "ending rows, totals, footnotes", "merge_structure": "column merge structure changes",
    "full_region": "complete small information region",
}


def snapshot_plan(regions: DataFrame, cells: DataFrame, merges: DataFrame, image_refs: DataFrame) -> DataFrame:
    """A row for each region: counts, strategy and an array of snapshots. image_refs has workbook, sheet, range_ref."""
    region = regions.select(*RKEY).distinct()
    m = merges.select(*KEY, *(F.col(s).alias("m_" + s) for s in SIDES))
    merged = region.join(m, [*KEY]).where(Box().intersects(Box("m_"))).groupBy(*RKEY).agg(F.count("*").alias("merged_cell_count"))
    formulas = region.join(cells.where(F.col("text").startswith("=")).select(*KEY, "row", "col"), [*KEY]).where(Box().contains_cell(F.col("row"), F.col("col"))).groupBy(*RKEY).agg(F.count("*").alias("formula_count"))
    images = image_refs.select(*KEY, F.col("range_ref").alias("region_range")).distinct().withColumn("is_image", F.lit(True))
    base = region.withColumn("region_range", Box().range_ref).join(images, [*KEY, "region_range"], "left")
    kind = F.when(F.col("is_image"), "embedded_image").when((Box().height > 120) | (Box().area > 1000), "large_table_sampled").otherwise("full_region")
    base = base.withColumn("strategy", kind).drop("is_image")
    large = base.where("strategy = 'large_table_sampled'").select(*RKEY)
    r0, r1 = F.col("r0"), F.col("r1")
    part = lambda n, name, a, b: F.struct(F.lit(n).alias("n"), F.lit(name).alias("kind"), F.lit(PURPOSES[name]).alias("purpose"), a.cast("int").alias("s_r0"), b.cast("int").alias("s_r1"))
    at = F.greatest(r0, F.least(r1, F.col("change_row")))
    fixed = change_point(large, cells).select(*RKEY, F.explode(F.array(
        part(0, "header", r0, F.least(r1, r0 + 19)), part(1, "first_rows", F.least(r1, r0 + 20), F.least(r1, r0 + 59)),
        part(2, "change_points", F.greatest(r0, at - 20), F.least(r1, at + 20)), part(3, "last_rows", F.greatest(r0, r1 - 47), r1),
    )).alias("p")).select(*RKEY, "p.*")
    shaped = merge_structure(large, merges).select(*RKEY, part(4, "merge_structure", F.col("m_r0"), F.col("m_r1")).alias("p")).select(*RKEY, "p.*")
    joined = coalesce_samples(fixed.unionByName(shaped))
    ref = lambda a, b: Box(sides=(a, F.col("c0"), b, F.col("c1"))).range_ref
    listed = joined.groupBy(*RKEY).agg(F.array_sort(F.collect_list(F.struct("island", "kind", ref(F.col("s_r0"), F.col("s_r1")).alias("range_ref"), "purpose"))).alias("s"))
    number = lambda k: F.concat(F.lit("S"), F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string")))
    shot = lambda k, name, rng, why, render, mode, split: F.struct(number(k).alias("snapshot_id"), name.alias("kind"), rng.alias("range_ref"), why.alias("purpose"), F.lit(render).alias("render"), F.lit(mode).alias("snapshot_mode"), F.lit(split).alias("is_split"))
    rendered = F.transform("s", lambda x, k: shot(k + 2, x["kind"], x["range_ref"], x["purpose"], True, "split", True))
    overview = F.array(shot(F.lit(1), F.lit("overview"), F.col("region_range"), F.lit(PURPOSES["overview"]), False, "metadata", False))
    whole = F.array(shot(F.lit(1), F.lit("full_region"), F.col("region_range"), F.lit(PURPOSES["full_region"]), True, "full", False))
    none = F.slice(whole, 1, 0)
    out = base.join(merged, [*RKEY], "left").join(formulas, [*RKEY], "left").join(listed, [*RKEY], "left")
    is_large = F.col("strategy") == "large_table_sampled"
    mode = F.when(F.col("strategy") == "embedded_image", "none").when(is_large, "split").otherwise("full")
    return out.select(
        *RKEY, "region_range", Box().height.alias("row_count"), Box().width.alias("col_count"), F.coalesce("merged_cell_count", F.lit(0)).alias("merged_cell_count"),
        F.coalesce("formula_count", F.lit(0)).alias("formula_count"), "strategy", mode.alias("snapshot_mode"), is_large.alias("is_split"),
        F.when(F.col("strategy") == "embedded_image", none).when(is_large, F.concat(overview, F.coalesce(rendered, none))).otherwise(whole).alias("snapshots"),
    )
