"""Connected components within sheets; the label of a component is its smallest node, which also orders the components.

A sheet is cut into bands of rows that kernels label by themselves. Where cells of two bands touch, their labels are
linked; the links of a sheet, at most a few for each column and band, are closed over by one small kernel run, and labels
are replaced by a join. So no task's share grows with a sheet. What is grouped afterwards is native.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import KEY
from .lineage import cut

#: Rows of a band.
BAND = 16_384
#: A cell as one number: its row times this, plus its column.
_ROW = 1 << 20


def label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of 0..n-1 that each reaches over the links a-b."""
    out = np.arange(n)
    while len(a):
        x, y = out[a], out[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(out, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := out[out], out):
            out = up
    return out


def cell_components(cells: DataFrame, connectivity: int = 8, band: int = BAND) -> DataFrame:
    """workbook, sheet, row, col, label_row, label_col of distinct cells; anything but 4 means 8 neighbours."""
    steps = [(0, 1), (1, 0)] + ([] if connectivity == 4 else [(1, 1), (1, -1)])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.sort(pdf["row"].to_numpy(np.int64) * _ROW + pdf["col"].to_numpy(np.int64))
        a, b = [], []
        for dr, dc in steps:
            want = key + dr * _ROW + dc
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
            a.append(hit)
            b.append(at[hit])
        first = label(len(key), np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"workbook": pdf["workbook"].iloc[0], "sheet": pdf["sheet"].iloc[0], "row": key // _ROW, "col": key % _ROW, "label": key[first]})

    rows = cells.select(*KEY, F.col("row").cast("int"), F.col("col").cast("int")).distinct().withColumn("band", F.floor(F.col("row") / band))
    own = cut(rows.groupBy(*KEY, "band").applyInPandas(kernel, "workbook string, sheet string, row int, col int, label long"))
    above = own.where(F.col("row") % band == band - 1).select(*KEY, (F.col("row") + 1).alias("row"), F.explode(F.array(*(F.col("col") + dc for dr, dc in steps if dr))).alias("col"), F.col("label").alias("a"))
    links = above.join(own.where(F.col("row") % band == 0).withColumnRenamed("label", "b"), [*KEY, "row", "col"]).select(*KEY, "a", "b").distinct()
    return _relabelled(own, links).select(*KEY, "row", "col", F.floor(F.col("label") / _ROW).cast("int").alias("label_row"), (F.col("label") % _ROW).cast("int").alias("label_col"))


def _relabelled(own: DataFrame, links: DataFrame) -> DataFrame:
    """own with each label replaced by the smallest that it reaches over the links a, b."""

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, place = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        place = place.reshape(-1, 2)
        first = label(len(nodes), place[:, 0], place[:, 1])
        return pd.DataFrame({"workbook": pdf["workbook"].iloc[0], "sheet": pdf["sheet"].iloc[0], "label": nodes, "root": nodes[first]})

    roots = links.groupBy(*KEY).applyInPandas(close, "workbook string, sheet string, label long, root long")
    return own.join(roots, [*KEY, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def component_boxes(cells: DataFrame, connectivity: int = 8, min_cells: int = 1) -> DataFrame:
    """workbook, sheet, label_row, label_col, r0, c0, r1, c1, n_cells of components of at least min_cells cells."""
    labelled = cell_components(cells, connectivity)
    found = labelled.groupBy(*KEY, "label_row", "label_col").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.count("*").alias("n_cells"))
    return found.where(F.col("n_cells") >= min_cells)


def pair_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """workbook, sheet, node, root for integer nodes and pairs (a, b) of each sheet."""

    def kernel(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node", ignore_index=True)
        own = nodes["node"].to_numpy()
        first = label(len(own), *(np.searchsorted(own, pairs[c].to_numpy()) for c in ("a", "b")))
        nodes["root"] = own[first]
        return nodes

    return nodes.select(*KEY, "node").distinct().groupBy(*KEY).cogroup(pairs.select(*(F.col(k).alias(k) for k in KEY), "a", "b").groupBy(*KEY)).applyInPandas(kernel, "workbook string, sheet string, node long, root long")


def edge_components(edges: DataFrame, band: int = BAND) -> DataFrame:
    """Edges (kind, a, b) with a component number, from 1 on in the order of their smallest edges ("h" before "v")."""
    wide = _ROW << 1

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "a", "b"], ignore_index=True)
        a, b, across = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64), (pdf["kind"] == "h").to_numpy()
        one, other = a * wide + b, np.where(across, a, a + 1) * wide + np.where(across, b + 1, b)
        ends, edge = np.concatenate([one, other]), np.tile(np.arange(len(a)), 2)
        order = np.argsort(ends, kind="stable")
        meet = np.flatnonzero(ends[order][1:] == ends[order][:-1])
        first = label(len(a), edge[order][meet], edge[order][meet + 1])
        # a number for each edge that sorts as kind, a, b do
        pdf["label"] = (np.where(across, 0, 1 << 60) + one)[first]
        return pdf.drop(columns="band")

    rows = edges.select(*KEY, "kind", F.col("a").cast("int"), F.col("b").cast("int")).distinct().withColumn("band", F.floor(F.col("a") / band))
    own = cut(rows.groupBy(*KEY, "band").applyInPandas(kernel, "workbook string, sheet string, kind string, a int, b int, label long"))
    # the last rows' vertical edges reach the points where the next band begins
    last = own.where((F.col("kind") == "v") & (F.col("a") % band == band - 1)).select(*KEY, (F.col("a") + 1).alias("row"), F.col("b").alias("col"), F.col("label").alias("l"))
    next_ = own.where(F.col("a") % band == 0).select(*KEY, F.col("a").alias("row"), F.explode(F.when(F.col("kind") == "h", F.array("b", F.col("b") + 1)).otherwise(F.array("b"))).alias("col"), F.col("label").alias("m"))
    links = last.join(next_, [*KEY, "row", "col"]).select(*KEY, F.col("l").alias("a"), F.col("m").alias("b")).distinct()
    out = _relabelled(own, links)
    # numbers run on from band to band, so that no task orders all of a sheet's labels
    labels = out.select(*KEY, "label").distinct().withColumn("at", F.floor(F.col("label") / (wide * band)))
    before = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = labels.groupBy(*KEY, "at").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = labels.withColumn("n", F.row_number().over(Window.partitionBy(*KEY, "at").orderBy("label")))
    number = within.join(start, [*KEY, "at"]).select(*KEY, "label", (F.col("start") + F.col("n")).cast("int").alias("component"))
    return out.join(number, [*KEY, "label"]).select(*KEY, "kind", "a", "b", "component")
