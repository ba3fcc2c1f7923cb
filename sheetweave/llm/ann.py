"""Approximate nearest neighbours by a permutation index.

The index is dealt into blocks of about BLOCK entries. A block chooses its pivots from its own first vectors, each next one
the farthest by angle from those before it, so a crowd of almost equal vectors gives few. A vector is represented by its
nearest pivots in order; each pivot's inverted file holds the vectors that have it among them, with its place. A query
reads the files of its own pivots, adds up how well the places agree (which orders vectors as the footrule distance of
the two permutations does), and the best SHARE of the block is reranked by the exact inner product in double precision.

Equal vectors are one entry of the index that keeps the smallest ids, TOP + 1 of them: no query needs more, because ties
go to the smaller id. Queries are dealt into blocks of QUERIES; every pair of blocks meets in a task of its own, so
neither grows with the input. Every entry of a block is in its files. A share of the block is reranked, whatever its
size, but never fewer entries than a query's answer and its own copies can take.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part. Vectors of
different lengths have no inner product: candidates are those of the query's length, and each length has blocks of its
own. Rows that repeat both id and vector are one row; other rows that repeat an id are candidates each, but not of that
id's own queries. Columns other than vec_id and embedding are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_join

TOP, EVERY, PIVOTS, PREFIX, SAMPLE = 20, 20, 256, 128, 2000
BLOCK, QUERIES, SHARE = 4096, 8192, 0.15


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return rows.withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(most, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return sample[chosen]


def permutations(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    near = -(v @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, : min(PREFIX, len(pivots))]


class InvertedFiles:
    """A file for each pivot: the places from the end of its prefix at which the entries hold it, 0 where they don't."""

    def __init__(self, v: np.ndarray, pivots: np.ndarray):
        order = permutations(v, pivots)
        self.v, self.pivots, self.length = v, pivots, order.shape[1]
        files = np.zeros((len(v), len(pivots)), np.uint8)
        np.put_along_axis(files, order, np.arange(self.length, 0, -1, dtype=np.uint8)[None], axis=1)
        self.files = np.ascontiguousarray(files.T)

    def nearest(self, query: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The most entries that come first by footrule distance, and their inner products."""
        agree = np.zeros(len(self.v), np.uint16)
        for j, pivot in enumerate(order):
            agree += np.minimum(self.files[pivot], np.uint8(self.length - j))
        most = min(len(self.v), most)
        found = np.argpartition(agree, len(agree) - most)[len(agree) - most :]
        return found, self.v[found] @ query


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose vec_id is divisible by every."""
    rows = _valid(vectors).dropDuplicates(["key", "vec_id"])
    by_id = Window.partitionBy("key").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= top + 1)
    entries = cut(first.groupBy("key").agg(F.min_by("v", "n").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("n", F.size("v")))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    wanted = entries.join(asked.select("key").distinct(), "key", "left_semi")
    parts = lambda df, size, name: df.groupBy("n").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = cut(parts(entries, block, "blocks").join(parts(wanted, QUERIES, "groups"), "n"))
    number = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = salted_join(entries, sizes, "n", "key").select("n", F.col("v").alias("stored"), "ids", number("blocks", 1).alias("block"), every_of("groups").alias("part"))
    probes = salted_join(wanted, sizes, "n", "key").select((F.col("n") + 0).alias("n"), F.col("key").alias("probe"), F.col("v").alias("q"), number("groups", 2).alias("part"), every_of("blocks").alias("block"))

    def meet(probe: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(stored) and len(probe):
            v = np.stack(stored["stored"].to_numpy())
            v, ids = v[order := np.lexsort(v.T)], [np.asarray(stored["ids"].iloc[k]) for k in order]
            files = InvertedFiles(v, choose_pivots(v[:: max(1, len(v) // SAMPLE)][:SAMPLE]))
            q = np.stack(probe["q"].to_numpy())
            most = max(2 * top + 1, int(np.ceil(share * len(v))))
            for key, query, near in zip(probe["probe"], q, permutations(q, files.pivots), strict=True):
                found, score = files.nearest(query, near, most)
                cutoff = np.partition(score, len(score) - min(len(score), top + 1))[len(score) - min(len(score), top + 1)]
                best = np.flatnonzero(score >= cutoff)
                kept = sorted((-score[k], vec) for k in best for vec in ids[found[k]])[: 2 * top + 1]
                out.append((key, [p[1] for p in kept], [-p[0] for p in kept]))
        return pd.DataFrame(out, columns=["key", "ids", "scores"])

    met = probes.groupBy("n", "block", "part").cogroup(index.groupBy("n", "block", "part")).applyInPandas(meet, "key string, ids array<long>, scores array<double>")
    pairs = met.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("key", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * top + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    answers = salted_join(asked, lists, "key", "query_id").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("k", "x")).select("query_id", (F.col("k") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
