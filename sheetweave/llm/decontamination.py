"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased runs of letters and digits. Fixed masks over a few words hash the words at their set places and
ignore the others; equal hashes of a document and a benchmark item are hits. Around each hit the words are compared at
the hit's alignment: an overlap is a stretch of WINDOW words (or the whole item, if shorter) with the hit in it, of which
at most a fifth differ. The masks are a family that loses none of these: whichever 3 of 15 words, or 2 of 12 to 14, are
substituted, a mask fits somewhere into the others. Items of under SPACED words, down to a single word, are found by an
unspaced mask of their own length and must be whole.

Hits are found without a shuffle where the benchmark's seeds number at most BROADCAST_SEEDS, which is counted first; a
larger benchmark is taken in parts of that size, each in a pass of its own, so what is broadcast has that bound. clean()
broadcasts the overlapping rows' ids and hashes where they number at most BROADCAST_ROWS, and else joins by a shuffle.

Null and empty texts on either side overlap nothing. Rows that repeat an id count together under it, null as an id like
any other; clean() judges each row by its own text. Of equally good overlaps all count for the first and the last word.
Columns other than ids and text are not read. Empty tables give an empty result. Long texts are searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Places of a window that a seed reads.
MASKS = ("111100001", "111010001", "100011101")
SPACED, WINDOW, PART = 12, 15, 5
BROADCAST_SEEDS, BROADCAST_ROWS = 2_000_000, 500_000


def words(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(found, lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, column: str, at: str, masks: list[str]) -> DataFrame:
    """A row for each mask and place where the mask fits into the words."""
    width = min(map(len, masks))
    placed = rows.where(F.size(column) >= width).select("*", F.explode(F.sequence(F.lit(0), F.size(column) - width)).alias(at))
    read = lambda k, m: F.xxhash64(F.lit(k), *(F.get(column, F.col(at) + o) for o, bit in enumerate(m) if bit == "1"))
    hashes = [F.when(F.col(at) + len(m) <= F.size(column), F.struct(read(k, m).alias("hash"), F.lit(len(m)).alias("span"), F.lit("0" not in m).alias("whole"))) for k, m in enumerate(masks)]
    one = placed.select("*", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")
    return one.select(*(c for c in placed.columns), F.col("seed.hash").alias("hash"), F.col("seed.span").alias("span"), F.col("seed.whole").alias("whole"))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, first_word and last_word of the document in overlaps (from 0), mismatches of the best one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0)
    lengths = [r.n for r in items.where(F.size("item") < SPACED).select(F.size("item").alias("n")).distinct().collect()]  # 11 at most
    masks = [*MASKS, *("1" * n for n in sorted(lengths))]
    # an unspaced mask is for items of just that length
    seeds = _seeds(items, "item", "item_at", masks).where(f"if(whole, span = size(item), size(item) >= {SPACED})").select("item_id", "item_at", "hash", "span", "whole")
    totals = seeds.agg(F.count("*").alias("n")).first().n
    parts = -(-totals // broadcast_seeds) or 1
    tokens = docs.select("doc_id", words(F.col("text")).alias("doc"))
    spread = _seeds(tokens, "doc", "doc_at", masks).drop("span", "whole")
    found = reduce(DataFrame.unionByName, (_verified(spread.join(F.broadcast(seeds.where(F.pmod("hash", F.lit(parts)) == k)), "hash"), items, totals <= broadcast_seeds) for k in range(parts)))
    return found.groupBy("doc_id", "item_id").agg(F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"), F.min("mismatches").cast("long").alias("mismatches"))


def _verified(hits: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    named = items.select(F.col("item_id").alias("own_id"), "item").distinct()
    hits = hits.join(F.broadcast(named) if small else named, F.col("item_id").eqNullSafe(F.col("own_id")))
    size = F.when(F.col("whole"), F.size("item")).otherwise(F.least(F.lit(WINDOW), F.size("item")))
    hits = hits.withColumn("w", size).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    lo = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - F.col("w"), -F.col("shift"))
    hi = F.least(F.col("item_at"), F.size("item") - F.col("w"), F.size("doc") - F.col("w") - F.col("shift"))
    differ = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.col("w") - 1), lambda j: F.get("item", s + j) != F.get("doc", F.col("shift") + s + j)))
    tried = F.transform(F.sequence("lo", "hi"), lambda s: F.struct((F.col("shift") + s).alias("at"), differ(s).alias("bad")))
    most = F.when(F.col("whole"), 0).otherwise(F.floor(F.col("w") / PART))
    good = hits.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("doc_id", "item_id", "w", F.filter(tried, lambda x: x["bad"] <= most).alias("good")).where(F.size("good") > 0)
    at = F.transform("good", lambda x: x["at"])
    return good.select("doc_id", "item_id", F.array_min(at).alias("first"), (F.array_max(at) + F.col("w") - 1).alias("last"), F.array_min(F.transform("good", lambda x: x["bad"])).alias("mismatches"))


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs whose text has no overlap with the benchmark."""
    row = F.struct(docs["doc_id"], F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    found = cut(overlaps(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("found")).distinct())
    few = found.count() <= broadcast_rows
    return docs.join(F.broadcast(found) if few else found, row == found["found"], "left_anti")


def _sql() -> str:
    span = len(MASKS[0])
    key = lambda t, m: " || ' ' || ".join(f"{t}.w[{t}.p + {o + 1}]" for o, bit in enumerate(m) if bit == "1")
    seeds = lambda t, more: " UNION ALL ".join(f"SELECT {t}.id, {t}.p, {k} AS m, {key(t, m)} AS k FROM {t} WHERE {t}.p + {span} <= len({t}.w){more}" for k, m in enumerate(MASKS))
    listed = lambda name, i: f"SELECT {i} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {name}"
    return f"""
WITH dw AS ({listed('documents', 'doc_id')}), bw AS ({listed('benchmark', 'item_id')}),
d AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM dw), b AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM bw),
ds AS ({seeds('d', '')}), bs AS ({seeds('b', f' AND len(b.w) >= {SPACED}')}),
h AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS shift, bs.p AS q FROM ds JOIN bs ON ds.m = bs.m AND ds.k = bs.k),
t AS (SELECT doc_id, item_id, shift, least({WINDOW}, len(bw.w)) AS n, dw.w AS dw, bw.w AS bw,
  unnest(range(greatest(0, q + {span} - least({WINDOW}, len(bw.w)), -shift), least(q, len(bw.w) - least({WINDOW}, len(bw.w)), len(dw.w) - least({WINDOW}, len(bw.w)) - shift) + 1)) AS s
  FROM h JOIN dw ON dw.id = doc_id JOIN bw ON bw.id = item_id),
v AS (SELECT doc_id, item_id, shift + s AS first, shift + s + n - 1 AS last, n, len(list_filter(range(0, n), lambda j: bw[s + j + 1] <> dw[shift + s + j + 1])) AS bad FROM t),
o AS (SELECT doc_id, item_id, first, last, bad FROM v WHERE bad <= n // {PART}
  UNION ALL SELECT d.id, bw.id, d.p, d.p + len(bw.w) - 1, 0 FROM d JOIN bw ON len(bw.w) BETWEEN 1 AND {SPACED - 1} AND d.w[d.p + 1] = bw.w[1] AND d.w[d.p + 1:d.p + len(bw.w)] = bw.w)
SELECT doc_id, item_id, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word, min(bad)::BIGINT AS mismatches FROM o GROUP BY ALL
"""


SQL = _sql()
