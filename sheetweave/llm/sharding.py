"""Sharding by extendible hashing, in DataFrame operations only.

A document's hash is the first 32 bits of its id's MD5. The directory starts at no bits; a bucket that holds more than
the byte limit splits on the next bit of the hash, others stay as they are. Sizes are added up once for prefixes some
bits deeper than the mean shard needs, and the directory is worked out on that table, one row for each prefix, whatever
the number of documents. A bucket that is still too large at that depth goes on bit by bit over its own rows. Where
no bit is left (ids repeat, so that their hashes are the same), rows are numbered within classes of sizes, each up to a
power of two, and dealt to pages that hold the limit at the class's size; a single text over the limit is a page of its own.

A shard is named by its bits (the empty string: the whole table) and, on such pages, "+" with the class and the page's number. Bytes are
those of the UTF-8 text; null and empty texts have none. Null ids hash like the empty string. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LIMIT, BITS, SPARE = 1 << 20, 32, 8
#: Rows alike that one task writes out.
STRETCH = 100_000


def _bits(doc_id: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 2), BITS, "0")


def directory(sizes: DataFrame, limit: int, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Of (bits, n): prefix of the buckets that fit, at lengths first to last; and prefixes too large at the last."""
    at = sizes.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d"), "bits", "n")
    held = at.groupBy(F.expr("substring(bits, 1, d)").alias("prefix")).agg(F.sum("n").alias("n"))
    fits = held.select("prefix", F.length("prefix").alias("d"), (F.col("n") <= limit).alias("fits"))
    parent = fits.select(F.col("prefix").alias("up"), F.col("fits").alias("up_fits"))
    kept = fits.where("fits").withColumn("up", F.expr("substring(prefix, 1, d - 1)"))
    whole = kept.where(F.col("d") == first).select("prefix")
    split = kept.where(F.col("d") > first).join(parent, "up").where("not up_fits").select("prefix")
    return whole.unionByName(split), fits.where((F.col("d") == last) & ~F.col("fits")).select("prefix")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth of every row."""
    # texts are read once: what follows goes over ids, sizes and bits
    rows = cut(docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), _bits(F.col("doc_id")).alias("bits")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    done, rest, first = None, rows, 0
    depth = min(BITS, max(0, (total // limit).bit_length()) + SPARE)
    while True:
        last = depth
        leaf = F.expr(f"substring(bits, 1, {last})")
        sizes = rest.groupBy(leaf.alias("bits")).agg(F.sum("n_bytes").alias("n"))
        found, over = directory(sizes, limit, first, last)
        named = _dealt(rest, found, first, last)
        done = named if done is None else done.unionByName(named)
        if over.limit(1).count() == 0:
            return done
        rest = rest.join(over, leaf == over.prefix, "left_semi")
        if last == BITS:
            return done.unionByName(_pages(rest, limit))
        first, depth = last + 1, min(BITS, last + SPARE)


def _dealt(rows: DataFrame, found: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with the bucket of the directory that is a prefix of their bits: by the leaves of each bucket, an equi-join."""
    leaf = F.expr(f"substring(bits, 1, {last})")
    leaves = rows.select(leaf.alias("leaf")).distinct()
    tried = leaves.select("leaf", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d")).withColumn("prefix", F.expr("substring(leaf, 1, d)"))
    shard_of = tried.join(found, "prefix").select("leaf", F.col("prefix").alias("shard"))
    return rows.join(shard_of, leaf == shard_of.leaf).select("doc_id", "n_bytes", "shard", F.length("shard").cast("long").alias("depth"))


def _pages(rows: DataFrame, limit: int, stretch: int = STRETCH) -> DataFrame:
    """Rows that no bit parts, numbered within a class of sizes (up to a power of two) and dealt to pages of as many as fit."""
    alike = rows.groupBy("bits", "doc_id", "n_bytes").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.col("n_bytes"))
    alike = alike.withColumn("class", F.ceil(F.log2(size.cast("double"))).cast("int"))
    before = Window.partitionBy("bits", "class").orderBy("n_bytes", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # many rows alike are written out by stretches, each by another task
    parts = placed.select("bits", "doc_id", "n_bytes", "class", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(stretch).cast("long"))).alias("from"))
    parts = parts.repartition(F.col("bits"), F.col("class"), F.col("first"), F.col("from"))
    each = parts.select("bits", "doc_id", "n_bytes", "class", "first", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + stretch) - 1)).alias("k"))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.pow(F.lit(2.0), F.col("class"))))
    number = F.floor((F.col("first") + F.col("k")) / fit).cast("long")
    return each.select("doc_id", "n_bytes", F.concat_ws("+", "bits", "class", number).alias("shard"), F.lit(BITS).cast("long").alias("depth"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    (('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 8))::BIGINT)::BIT::VARCHAR AS b
  FROM documents),
h AS (SELECT doc_id, n_bytes, right(b, {BITS}) AS bits FROM d),
s AS (SELECT substr(bits, 1, k) AS prefix, k, sum(n_bytes) AS n FROM h, range(0, {BITS + 1}) r(k) GROUP BY ALL),
f AS (SELECT s.prefix FROM s LEFT JOIN s u ON u.k = s.k - 1 AND u.prefix = substr(s.prefix, 1, s.k - 1)
  WHERE s.n <= {LIMIT} AND (s.k = 0 OR u.n > {LIMIT}))
SELECT h.doc_id, h.n_bytes, f.prefix AS shard, length(f.prefix)::BIGINT AS depth
FROM h JOIN f ON f.prefix = substr(h.bits, 1, length(f.prefix))
"""
