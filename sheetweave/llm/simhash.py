"""SimHash near-duplicates by BK-trees.

Fingerprints: texts' shingles are hashed by XXH64 and a bit is set where over half the hashes have it. Any two
fingerprints that differ in at most RADIUS of 64 bits agree in two of five bit blocks, so the distinct fingerprints are
dealt to shards by each of the ten pairs of blocks. A shard's BK-tree (children keyed by their integer distance to the
parent) is walked from all its members at once along the edges within the radius, and what is linked is reported as a
tree of links, one fewer than its members, so a group of copies never becomes all its pairs. Links are joined to
components by large-star and small-star steps over tables in the shared folder.

A tree goes to the one task that holds its probes instead of being broadcast: the trees of all shards together grow with
the corpus, and no bound on them can be proven. A shard of more than SHARD fingerprints is cut into blocks; each two of
them meet in a task of their own, so none grows with a hot key.

keep_one takes texts for near-duplicates where the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Fingerprints of such sets differ in up to FILTER bits, for which no blocks of 64 bits are sure to agree, so their shards
are keyed by min-hash bands (a pair at just 0.8 shares none with a probability of 3e-6). What the BK-trees link within
FILTER bits is a coarse group; in a group true similarities decide, so no unlike texts are joined.

Null and empty texts, and texts of separators only, have fingerprint zero, which is linked like any other; keep_one takes
their empty sets for alike. Rows with the same text share a fingerprint and a component. Repeated ids are kept as rows.
Null ids take part and come out as null. Of each component keep_one keeps the row with the smallest id (null: last; of
one id, that with the smallest hash of its text; of rows alike in both, that with the smallest hash of all columns).
Columns other than doc_id and text are not read by near_duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_buffer, cut, salted_join, slices
from .shingles import BANDS, GROUP, LEAST, WIDTH, band_keys, joined_by_similarity, set_fingerprints, shingle_sets

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Bits by which fingerprints of shingle sets with a similarity of LEAST differ at most: 9.7 are to be expected, 2.9 being the deviation.
FILTER = 22
#: Fingerprints of a shard that are taken in one tree.
SHARD = 20_000
#: Links that one task finishes: 16 bytes each, and some arrays of that length.
WHOLE = 2_000_000
#: Widths of the five blocks of bits, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))]
    raw, count = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        count += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash(docs)).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string")).alias("text_hash")


def _shard_keys(fp: Column) -> Column:
    """For each pair of blocks the pair's number and bits in one long."""
    low, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << low)
        low += width
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b])).cast("long"))) for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))))


class Forest:
    """BK-trees of many shards, built and walked level by level over arrays."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: a number from 0 on for each fingerprint, ascending."""
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if n else np.zeros(0, np.int64)
        self.root = np.zeros(int(shard[-1]) + 1 if n else 0, np.int64)
        self.root[shard[first]] = first
        node, left, edges = self.root[shard], np.ones(n, bool), []
        left[first] = False
        while left.any():
            item = np.flatnonzero(left)
            key = node[item] * 65 + np.bitwise_count(fp[item] ^ fp[node[item]])
            keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = item[first]
            edges.append((keys, child))
            node[item] = child[inverse]
            left[child] = False
        keys, child = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def near(self, probe: np.ndarray, shard: np.ndarray, radius: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of a probe's place and a node's within the radius of each other."""
        for a in range(0, len(probe), block):
            at, node = np.arange(a, min(a + block, len(probe))), self.root[shard[a : a + block]]
            work = [(at, node)]
            while work:
                at, node = work.pop()
                far = np.bitwise_count(probe[at] ^ self.fp[node]).astype(np.int64)
                hit = far <= radius
                yield at[hit], node[hit]
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
                count = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right") - lo
                ends = np.cumsum(count)
                if not len(ends) or not ends[-1]:
                    continue
                place = np.repeat(lo - ends + count, count) + np.arange(ends[-1])
                at, node = np.repeat(at, count), self.child[place]
                work += [(at[k : k + 4 * block], node[k : k + 4 * block]) for k in range(0, len(at), 4 * block)]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after a and b of each pair are joined; a label is the smallest place of its set."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b = a[differ], b[differ]
        high, low = np.maximum(x, y)[differ], np.minimum(x, y)[differ]
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def _spanning(shard: np.ndarray, fp: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint to the first of its set; a tree over the first side is walked from the other, if there is one.

    What lies within the radius of a shard's first fingerprint is one set at once and needs no walk among itself.
    """
    _, shard = np.unique(shard, return_inverse=True)
    order = np.lexsort((fp, shard))
    shard, fp, right = shard[order], fp[order], right[order]
    labels, count = np.arange(len(fp)), int(shard[-1]) + 1 if len(shard) else 0
    two, root = np.zeros(count, bool), np.full(count, -1)
    two[shard[right]] = True
    crossed = two[shard]
    stored, probing = ~(crossed & right), ~crossed | right
    at = np.flatnonzero(stored)
    root[shard[at[::-1]]] = at[::-1]
    first = root[shard]
    close = (first >= 0) & (np.bitwise_count(fp ^ fp[np.maximum(first, 0)]) <= radius)
    labels = joined(labels, np.flatnonzero(close), first[close])
    for held, probes in ((stored & ~close, probing), (stored & close & crossed, probing & ~close & crossed)):
        nodes, probes = np.flatnonzero(held), np.flatnonzero(probes)
        present = np.unique(shard[nodes])
        probes = probes[np.isin(shard[probes], present)]
        if len(nodes) and len(probes):
            number = np.searchsorted(present, shard)
            forest = Forest(number[nodes], fp[nodes])
            for place, node in forest.near(fp[probes], number[probes], radius):
                labels = joined(labels, probes[place], nodes[node])
    own = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[own], fp[labels[own]]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: fingerprints linked within the radius, enough of them that the same sets come out as from all."""
    if radius > RADIUS:
        raise ValueError("two of five blocks agree for a radius of 3 at most")
    return _linked(distinct.select("fp", F.explode(_shard_keys(F.col("fp"))).alias("key")), radius, shard)


def _linked(keyed: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """a, b: links within the radius between fingerprints of the same shard, by rows of fp and the shard's key."""
    large = keyed.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("blocks"))
    parted = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    parted = parted.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = parted.select("fp", "key", "block", F.explode(other).alias("other"))
    met = met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), "fp", (F.col("block") > F.col("other")).alias("right"))
    dealt = met.repartition(F.col("shard")).sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(parts) -> pa.RecordBatch:
            a, b = _spanning(*(np.concatenate(x) for x in zip(*parts, strict=True)), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, right = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fp = fp.view(np.uint64)
            if rows > 4 * SHARD and (turn := np.flatnonzero(key != held[-1][0][-1])).size:
                held.append((key[: turn[0]], fp[: turn[0]], right[: turn[0]]))
                yield flush(held)
                held, rows, (key, fp, right) = [], 0, (key[turn[0] :], fp[turn[0] :], right[turn[0] :])
            held.append((key, fp, right))
            rows += len(key)
        if held:
            yield flush(held)

    return dealt.mapInArrow(lambda batches: _stars(run(batches)), "a long, b long")


def _stars(batches: Iterator[pa.RecordBatch], most: int = WHOLE) -> Iterator[pa.RecordBatch]:
    """Links of every node to the smallest that it reaches within the task, at most so many links being held at once."""
    held, size = [], 0

    def star() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = joined(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
        own = np.flatnonzero(labels != np.arange(len(nodes)))
        return nodes[own], nodes[labels[own]]

    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        held.append((a, b))
        size += len(a)
        if size >= most:
            held = [star()]
            if len(held[0][0]) > most // 2:  # all of them are needed: they go on as they are
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held = []
            size = len(held[0][0]) if held else 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star()], names=["a", "b"])


def components(pairs: DataFrame, whole: int = WHOLE, most: int = 60, starred: bool = False) -> DataFrame:
    """node, root: the smallest node that each node of the pairs a, b reaches.

    Each task first makes its own links stars (which starred ones are by the same Python worker that found them). Of what is left, at most whole links are finished by one task, which that
    number bounds; more of them go through alternating star steps over all executors until nothing changes.
    """
    stars = lambda df: df.mapInArrow(_stars, "a long, b long")
    edges = cut(pairs.select("a", "b") if starred else stars(pairs.select("a", "b")))
    if edges.count() <= whole:
        return stars(edges.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return _by_star_steps(edges, most)


def _by_star_steps(pairs: DataFrame, most: int) -> DataFrame:
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = salted_join(both, least, "a", "b")
        if large:
            return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    edges, before = cut(tidy(pairs)), None
    for _ in range(most):
        state = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)").alias("x")).first()
        if state == before or not state.n:
            break
        before = state
        edges = cut(tidy(star(tidy(star(edges, True)), False)))
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def _members(marked: DataFrame, radius: int) -> DataFrame:
    """fp, least (the smallest id of the fingerprint's rows), root of every distinct fingerprint."""
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(marked.select("fp").distinct(), radius), starred=True)
    return groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: the smallest doc_id that it reaches over links."""
    marked = cut(fingerprints(docs, shingle).drop("text_hash"))
    member = cut(_members(marked, radius))
    named = salted_join(member, member.groupBy("root").agg(F.min("least").alias("component_id")), "root", "fp").select("fp", "component_id")
    return salted_join(marked, named, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, fp (of the set of shingles) and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_buffer(batch.column(1))
            for a, b in slices(offsets):
                hashes, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                keys = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32), pa.array(band_keys(hashes, bounds).ravel().view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(set_fingerprints(hashes, bounds).view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash(docs)).mapInArrow(run, "doc_id long, text_hash long, fp long, keys array<long>")


def similar_links(docs: DataFrame, grouped: DataFrame, least: float = LEAST, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """a, b: hashes of texts whose shingle sets are alike, enough of them that the same sets come out as from all links.

    grouped has a row for each text: text_hash, fp, row (its least row's doc_id and text_hash) and root, its coarse group.
    """
    size = grouped.groupBy("root").count().where("count > 1").select("root", F.ceil(F.col("count") / group).cast("int").alias("blocks"))
    dealt = salted_join(grouped, size, "root", "text_hash").select("text_hash", "fp", "row", "root", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int").alias("block"), "blocks")
    texts = docs.select(F.struct(docs["doc_id"].cast("long").alias("doc_id"), _text_hash(docs)).alias("row"), docs["text"].cast("string").alias("text"))
    met = texts.join(dealt, "row").dropDuplicates(["text_hash"])
    met = met.select("text_hash", "fp", "text", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), "text_hash", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None

        def flush() -> pa.RecordBatch:
            node, fp = np.array(list(held), np.int64), np.array([f for f, _ in held.values()], np.int64).view(np.uint64)
            pairs = np.array(joined_by_similarity([s for _, s in held.values()], fp, least, FILTER), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            shard, node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw, offsets = column_buffer(batch.column(3))
            for a, b in slices(offsets):
                hashes, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                for k in range(a, b):
                    if shard[k] != now and held:
                        yield flush()
                        held = {}
                    now = shard[k]
                    held[node[k]] = fp[k], hashes[bounds[k - a] : bounds[k - a + 1]]
        if held:
            yield flush()

    return met.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(lambda batches: _stars(run(batches)), "a long, b long")


def coarse_groups(marked: DataFrame) -> DataFrame:
    """text_hash, fp, row, least, root of every text: texts whose fingerprints are linked within FILTER share a root."""
    per_row = marked.groupBy("text_hash", "fp", "doc_id").agg(F.count("*").alias("n"))
    least = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash", "n")
    texts = per_row.groupBy("text_hash", "fp").agg(F.min(least).alias("least"))
    keyed = marked.select("fp", F.explode("keys").alias("key")).distinct()
    found = components(_linked(keyed, FILTER), starred=True)
    return texts.join(found, texts.fp == found.node, "left").select("text_hash", "fp", F.struct("least.doc_id", "least.text_hash").alias("row"), "least", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, least: float = LEAST, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """A row of docs for each component of texts alike by least in their sets of width-word shingles."""
    grouped = cut(coarse_groups(cut(_marks(docs, width))))
    found = components(similar_links(docs, grouped, least, width, group), starred=True)
    member = grouped.drop("root").join(found, grouped.text_hash == found.node, "left")
    return kept_rows(docs, member.select("least", F.coalesce("root", "text_hash").alias("root")))


def kept_rows(docs: DataFrame, member: DataFrame) -> DataFrame:
    """The row of docs that is the least of each root's members; of rows alike in id and text that with the least hash of all columns."""
    kept = member.groupBy("root").agg(F.min("least").alias("row")).select(F.struct("row.doc_id", "row.text_hash").alias("row"), "row.n")
    row = F.struct(docs["doc_id"].cast("long").alias("doc_id"), _text_hash(docs)).alias("row")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), row).join(kept, "row")
    repeated = own.where("n > 1").groupBy("row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return own.where("n = 1").select("doc.*").unionByName(repeated.select("doc.*"))
