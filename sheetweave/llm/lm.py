"""Language-model scoring by masked pseudo-likelihood.

Every word is predicted from the words on both sides of it. A small network reads a window of REACH words a side, the word
itself left out, and predicts the word in steps: its class (the OWN most frequent words have one each, the others share one
by the first bits of their hash), then bit by bit its id's path in a binary tree. At the first NODES nodes a decision has a
bias from the counts of the words below it and a weight for each of UNITS hidden units; below them words are told apart by
their counts (and by the contexts'). The product over the path is a distribution over the vocabulary. The ids' number
grows with the corpus (WORDS_AN_ID words an id) up to 2**MOST_BITS, which bounds the counts that are broadcast; beyond it
rare words share an id.

At every context (both neighbours of a word) what the corpus holds there is counted exactly, in a distributed table that
grows with it: a word seen c times among n has max(c - DISCOUNT, 0) / n, and what the discount leaves goes to the network's
distribution. The sum of the logs of these conditional probabilities scores a text. Texts are packed once into blocks of
about BLOCK_BYTES; a block sends its different pairs of context and word to the parts of the contexts' hashes, as sorted
arrays, and gets the counts back in the same order. Words and contexts are told apart by hashes of 64 bits.

The network is trained in numpy over all words. Rows are dealt to training shards of about SHARD_BYTES by hashes of their
ids and texts and taken in the order of these; every shard starts from the same network and the results are averaged in
whole numbers, so neither partitions nor the order of rows change a score by more than rounding.

Null and empty texts, and texts without words, have no words, log-likelihood 0, memory 0 and null perplexity. Repeated rows
are scored each, alike; long texts are scored whole. Columns other than doc_id and text are not read. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, column_buffer, cut, mix, slices, word_hashes

CLASSES, OWN, FIRST_BITS = 64, 32, 5
REACH, DIM, HIDDEN, BATCH, RATE = 2, 8, 16, 4096, 0.08
_STEPS = [*range(-REACH, 0), *range(1, REACH + 1)]
LEAST_BITS, MOST_BITS, WORDS_AN_ID, NODE_BITS, UNITS = 13, 22, 16, 13, 8
NODES = 1 << NODE_BITS
SHARD_BYTES, DISCOUNT = 4 << 20, 0.75
#: One of so many contexts is counted: all are.
LANDMARK = 1
#: Bytes of text of a block, and those whose words' contexts a part of the counts has on average.
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Bytes of text that are hashed at once: what is computed of them stays in a processor's cache.
HASH_BYTES = 1 << 19
_SHAPES = ((CLASSES + 1, DIM), (2 * REACH * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (UNITS, NODES))
#: Whole numbers to which trained parameters are scaled to be added up, and the parameters of a row of them.
_UNIT, _CHUNK = 1 << 24, 1 << 12


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes, by slices of the rows."""
    parts, bounds, n = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets, HASH_BYTES):
        hashes, ends = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(hashes)
        bounds.append(ends[1:] + n)
        n += len(hashes)
    return np.concatenate(parts), np.concatenate(bounds)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = column_buffer(column)
    for a, b in slices(offsets):
        hashes, bounds = _hashed(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, hashes, bounds


def _ids(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def contexts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of both neighbours of each word; the text's ends count as neighbours."""
    left, right = np.empty_like(hashes), np.empty_like(hashes)
    left[1:], right[:-1] = hashes[:-1], hashes[1:]
    full = np.flatnonzero(np.diff(bounds))
    left[bounds[full]], right[bounds[full + 1] - 1] = U64(1), U64(2)
    return mix(mix(left) * U64(3) + right)


def _apart(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' classes with REACH places of a class of its own before and behind each text that has words, and each word's place."""
    sizes = np.diff(bounds)
    sizes = sizes[sizes > 0]
    at = np.arange(len(classes)) + REACH * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    near = np.full(len(classes) + REACH * (len(sizes) + 1), CLASSES, np.int64)
    near[at] = classes
    return near, at


class Tables:
    """Class of each id; log-odds of the second half at each of the first nodes and log-share of each id below them, by counts."""

    def __init__(self, counts: np.ndarray):
        self.bits = len(counts).bit_length() - 1
        top = np.argsort(-counts, kind="stable")[:OWN]
        self.class_of = ((np.arange(len(counts)) >> (self.bits - FIRST_BITS)) + OWN).astype(np.uint8)
        self.class_of[top] = np.arange(len(top))
        self.share = np.maximum(np.bincount(self.class_of, weights=counts, minlength=CLASSES), 0.5)
        self.share /= self.share.sum()
        level = counts.astype(np.float64)
        level[top] = 0
        odds = []
        while len(level) > 1 << FIRST_BITS:
            pair = level.reshape(-1, 2)
            odds.append((np.log(pair[:, 1] + 0.25) - np.log(pair[:, 0] + 0.25)).astype(np.float32))
            level = pair.sum(axis=1)
        odds = odds[::-1]  # by depth from FIRST_BITS on
        learnt = odds[: NODE_BITS - FIRST_BITS]
        # node (1 << depth) + prefix, as in a heap
        self.bias = np.concatenate([np.zeros(1 << FIRST_BITS, np.float32), *learnt])
        below = np.zeros(NODES, np.float32)
        for z in odds[len(learnt) :]:
            both = np.repeat(below, 2)
            both[::2] -= np.logaddexp(0, z)
            both[1::2] -= np.logaddexp(0, -z)
            below = both
        self.below = below

    def path(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first nodes that lead to each id below its class, and whether it lies in the second half at each."""
        depth = np.arange(FIRST_BITS, NODE_BITS)[:, None]
        at = ids >> (self.bits - NODE_BITS)
        return ((at >> (NODE_BITS - depth)) + (1 << depth)).T, ((at >> (NODE_BITS - depth - 1)) & 1 == 1).T


class Network:
    """What has a value for each word and class, or for each word, node and unit, is held by class or unit and node first, so that
    sums over these run along words."""

    def __init__(self, parameters: np.ndarray):
        ends = np.cumsum([0, *(int(np.prod(s)) for s in _SHAPES)])
        self.flat = parameters.astype(np.float32)
        self.embed, self.w1, self.b1, self.w2, self.b2, units = (self.flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], _SHAPES, strict=True))
        self.nodes = units.T

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 0.3, s).ravel() if len(s) > 1 else np.zeros(s) for s in _SHAPES[:-2]]
        return cls(np.concatenate([*parts, np.log(share), np.zeros(NODES * UNITS)]))

    def context(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Classes of the words on both sides of each word; beyond the text's ends a class of its own."""
        near, at = _apart(classes, bounds)
        return near[at[:, None] + _STEPS]

    def scores(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The embeddings around each word, its hidden units, and by class its scores less the largest."""
        x = self.embed.take(context, axis=0).reshape(len(context), -1)
        hidden = np.tanh(x @ self.w1 + self.b1)
        z = self.w2.T @ hidden.T
        z += self.b2[:, None]
        z -= z.max(axis=0)
        return x, hidden, z

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, hidden, p = self.scores(context)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return x, hidden, p.T

    def halves(self, hidden: np.ndarray, node: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
        """By unit the weights at each node of each path, and the log-odds of its second half."""
        at, units = np.ascontiguousarray(node.T), np.ascontiguousarray(hidden[:, :UNITS].T)
        weight, z = np.empty((UNITS, *at.shape), np.float32), tables.bias.take(at)
        for unit, own, each in zip(self.nodes.T, weight, units, strict=True):
            unit.take(at, out=own, mode="clip")
            z += own * each
        return weight, z.T

    def log_likelihood(self, ids: np.ndarray, bounds: np.ndarray, tables: Tables, block: int = 1 << 12) -> np.ndarray:
        """The log-probability of each id given those around it."""
        classes = tables.class_of[ids]
        near, at = _apart(classes, bounds)
        out = np.zeros(len(ids))
        for a in range(0, len(ids), block):
            _, hidden, z = self.scores(near[at[a : a + block, None] + _STEPS])
            own = classes[a : a + block]
            each = z[own, np.arange(len(own))] - np.log(np.exp(z, out=z).sum(axis=0))
            each = np.maximum(each, np.log(1e-12)).astype(np.float64)
            rest = np.flatnonzero(own >= OWN)
            node, second = tables.path(ids[a : a + block][rest])
            odds = self.halves(hidden[rest], node, tables)[1]
            odds = np.where(second, -odds, odds)
            # the sum of log(1 + exp(odds)), with one logarithm a word
            against = np.maximum(odds, 0).sum(axis=1) + np.log(np.prod(1 + np.exp(-np.abs(odds)), axis=1))
            each[rest] += tables.below[ids[a : a + block][rest]] - against
            out[a : a + block] = each
        return out

    def gradient(self, near: np.ndarray, at: np.ndarray, ids: np.ndarray, tables: Tables) -> np.ndarray:
        """The gradient of the mean loss of the words at these places, whose ids are given, in the order of the parameters."""
        y = near[at]
        x, hidden, p = self.forward(near[at[:, None] + _STEPS])
        p.T[y, np.arange(len(y))] -= 1
        p /= len(y)
        d_hidden = p @ self.w2.T
        rest = np.flatnonzero(y >= OWN)
        node, second = tables.path(ids[rest])
        own = hidden[rest]
        weight, z = self.halves(own, node, tables)
        error = ((0.5 * (1 + np.tanh(0.5 * z)) - second) / len(y)).astype(np.float32).T
        d_hidden[rest, :UNITS] += np.stack([(error * w).sum(axis=0) for w in weight], axis=1)
        nodes = node.T.ravel()
        d_nodes = [np.bincount(nodes, weights=(error * h).ravel(), minlength=NODES) for h in np.ascontiguousarray(own[:, :UNITS].T)]
        d_hidden *= 1 - hidden * hidden
        # a word's embedding is used in the windows around it: summed over these first, then by class
        windows = np.zeros((at[-1] - at[0] + 1, HIDDEN), np.float32)
        windows[at - at[0]] = d_hidden
        d_x, d_near = windows @ self.w1.T, np.zeros((len(windows) + 2 * REACH, DIM), np.float32)
        for k, step in enumerate(_STEPS):
            d_near[REACH + step : REACH + step + len(windows)] += d_x[:, k * DIM : (k + 1) * DIM]
        around = near[at[0] - REACH : at[-1] + REACH + 1]
        d_embed = np.stack([np.bincount(around, weights=d, minlength=CLASSES + 1) for d in d_near.T], axis=1)
        return np.concatenate([d_embed.ravel(), (x.T @ d_hidden).ravel(), d_hidden.sum(axis=0), (hidden.T @ p).ravel(), p.sum(axis=0), *d_nodes]).astype(np.float32)

    def train(self, ids: np.ndarray, bounds: np.ndarray, tables: Tables, seen: np.ndarray) -> None:
        """A pass of adaptive gradient steps; seen holds the parameters' squared gradients so far."""
        near, at = _apart(tables.class_of[ids], bounds)
        for a in range(0, len(ids), BATCH):
            g = self.gradient(near, at[a : a + BATCH], ids[a : a + BATCH], tables)
            seen += g * g
            self.flat -= RATE * g / np.sqrt(seen)


def vocabulary_bits(n_bytes: int) -> int:
    """Bits of an id for a corpus of so many bytes: a word is taken to have six."""
    return min(MOST_BITS, max(LEAST_BITS, (n_bytes // 6 // WORDS_AN_ID).bit_length()))


def corpus_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each id occurs in all texts; a row that comes back holds the counts of _CHUNK ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, hashes, _ in _blocks(batch.column(0)):
                total += np.bincount(_ids(hashes, bits), minlength=1 << bits)
        yield from _chunks(total)

    return _summed(docs.select(F.col("text").cast("string")).mapInArrow(run, _ROWS), 1 << bits)


_ROWS = "chunk int, part int, total binary"


def _chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = [k for k in range(0, len(total), _CHUNK) if total[k : k + _CHUNK].any()]
    part = int(total.sum()) & 63
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK for k in own], pa.int32()), pa.array([part] * len(own), pa.int32()), pa.array([total[k : k + _CHUNK].tobytes() for k in own])], names=["chunk", "part", "total"])


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows' chunks: first of some rows each, so no task's share grows with the number of tasks before."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                held[chunk, part] = held[chunk, part] + own if (chunk, part) in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([v.tobytes() for v in held.values()])], names=["chunk", "part", "total"])

    once = rows.repartition(F.col("chunk"), F.col("part")).mapInArrow(add, _ROWS)
    out = np.zeros(size, np.int64)
    for r in once.repartition(F.col("chunk")).mapInArrow(add, _ROWS).collect():
        out[r.chunk * _CHUNK : r.chunk * _CHUNK + len(r.total) // 8] = np.frombuffer(r.total, np.int64)
    return out


def trained(docs: DataFrame, tables, network: Network, n_bytes: int) -> Network:
    """The mean of the networks that the shards' words make of it, each counting by its words."""
    start, shards = docs.sparkSession.sparkContext.broadcast(network.flat), max(1, -(-n_bytes // SHARD_BYTES))
    text = F.col("text").cast("string").alias("text")
    hashed = docs.select(text, F.xxhash64(F.col("doc_id").cast("string"), text).alias("hash")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    dealt = hashed.select("text", "shard", "hash").repartition(F.col("shard")).sortWithinPartitions("shard", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros(-(-len(start.value) // _CHUNK) * _CHUNK + _CHUNK, np.int64), None
        own, seen, words, held, size = Network(start.value.copy()), np.empty(0), 0, [], 0

        def learn() -> int:
            """Trains on the texts held; what is taken at once depends on the shard's texts alone."""
            n = 0
            for _, _, hashes, bounds in _blocks(pa.array(held, pa.large_string())):
                own.train(_ids(hashes, tables.value.bits), bounds, tables.value, seen)
                n += len(hashes)
            return n

        def finish(words: int) -> None:
            total[: len(own.flat)] += np.round((own.flat.astype(np.float64) - start.value) * (words / 1024) * _UNIT).astype(np.int64)
            total[-1] += words

        for batch in batches:
            for text, shard in zip(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                if shard != now:
                    if now is not None:
                        finish(words + learn())
                    now, words, held, size = shard, 0, [], 0
                    own.flat[:], seen = start.value, np.full(len(start.value), 1e-4, np.float32)
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= SHARD_BYTES:
                    words += learn()
                    held, size = [], 0
        if now is not None:
            finish(words + learn())
            yield from _chunks(total)

    size = -(-len(network.flat) // _CHUNK) * _CHUNK + _CHUNK
    total = _summed(dealt.mapInArrow(run, _ROWS), size)
    start.unpersist()
    return Network(network.flat + total[: len(network.flat)] / max(1, int(total[-1])) * 1024 / _UNIT)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, as many as the largest needs."""
    values = values.astype("<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def packed(docs: DataFrame) -> DataFrame:
    """The texts by blocks: block, the rows' doc_ids and lengths of text, and all their bytes compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, zstd = TaskContext.get().partitionId() << 32, pa.Codec("zstd", 3)
        for batch in batches:
            raw, offsets = column_buffer(batch.column(1))
            for a, b in slices(offsets, BLOCK_BYTES):
                text = zstd.compress(raw[offsets[a] : offsets[b]].tobytes(), asbytes=True)
                ids = pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([_packed(np.diff(offsets[a : b + 1]))]), pa.array([text])], names=["block", "doc_ids", "lengths", "text"])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, lengths binary, text binary")


def _texts(lengths: bytes, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of a block's words, and each row's range of them, by slices of its rows."""
    offsets = np.concatenate([[0], np.cumsum(_unpacked(lengths).astype(np.int64))])
    raw = np.frombuffer(pa.decompress(text, int(offsets[-1]), "zstd", asbytes=True), np.uint8)
    for a, b in slices(offsets):
        yield _hashed(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _order(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The order by context and word; only what shares a context is sorted by word."""
    order = np.argsort(context)
    first = _firsts(context[order])
    alone = first.copy()
    alone[:-1] &= first[1:]
    at = np.flatnonzero(~alone)
    if len(at):
        tied, key = words[order[at]], np.cumsum(first[at]).astype(U64)
        bits = U64(int(key[-1]).bit_length())
        key <<= U64(64) - bits
        key |= tied >> bits
        by = np.argsort(key)
        key = key[by]
        same = ~_firsts(key)
        del key
        if np.any(same & _firsts(tied[by])):  # different words with the same first bits
            by = np.lexsort((tied, np.cumsum(first[at])))
        order[at] = order[at][by]
    return order


def pairs(context: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of context and word in order, how often each occurs, and the index of each word's pair."""
    order = _order(context, words)
    context, words = context[order], words[order]
    first = _firsts(context, words)
    at, of = np.flatnonzero(first), np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return context[at], words[at], np.diff(np.append(at, len(order))), of


def _together(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    context = [contexts(hashes, bounds) for hashes, bounds in texts]
    return pairs(np.concatenate(context), np.concatenate([hashes for hashes, _ in texts]))


def counted(blocks: DataFrame, parts: int) -> DataFrame:
    """block, part and for the block's pairs in that part, in order, c: how often the corpus holds the pair; and for their
    contexts n and d: how many words it holds there, and how many different ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                context, words, times, _ = _together(list(_texts(lengths, text)))
                part = ((context >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                own, at = np.unique(part, return_index=True)
                rows = []
                for a, b in zip(at, np.append(at[1:], len(part)), strict=True):
                    first = np.flatnonzero(_firsts(context[a:b]))
                    vocabulary, index = np.unique(words[a:b], return_inverse=True)
                    columns = np.diff(context[a:b][first], prepend=U64(0)), np.diff(np.append(first, b - a)), np.diff(vocabulary, prepend=U64(0)), index, times[a:b]
                    rows.append([_packed(x) for x in columns])
                if rows:
                    names = ["block", "part", "gaps", "sizes", "vocabulary", "words", "times"]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for block, part, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((block, columns))
        for part in list(held):
            sent = held.pop(part)
            context, words, times, heads = [], [], [], []
            for _, columns in sent:
                gaps, sizes, vocabulary, index, often = map(_unpacked, columns)
                context.append(np.repeat(np.cumsum(gaps), sizes.astype(np.int64)))
                words.append(np.cumsum(vocabulary)[index.astype(np.int64)])
                times.append(often.astype(np.int64))
                heads.append(np.cumsum(sizes.astype(np.int64)) - sizes.astype(np.int64))
            ends = np.cumsum([len(x) for x in context])
            blocks = [block for block, _ in sent]
            del sent
            context, words, times = map(np.concatenate, (context, words, times))
            order = _order(context, words)
            context, words, times = context[order], words[order], times[order]
            new, other = _firsts(context, words), _firsts(context)
            del words, context
            pair, where = np.flatnonzero(new), np.flatnonzero(other)
            c, n, d = np.empty_like(times), np.empty_like(times), np.empty_like(times)
            c[order] = np.repeat(np.add.reduceat(times, pair), np.diff(np.append(pair, len(times))))
            size = np.diff(np.append(where, len(times)))
            n[order] = np.repeat(np.add.reduceat(times, where), size)
            d[order] = np.repeat(np.add.reduceat(new.astype(np.int64), where), size)
            for block, a, b, head in zip(blocks, [0, *ends], ends, heads, strict=False):
                columns = _packed(c[a:b]), _packed(n[a:b][head]), _packed(d[a:b][head])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), *(pa.array([zlib.compress(x, 1)], pa.binary()) for x in columns)], names=["block", "part", "c", "n", "d"])

    sent = blocks.select("block", "lengths", "text").mapInArrow(send, "block long, part int, gaps binary, sizes binary, vocabulary binary, words binary, times binary")
    return sent.repartition(parts, F.col("part")).mapInArrow(count, "block long, part int, c binary, n binary, d binary")


def scored_words(blocks: DataFrame, counts: DataFrame, tables, parameters) -> DataFrame:
    """doc_id, n_words, log_likelihood, memory of every row: the sum of its words' log-probabilities by the counts at their
    contexts and the network, and the share of them whose word stands there elsewhere too."""

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        network, counts = Network(parameters.value), counts.sort_by("part")
        texts = list(_texts(block["lengths"][0].as_py(), block["text"][0].as_py()))
        context, _, _, of = _together(texts)
        c, n, d = (np.concatenate([np.zeros(0), *(_unpacked(zlib.decompress(x)) for x in counts[k].to_pylist())]) for k in "cnd")
        at = np.cumsum(_firsts(context)) - 1
        del context
        held, spared = np.maximum(c - DISCOUNT, 0) / n[at], DISCOUNT * (d / n)[at]
        n_words, total, memory, done = [], [], [], 0
        for hashes, bounds in texts:
            pair = of[done : done + len(hashes)]
            done += len(hashes)
            network_p = np.exp(network.log_likelihood(_ids(hashes, tables.value.bits), bounds, tables.value))
            each = np.log(held[pair] + spared[pair] * network_p)
            n_words.append(np.diff(bounds))
            total += [x.sum() for x in np.split(each, bounds[1:-1])]
            memory += [x.mean() if len(x) else 0.0 for x in np.split(c[pair] > 1, bounds[1:-1])]
        ids = block["doc_ids"].combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(np.concatenate(n_words), pa.int64()), pa.array(total, pa.float64()), pa.array(memory, pa.float64())], names=["doc_id", "n_words", "log_likelihood", "memory"])

    together = blocks.groupBy("block").cogroup(counts.groupBy("block"))
    return together.applyInArrow(score, "doc_id long, n_words long, log_likelihood double, memory double")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The files of a query's shuffles are deleted as it ends, where they would lie beside the next one's."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood, perplexity of every row, and memory: the share of its words that stand between the same neighbours elsewhere too."""
    sc = docs.sparkSession.sparkContext
    with _shuffles_removed(docs.sparkSession):
        n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first().n
        tables = sc.broadcast(Tables(corpus_counts(docs, vocabulary_bits(n_bytes))))
        parameters = sc.broadcast(trained(docs, tables, Network.start(tables.value.share), n_bytes).flat)
        blocks = cut(packed(docs))
        counts = cut(counted(blocks, max(1, n_bytes // PART_BYTES)))
        scored = cut(scored_words(blocks, counts, tables, parameters))
    tables.unpersist()
    parameters.unpersist()
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words")))
    return scored.select("doc_id", "n_words", "log_likelihood", perplexity.alias("perplexity"), "memory")
