"""What the operators of this subpackage share: tables, checkpoints, labelled samples and word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, drop, folder  # noqa: F401  for the operators

U64 = np.uint64
#: Bytes of text that the numpy kernels take at once; longer single texts are taken alone.
SLICE_BYTES = 1 << 21
#: Bound of the labelled texts of a class that the driver takes to fit a classifier.
SAMPLE_BYTES = 16 << 20
_MULT = U64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, values: DataFrame, key: str | list[str], spread: str, salts: int = 64) -> DataFrame:
    """rows joined with values on key, where values has a row a key: a hot key's rows are dealt by spread to so many tasks.

    Only the pairs of key and salt that occur are made, so values never grow beyond rows. Null keys join nothing.
    """
    keys = [key] if isinstance(key, str) else key
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(dealt.select(*keys, "_salt").distinct().join(values, keys), [*keys, "_salt"]).drop("_salt")


def is_held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most per_class texts of each label and most_bytes of them, those with the smallest hashes of doc_id, none held out.

    Labels other than 0 and 1 and null ids are left out; of several labels for an id the largest counts, of several texts
    the least. Texts are whole: those beyond most_bytes are left out. The ids joined by broadcast are bounded by 2 * per_class.
    """
    y = F.col(column).cast("int")
    known = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max(y).alias("_y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("_y = 0").orderBy(*order).limit(per_class).unionByName(known.where("_y = 1").orderBy(*order).limit(per_class))
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    up_to = Window.partitionBy("_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.octet_length("text")).over(up_to)).where(F.col("_n") <= most_bytes)
    return [(r.text, r._y) for r in sorted(rows.select("doc_id", "_y", "text").collect(), key=lambda r: r.doc_id)]


def text_buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, at least a row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(29))) * _MULT
    return h ^ (h >> U64(32))


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and two-byte Latin-1 capitals in lower case."""
    out = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    lead = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
    out[lead] += 0x20
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of True, broken where a row begins; and the index of each row's first run."""
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; zeros within or behind a run count as absent but keep their place."""
    if not len(starts):
        return np.zeros(0, U64)
    length = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values)) - np.repeat(starts, length)
    return mix(np.add.reduceat(values[starts[0] :].astype(U64) * _POWERS[place & 63], starts - starts[0]))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words (letters, digits, non-ASCII) in order, and each row's range of them."""
    inside = _WORD[raw]
    starts, bounds = runs(inside, offsets)
    return run_hashes(lowered(raw) * inside, starts), bounds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def _scores(score, texts: pa.Array) -> np.ndarray:
    raw, offsets = column_buffer(texts)
    out = [score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return np.concatenate(out) if out else np.zeros(0)


def kept_by_score(docs: DataFrame, score, keep: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs, whole, whose text's score is kept; each row is judged by itself, whatever its id."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(score, texts), pa.float64())

    return docs.where(keep(of(docs["text"].cast("string"))))


def append_scores(docs: DataFrame, score, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; score(raw, offsets) gives the scores of a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(score, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
