"""Token ids in files of independent blocks, coded by a static range asymmetric numeral system.

Texts are encoded with the tokenizers library and an end id is appended to each. One table of frequencies, counted over
all documents, serves every block. A block holds the ids of whole documents in order; its ids are dealt to interleaved
lanes that share one stream of 32-bit words. Every CHECKPOINT steps it keeps the lanes' states and the place in the
stream, so decoding can start at each of them, and it has a CRC-32 of its payload and one of its ids.

The files are a Parquet table of blocks (part, block, start of its ids within the part, documents, ids of each, payload,
checksums), written through Spark's committed writer to any store that Spark reaches, and beside it the table of
frequencies. Parts follow each other by document id and so do blocks within a part.

Null texts are empty ones: only the end id. Rows that repeat an id lie next to each other, in the order of their ids'
hash. Null ids come first. Columns other than doc_id and text are not read. An empty table gives empty files.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import drop, folder as shared_folder
from .pieces import library, text_blocks

TOKENIZER, END = "word_bpe_49k.json", 1
SCALE, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK_IDS, CHECKPOINT = 2048, 1 << 19, 128
IDS = 1 << 16
_HEAD = struct.Struct("<4sIIIII")


#: Chunks of letters, digits and marks that no normal form changes; other chunks are left to the library as a whole.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pieces of such a chunk in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def spaced(text: str) -> str:
    """The text with single spaces where the tokenizer parts it anyway; Latin-1 texts also in lower case, as it takes them."""
    text = text.replace("\n", " ").replace("\t", " ")
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def byte_characters() -> dict[int, str]:
    """The characters that stand for the bytes of each Latin-1 letter beyond ASCII, by the byte table of byte-level BPE."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(table[b] for b in chr(c).encode()) for c in range(192, 256)}


class WordEncoder(dict):
    """Ids of chunks between spaces as int32, each chunk that is remembered encoded once.

    Pieces of plain chunks go to the library's BPE model itself, without its normaliser and pattern. Beyond most chunks
    the memory starts anew; those of the one before are taken over as they come up, which changes no result.
    """

    def __init__(self, tokenizer, most: int = 300_000):
        super().__init__()
        self.tokenizer, self.model, self.bytes_as = tokenizer, tokenizer.model, byte_characters()
        self.most, self.older = most, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if not _PLAIN.fullmatch(chunk):
                found = array("i", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
            elif chunk.isalpha():
                found = self._piece(chunk.lower())
            else:
                pieces = _PIECES.findall(chunk.lower())
                found = self._piece(chunk.lower()) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
        self[chunk] = found
        return found

    def _piece(self, piece: str) -> bytes:
        piece = piece if piece.isascii() else piece.translate(self.bytes_as)
        return array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, text.split(" "))) for text in texts]


class PlainEncoder:
    """Ids of whole texts as int32 by the library alone, for tokenizers with other normal forms or patterns."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: The normaliser and pre-tokeniser of which spaced(), _PLAIN and _PIECES make use.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


@lru_cache(2)
def token_encoder(path: str) -> WordEncoder | PlainEncoder:
    """The encoder of a tokenizer file: by words where its rules are those above, else by the library as it is."""
    tokenizer = library().Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rules = json.loads(tokenizer.to_str())
    if max(tokenizer.get_vocab().values(), default=0) >= IDS:
        raise ValueError(f"files hold ids below {IDS}")
    known = rules["normalizer"] == _NORMAL and rules["pre_tokenizer"] == _SPLIT and rules["model"]["type"] == "BPE"
    return WordEncoder(tokenizer) if known else PlainEncoder(tokenizer)


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of each row, two bytes an id; a tokenizer with ids that need more raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path or vocabulary_path(TOKENIZER))
        end = np.array([END], np.int32).tobytes()
        shape = spaced if isinstance(encoder, WordEncoder) else str
        for batch in batches:
            for at, block in text_blocks(batch.column(1)):
                found = [np.frombuffer(e + end, np.int32).astype(np.uint16).tobytes() for e in encoder.encode([shape(t) for t in block])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least one for each id that occurs."""
    out = np.zeros(len(counts), np.int64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    out[own] = np.maximum(1, np.floor(counts[own] / counts[own].sum() * (1 << SCALE)))
    spare = (1 << SCALE) - int(out.sum())
    order = own[np.argsort(-out[own], kind="stable")]
    if spare >= 0:
        out[order[0]] += spare
    for k in order if spare < 0 else ():
        take = min(-spare, int(out[k]) // 2)
        out[k] -= take
        spare += take
        if not spare:
            break
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = min(LANES, max(1, n // 64))
        steps = -(-n // lanes)
        state, words, marks, count = np.full(lanes, LOW, np.uint64), [], [], 0
        for s in range(steps - 1, -1, -1):
            own = ids[s * lanes : (s + 1) * lanes]
            f, c, x = self.freq[own], self.start[own], state[: len(own)]
            big = x >= f << np.uint64(63 - SCALE)
            out = x[big].astype(np.uint32)
            words.append(out)
            count += len(out)
            x = np.where(big, x >> np.uint64(32), x)
            q = x // f
            state[: len(own)] = (q << np.uint64(SCALE)) + (x - q * f) + c
            if s % CHECKPOINT == 0:
                marks.append((count, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        marks = marks[::-1]  # the place of a mark: words that steps from it on have put out, from the end
        body = b"".join(struct.pack("<I", len(stream) - k) + x.tobytes() for k, x in marks) + stream.tobytes()
        return _HEAD.pack(b"rANS", n, lanes, len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the stretches between checkpoints first to last, all by default; checksums of what is read are tested."""
        magic, n, lanes, marks, body_crc, ids_crc = _HEAD.unpack_from(payload)
        body = memoryview(payload)[_HEAD.size :]
        if magic != b"rANS" or zlib.crc32(body) != body_crc:
            raise ValueError("a block of token ids is damaged")
        width = 4 + 8 * lanes
        stream = np.frombuffer(body, np.uint32, offset=marks * width)
        last = marks if last is None else last
        # the stretches are decoded side by side, each from its own checkpoint
        at = np.array([struct.unpack_from("<I", body, k * width)[0] for k in range(first, last)], np.int64)
        state = np.array([np.frombuffer(body, np.uint64, lanes, offset=k * width + 4) for k in range(first, last)], np.uint64).reshape(-1, lanes)
        out = np.zeros((last - first, CHECKPOINT, lanes), self.symbol.dtype)
        end = n - (last - 1) * CHECKPOINT * lanes  # ids of the last stretch, which alone may be short
        for s in range(CHECKPOINT):
            rows = len(out) - (end <= s * lanes)
            if not rows:
                break
            x = state[:rows]
            slot = x & np.uint64((1 << SCALE) - 1)
            ids = self.symbol[slot]
            out[:rows, s] = ids
            x = self.freq[ids] * (x >> np.uint64(SCALE)) + slot - self.start[ids]
            low = x < LOW
            if rows == len(out) and end < (s + 1) * lanes:
                low[-1, end - s * lanes :] = False
            count = np.count_nonzero(low, axis=1)
            place = np.arange(count.sum()) + np.repeat(at[:rows] - np.cumsum(count) + count, count)
            x[low] = (x[low] << np.uint64(32)) | stream[place]
            at[:rows] += count
            state[:rows] = x
        ids = out.ravel()[: max(0, min(n, last * CHECKPOINT * lanes) - first * CHECKPOINT * lanes)].astype("<u4")
        if (first, last) == (0, marks) and zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("a block's token ids differ from those written")
        return ids


_BLOCKS = "part int, block int, at long, doc_ids array<long>, sizes array<int>, payload binary"


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes the files of docs below folder: blocks and frequencies; a working table of ids is deleted again."""
    spark = docs.sparkSession
    tokenized(docs, path).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            total += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16), minlength=IDS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(IDS, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    freq = frequencies(counts)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(k), int(freq[k])) for k in used], "id int, frequency int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(shared.value), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = block = at = 0

        def flush() -> pa.RecordBatch:
            payload = coder.encode(np.concatenate([x for _, x in held]))
            row = [[part], [block], [at], [[k for k, _ in held]], [[len(x) for _, x in held]], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["part", "block", "at", "doc_ids", "sizes", "payload"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), np.uint16)
                if held and size + len(own) > BLOCK_IDS:
                    yield flush()
                    held, at, block, size = [], at + size, block + 1, 0
                held.append((doc_id.as_py(), own))
                size += len(own)
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, _BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    drop(spark, f"{folder}/ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of each document in the files."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    table = spark.read.parquet(f"{folder}/frequencies").toPandas()  # at most as many rows as there are ids
    freq = np.zeros(IDS, np.int64)
    freq[table["id"].to_numpy()] = table["frequency"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)
    # a row for each file: where its ids begin
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    begin, starts = 0, []
    for r in parts:
        starts.append((r.part, begin))
        begin += r.n
    offsets = spark.sparkContext.broadcast(dict(starts))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                part, at, doc_ids, sizes, payload = (batch.column(j)[k].as_py() for j in (0, 2, 3, 4, 5))
                raw, ends = coder.decode(payload).tobytes(), np.cumsum([0, *sizes]) * 4
                ids = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                start = offsets.value[part] + at + ends[:-1] // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files read back."""
    folder = f"{shared_folder(docs.sparkSession)}/rans-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(docs.sparkSession, folder).drop("ids")
