"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranked byte strings. Bytes are mapped to printable characters as byte-level BPE does it, each
match of the pre-tokenisation pattern is encoded by itself, and no special token is ever made: their strings in a text
are ordinary text. Decoding reverses the byte table and gives back the exact bytes; offsets are in characters, and a
token that holds only a part of a character counts as lying on that whole character.

Null texts are encoded as empty ones; both give an empty list. Repeated rows are encoded each. Very long texts are
encoded whole. Columns other than the id and the text are not read, whatever their names. An empty table gives an empty
result. Where several pairs of tokens could be joined next, the pair of least rank is, the leftmost first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import ChunkEncoder, id_lists, library, text_blocks

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces and chunks, each, that a Python worker remembers; workers outlive their stage, so it bounds what they hold. No result depends on it.
REMEMBERED = 60_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it has a visible one, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def token_encoder(path: str) -> ChunkEncoder:
    """An encoder of pattern matches; every two tokens that join to a third are a merge, of that one's rank.

    A match can't go on past a single space between two other characters that aren't space, so chunks between such
    spaces are encoded by themselves, each with its space.
    """
    import public_tokenizers
    import regex

    tk, ranks, chars = library(), read_ranks(path), byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    tokenizer = tk.Tokenizer(tk.models.BPE(vocab={s: ranks[t] for t, s in shown.items()}, merges=merges))
    tokenizer.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    find = regex.compile(public_tokenizers.PATTERN).findall

    def parts(text: str) -> Sequence[str]:
        word = text.rstrip(".,")
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # a space or letter, then letters: one match, and one of the marks
            return (word, text[len(word) :]) if len(word) < len(text) else (word,)
        return find(text)

    return ChunkEncoder(tokenizer, parts, clean=lambda chunk: chunk and not chunk[0].isspace() and not chunk[-1].isspace(), most=REMEMBERED)


@lru_cache(4)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in order of id; each token's start among them and length."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    table, start, size = _byte_table(path)
    if not len(ids):
        return b""
    length = size[ids]
    ends = np.cumsum(length)
    return table[np.arange(ends[-1]) + np.repeat(start[ids] - ends + length, length)].tobytes()


def character_offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token."""
    if not len(ids):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    raw = np.frombuffer(decode_bytes(ids, path), np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80)
    ends = np.cumsum(_byte_table(path)[2][ids])
    return (number[ends - _byte_table(path)[2][ids]] - 1).astype(np.int32), number[ends - 1].astype(np.int32)


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """id, ids array<int>; with offsets also starts and ends array<int>, in characters."""
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or vocabulary_path(RANKS)
        encoder = token_encoder(where)
        for batch in batches:
            for at, block in text_blocks(batch.column(1)):
                encoded = encoder.encode(block)
                columns = [batch.column(0).slice(at, len(block)), id_lists(encoded)]
                if offsets:
                    for side in zip(*(character_offsets(np.frombuffer(e, np.int32), where) for e in encoded), strict=True):
                        columns.append(id_lists([x.astype(np.int32).tobytes() for x in side]))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "ids", "starts", "ends"][: len(columns)])

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, schema)


def _decoded(ids: np.ndarray, sizes: np.ndarray, path: str) -> pa.Array:
    """The bytes of rows of so many ids each."""
    ends = np.concatenate([[0], np.cumsum(_byte_table(path)[2][ids])])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(decode_bytes(ids, path))])
    return raw.cast(pa.binary())


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """id, decoded binary of the ids (null: none)."""
    id_type = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or vocabulary_path(RANKS)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                lists = batch.column(1).slice(at, step)
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                decoded = _decoded(lists.flatten().to_numpy(zero_copy_only=False), sizes, where)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), decoded], names=[id_column, "decoded"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {id_type}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes decoded from them, both made by the same worker."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or vocabulary_path(RANKS)
        encoder = token_encoder(where)
        for batch in batches:
            for at, block in text_blocks(batch.column(1)):
                lists = id_lists(encoder.encode(block))
                decoded = _decoded(lists.values.to_numpy(), np.diff(lists.offsets.to_numpy()), where)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), lists, decoded], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    both = round_trip(docs, path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
