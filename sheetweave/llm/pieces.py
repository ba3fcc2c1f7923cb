"""Encoding by the tokenizers library, each distinct piece of text once: a piece's ids don't depend on what surrounds it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

#: Pieces remembered in a Python worker; beyond it the memory starts anew, which changes no result.
REMEMBERED = 400_000


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers


class ChunkEncoder:
    """Ids of texts as int32 by way of their chunks between single spaces.

    parts(text) gives the strings that the library encodes one by one. A chunk that isn't the first stands for itself
    with lead before it. Without parts the library encodes each chunk as it is. Where clean is given, a text with a chunk that it doesn't match is taken by parts() as a whole.
    """

    def __init__(self, tokenizer, parts: Callable[[str], Sequence[str]] | None, lead: str = " ", clean: Callable[[str], object] | None = None, most: int = REMEMBERED):
        self.most = most
        self.tokenizer, self.parts, self.lead, self.clean = tokenizer, parts, lead, clean
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.unclean: set[str] = set()

    def _learn(self, used: set[str]) -> None:
        missing = [*used.difference(self.pieces)]
        if len(missing) + len(self.pieces) > self.most:
            self.pieces = {p: self.pieces[p] for p in used.intersection(self.pieces)}
        if missing:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)]
            ends = np.cumsum([len(ids) for ids in found]) * 4
            raw = np.fromiter(chain.from_iterable(found), np.int32, count=int(ends[-1]) // 4).tobytes()
            self.pieces.update({p: raw[a:b] for p, a, b in zip(missing, [0, *ends.tolist()], ends.tolist(), strict=False)})

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        self._learn(set(chain.from_iterable(split)))
        get = self.pieces.__getitem__
        return [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        used = set().union(*split)
        if self.parts is None:
            self._learn(used)
            get = self.pieces.__getitem__
            return [b"".join(map(get, chunks)) for chunks in split]
        missing = [*used.difference(self.chunks)]
        if len(missing) + len(self.chunks) > self.most:
            self.chunks = {c: self.chunks[c] for c in used.intersection(self.chunks)}
            self.unclean.intersection_update(self.chunks)
        if missing:
            self.chunks.update(zip(missing, self._by_parts([self.lead + m for m in missing] if self.lead else missing), strict=True))
            if self.clean:
                self.unclean.update([m for m in missing if not self.clean(m)])
        firsts = self._by_parts([chunks[0] for chunks in split]) if self.lead else []
        get, out = self.chunks.__getitem__, []
        for k, chunks in enumerate(split):
            if self.unclean and not self.unclean.isdisjoint(chunks):
                out += self._by_parts([texts[k]])
            elif self.lead:
                out.append(firsts[k] + b"".join(map(get, chunks[1:])))
            else:
                out.append(b"".join(map(get, chunks)))
        return out


def text_blocks(column: pa.Array, most: int = 1 << 21) -> Iterable[tuple[int, list[str]]]:
    """Rows of a string column in blocks of so many characters, at least a row; null is the empty text."""
    start, block, size = 0, [], 0
    for k in range(len(column)):
        text = column[k].as_py() or ""
        if block and size + len(text) > most:
            yield start, block
            start, block, size = k, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield start, block


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
