"""Token ids of texts through their distinct chunks: cut a batch, encode new chunks once, gather."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .tokens import listed, spread


class ChunkIds:
    """Ids of chunks that tokenizers never join across, each distinct one encoded once.

    Each of ``encoders`` takes distinct chunks and gives the ids of each. At ``most``
    chunks, those met in a single batch are forgotten, and all if that leaves too many, so
    memory stays bounded.
    """

    def __init__(self, *encoders: Callable[[list[str]], list[list[int]]], most: int = 400_000):
        self.encoders, self.most = encoders, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros(0, np.int32)
        #: By encoder: all ids, and each chunk's place and number of them.
        self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.encoders]

    def forget(self) -> None:
        kept = self.met > 1
        if kept.sum() > self.most // 2:
            return self.clear()
        number = np.cumsum(kept) - 1
        self.known = {x: int(number[i]) for x, i in self.known.items() if kept[i]}
        self.met = self.met[kept] // 2
        for k, (ids, starts, sizes) in enumerate(self.held):
            ids, sizes = ids[spread(starts[kept], sizes[kept])], sizes[kept]
            self.held[k] = ids, np.cumsum(sizes) - sizes, sizes

    def learn(self, fresh: list[str]) -> np.ndarray:
        number = np.arange(len(self.known), len(self.known) + len(fresh))
        self.known.update(zip(fresh, number.tolist()))
        self.met = np.append(self.met, np.zeros(len(fresh), np.int32))
        for k, (encode, (ids, starts, sizes)) in enumerate(zip(self.encoders, self.held)):
            got = encode(fresh)
            n = np.fromiter(map(len, got), np.int64, len(got))
            new = np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))
            self.held[k] = np.append(ids, new), np.append(starts, len(ids) + np.cumsum(n) - n), np.append(sizes, n)
        return number

    def gather(self, chunks: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """By encoder, (ids of all chunks in order, ids of each chunk)."""
        if len(self.known) > self.most:
            self.forget()
        coded = chunks.dictionary_encode()
        names = listed(coded.dictionary)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = self.learn([names[i] for i in new.tolist()])
        self.met[number] += 1
        number = number[coded.indices.to_numpy()]
        return [(ids[spread(starts[number], sizes[number])], sizes[number]) for ids, starts, sizes in self.held]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each) of a string array; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """UTF-8 bytes cut into strings at ``starts`` (ascending, the first is 0 unless there are no bytes)."""
    offsets = np.append(starts, len(data)).astype("<i8")
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def per_text(starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the chunks' ``sizes`` by text, where chunks begin at ``starts`` and texts at ``offsets``."""
    total = np.append(0, np.cumsum(sizes))
    return np.diff(total[np.searchsorted(starts, offsets)])
