"""SentencePiece encoding with every piece's span in the original bytes, and decoding.

The model file holds a normalisation spec: a compiled character map (a double-array trie
of keys, and their replacements), a dummy prefix, white space rules. Normalisation takes
the longest key at each place and records where every normalised byte came from; pieces
are then found in the normalised text by the library, with a copy of the model whose own
normaliser is switched off, and each piece's bytes are projected to the original through
that record. Texts are normalised a slice at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut, text_bytes
from .common import worker_cache
from .tokens import listed, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
SPACE, MARK_BYTES = 0x20, np.frombuffer(MARK.encode(), np.uint8)

# Field numbers of the model file.
TRAINER_SPEC, NORMALIZER_SPEC, SELF_TEST = 2, 3, 4
MODEL_TYPE, AS_SUFFIX, BPE = 3, 24, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, the field's own bytes) of a message of the model file."""
    at = 0
    while at < len(message):
        begin = at
        tag, at = varint(message, at)
        if (kind := tag & 7) == 0:
            value, at = varint(message, at)
        else:
            n, at = varint(message, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + n], at + n
        yield tag >> 3, value, message[begin:at]


class CharMap:
    """The compiled character map: longest key at a place, and what replaces it."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.replacements = np.frombuffer(blob[4 : 4 + n], "<u4").tolist(), blob[4 + n :]
        self.begins: dict[tuple[int, int], bool] = {}

    def walk(self, text: bytes) -> tuple[int, int, int]:
        """(bytes of the longest key that ``text`` begins with, its replacement's place, bytes that some key has)."""
        at, length, place = self.step(0, self.units[0]), 0, -1
        for i, byte in enumerate(text):
            unit = self.units[at ^ byte] if at ^ byte < len(self.units) else 0
            if unit & 0x800000FF != byte:
                return length, place, i
            at = self.step(at ^ byte, unit)
            if unit >> 8 & 1:
                length, place = i + 1, self.units[at] & 0x7FFFFFFF
        return length, place, len(text)

    @staticmethod
    def step(at: int, unit: int) -> int:
        return at ^ (unit >> 10) << ((unit & 512) >> 6)

    def may_begin(self, char: int, following: int) -> bool:
        """Whether a key is ``char``, or begins with it and the one after it (-1: none)."""
        pair = (char, following)
        if pair not in self.begins:
            one = chr(char).encode()
            two = one + (chr(following).encode() if following >= 0 else b"")
            key, _, known = self.walk(two)
            self.begins[pair] = key > 0 or known == len(two) > len(one)
        return self.begins[pair]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, bytes taken, replacement) in texts that lie one after the other."""
        if not self.units or not len(data):
            return []
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        following = np.append(chars[1:], -1)
        ends = offsets[1:][np.diff(offsets) > 0]
        following[np.searchsorted(places, ends) - 1] = -1
        pairs, inverse = np.unique((chars << 22) + following + 1, return_inverse=True)
        likely = np.fromiter((self.may_begin(p >> 22, (p & (1 << 22) - 1) - 1) for p in pairs.tolist()), bool, len(pairs))
        out, free = [], 0
        candidates = places[likely[inverse]]
        for at, end in zip(candidates.tolist(), offsets[np.searchsorted(offsets, candidates, "right")].tolist()):
            if at >= free:
                # No key is as long as this; the walk ends where no key goes on.
                length, place, _ = self.walk(raw[at : min(end, at + 256)])
                if length:
                    out.append((at, length, self.replacements[place : self.replacements.index(b"\0", place)]))
                    free = at + length
        return out


class PieceModel:
    """Encoding of string arrays with spans, equal to the library's own ids, and decoding."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        parts = list(fields(model))
        trainer = {n: v for n, v, _ in fields(b"".join(v for n, v, _ in parts if n == TRAINER_SPEC))}
        spec = {n: v for n, v, _ in fields(b"".join(v for n, v, _ in parts if n == NORMALIZER_SPEC))}
        if trainer.get(AS_SUFFIX):
            raise ValueError("models that take white space as a suffix are not supported")
        self.charmap = CharMap(spec.get(CHARSMAP, b""))
        self.prefix, self.remove, self.escape = (bool(spec.get(k, 1)) for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        plain = bytes(x for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE) for x in (k << 3, 0))
        bare = b"".join(own for n, _, own in parts if n not in (NORMALIZER_SPEC, SELF_TEST)) + bytes([NORMALIZER_SPEC << 3 | 2, len(plain)]) + plain
        self.library, self.segmenter = SentencePieceProcessor(model_proto=model), SentencePieceProcessor(model_proto=bare)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        #: Bytes of each piece in normalised text.
        self.lengths = np.array([1 if self.library.is_byte(i) else len(x.encode()) for i, x in enumerate(names)], np.int64)
        #: What each piece stands for in a text.
        self.surface = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        #: Whether normalisation is no more than a space before a text and marks for spaces, and no merge crosses the begin of a run of marks.
        plain = not self.charmap.units and self.prefix and self.escape and not self.remove
        self.local = plain and trainer.get(MODEL_TYPE, 1) == BPE and not any(MARK in x.lstrip(MARK) for x in names)

    def segment_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of a text with a space before it, where the model is ``local``."""
        return self.segmenter.encode([x.replace(" ", MARK) for x in chunks], num_threads=1)

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of normalised texts, byte length of each one's piece, ids of each text)."""
        lists = self.segmenter.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
        sizes = self.lengths[ids]
        # An unknown piece is as long as what it stands for.
        for i in np.unique(np.repeat(np.arange(len(lists)), counts)[ids == self.unknown]).tolist():
            end = int(counts[: i + 1].sum())
            sizes[end - counts[i] : end] = [len(x.encode()) for x in self.segmenter.encode(texts[i], out_type=str)]
        return ids, sizes, counts

    def normalise(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, the original place of each, offsets of texts in both); places are of the slice.

        A byte that stays comes from its own place, a replacement from the begin of its key.
        """
        data, offsets = text_bytes(texts)
        found = self.charmap.matches(data, offsets)
        n = np.ones(len(data), np.int64)
        for at, length, replacement in found:
            n[at : at + length] = 0
            n[at] = len(replacement)
        source = np.repeat(np.arange(len(data)), n)
        out = data[source]
        begins = np.append(0, np.cumsum(n))
        for at, _, replacement in found:
            out[begins[at] : begins[at] + len(replacement)] = np.frombuffer(replacement, np.uint8)
        bounds = begins[offsets]
        if self.remove:
            out, source, bounds = squeezed(out, source, bounds)
        # The dummy prefix is a space before the text's first byte, and comes from there.
        if self.prefix:
            some = np.flatnonzero(np.diff(bounds) > 0)
            out, source = np.insert(out, bounds[some], SPACE), np.insert(source, bounds[some], source[bounds[some]])
            bounds = bounds + np.append(0, np.cumsum(np.diff(bounds) > 0))
        if self.escape:
            spaces = out == SPACE
            n = np.where(spaces, 3, 1)
            begins = np.append(0, np.cumsum(n))
            out, source, first = np.repeat(out, n), np.repeat(source, n), begins[:-1][spaces]
            for k, byte in enumerate(MARK_BYTES):
                out[first + k] = byte
            bounds = begins[bounds]
        if self.remove:
            out, source, bounds = without_tail(out, source, bounds, mark_starts(out) if self.escape else out == SPACE, 3 if self.escape else 1)
        return out, source, bounds, offsets

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin and end of each one's span in its text's bytes, ids of each text).

        Spans of a text follow each other without gaps; what normalisation leaves out
        belongs to the piece before it (at a text's begin: to the first), and pieces
        within one replacement share its span's begin, all but the last being empty.
        """
        out, source, bounds, offsets = self.normalise(texts)
        ids, size, counts = self.segment(listed(cut(out, bounds[:-1])))
        ends = np.cumsum(size)
        # A piece ends where the next one's first byte comes from; a text's last piece, at the text's end.
        stops = np.append(source, 0)[ends]
        last = np.cumsum(counts)[counts > 0] - 1
        stops[last] = offsets[1:][counts > 0]
        begins = np.append(0, stops)[: len(stops)]
        begin_of = np.repeat(offsets[:-1], counts)
        begins[(np.append(0, np.cumsum(counts))[:-1])[counts > 0]] = offsets[:-1][counts > 0]
        return ids, begins - begin_of, stops - begin_of, counts

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def mark_starts(out: np.ndarray) -> np.ndarray:
    """Where a space mark begins."""
    after = np.append(out, [0, 0])
    return (out == MARK_BYTES[0]) & (after[1:-1] == MARK_BYTES[1]) & (after[2:] == MARK_BYTES[2])


def squeezed(out: np.ndarray, source: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without spaces at a text's begin, and one for each run of them."""
    spaces = out == SPACE
    heads = np.zeros(len(out) + 1, bool)
    heads[bounds[:-1]] = True
    before = np.append(True, spaces[:-1])[: len(out)] | heads[:-1]
    kept = ~(spaces & before)
    return out[kept], source[kept], np.append(0, np.cumsum(kept))[bounds]


def without_tail(out: np.ndarray, source: np.ndarray, bounds: np.ndarray, spaces: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the spaces (each of ``width`` bytes, where ``spaces`` is true) that a text ends with."""
    within = spaces.copy()
    for k in range(1, width):
        within[k:] |= spaces[:-k]
    last = np.append(-1, np.maximum.accumulate(np.where(within, -1, np.arange(len(out)))))
    ends = np.maximum(last[bounds[1:]] + 1, bounds[:-1])
    change = np.zeros(len(out) + 1, np.int64)
    np.subtract.at(change, ends, 1)
    np.add.at(change, bounds[1:], 1)
    kept = np.cumsum(change)[:-1] == 0
    return out[kept], source[kept], np.append(0, np.cumsum(kept))[bounds]


def model(path: str | None = None) -> PieceModel:
    """This worker's model; ``path`` defaults to the public vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceModel(path)
    return cache["pieces", path]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def encode(docs: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str | None = None, end: bool = True, decoded: bool = False) -> DataFrame:
    """(id, ids, begins, ends), a row a row of ``docs``; ``decoded`` adds what the ids decode to.

    ``ids`` are the library's own, with the end id (an empty span at the text's end) if
    ``end``. A null or empty text has no other id. Spans count UTF-8 bytes of the original
    text. Texts of any length are encoded whole; null ids, ties and repeated rows have
    their rows, other columns are not read whatever their names, and an empty table gives
    an empty result.
    """
    shape = "id long, ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if decoded else "")

    def run(batches):
        pieces = model(vocabulary)
        for b in batches:
            for at, n in slices(b.column(1)):
                texts = b.column(1).slice(at, n)
                ids, begins, ends, counts = pieces.encode_batch(texts)
                if end:
                    places = np.cumsum(counts)
                    length = np.diff(text_bytes(texts)[1])
                    ids, begins, ends = (np.insert(x, places, y) for x, y in ((ids, pieces.end), (begins, length), (ends, length)))
                    counts = counts + 1
                columns = [b.column(0).slice(at, n), *(list_array(x, counts, pa.int32()) for x in (ids, begins, ends))]
                if decoded:
                    flat, stops = ids.tolist(), np.append(0, np.cumsum(counts)).tolist()
                    columns.append(pa.array(pieces.decode([flat[i:j] for i, j in zip(stops, stops[1:])]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in shape.split(", ")])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, shape)
    return rows.withColumnRenamed("id", id)


def decode(rows: DataFrame, ids: str = "ids", id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(id, decoded), a row a row: the library's text of each list of ids (null: empty; null ids are left out)."""

    def run(batches):
        pieces = model(vocabulary)
        for b in batches:
            texts = pieces.decode([x or [] for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    whole = F.filter(F.col(ids).cast("array<int>"), lambda x: x.isNotNull())
    return rows.select(F.col(id).cast("long").alias("id"), whole.alias("ids")).mapInArrow(run, "id long, decoded string").withColumnRenamed("id", id)
