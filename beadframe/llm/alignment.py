"""Two tokenizers' ids of the same texts aligned by bytes, with corpus-wide counts of id pairs.

A batch of texts is encoded by both; Arrow flattens the lists of ids with their parent
indices, cumulative sums within a text give each token's end, and an Acero hash join on
(text, end) keys finds where both end: that cuts a text into groups. In order of its ends,
each stretch between two neighbouring ends lies in one token of either side and is their
link, so links need no search. Table.group_by counts pairs of ids by text and by batch.

Spark merges the batches' counts. What the counts are needed for goes back by batch: each
asks once for each of its distinct pairs, so a common pair has a row a batch, not a row a
link, and no table that grows with the corpus is sent to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkIds, cut, per_text, text_bytes
from .common import materialise, worker_cache
from .pieces import PieceModel, list_array
from .pieces import model as piece_model
from .tokens import load, slices, spread

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are encoded, and aligned, at once (a longer text is taken alone).
ENCODED, SLICE = 1 << 20, 1 << 19
#: Rows of a file of batches, which a task reads together.
FILE_ROWS = 32


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut: before a space that follows neither white space nor a space mark.

    A byte-level splitter never joins white space to what stands before it, and a local
    piece model no space mark.
    """
    before = [np.append(np.zeros(k, np.uint8), data)[: len(data)] for k in (1, 2, 3)]
    white = ((before[0] >= 9) & (before[0] <= 13)) | ((before[0] >= 28) & (before[0] <= 32))
    # White space beyond ASCII has two bytes from C2 or three from E1, E2 or E3, the mark three from E2.
    white |= (before[0] >= 0x80) & ((before[1] == 0xC2) | ((before[2] >= 0xE1) & (before[2] <= 0xE3)))
    starts = (data == 0x20) & ~white
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


class ByteModel:
    """A byte-level BPE tokenizer, and the bytes that its ids stand for."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        letters, size = byte_letters(), self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.surface = [bytes(letters[c] for c in x) if all(c in letters for c in x) else b"" for x in names]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class Surfaces:
    """The bytes that each id stands for."""

    def __init__(self, surface: list[bytes]):
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each text's ids."""
        size = self.sizes[ids]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        data = self.flat[spread(self.starts[ids], size)]
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(data)])


class Aligner:
    """Both tokenizers of a worker, and the alignment of a batch of texts."""

    def __init__(self, a: ByteModel, b: PieceModel):
        self.a, self.b = a, b
        self.a_bytes, self.b_bytes = Surfaces(a.surface), Surfaces(b.surface)
        self.width = len(b.surface)
        self.chunks = ChunkIds(a.segment, *([b.segment_chunks] if b.local else []), most=130_000)
        self.decimal = pa.array([str(i) for i in range(max(len(a.surface), self.width))], pa.large_string())

    def ends(self, lists: pa.ListArray, surfaces: Surfaces) -> tuple[pa.Array, pa.Array]:
        """(ids of all texts, key of each one's end: its text's number and the bytes up to there)."""
        ids, parent = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int64())
        total = pc.cumulative_sum(pa.array(surfaces.sizes[ids.to_numpy()]))
        closing = np.append(0, total.to_numpy())[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
        before = pa.array(closing[:-1]).take(parent)
        return ids, pc.add(pc.shift_left(parent, 32), pc.subtract(total, before))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
        """(texts with a space before them, A ids, B ids): lists of a text each; null texts are empty."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()))
        data, offsets = text_bytes(spaced)
        starts = chunk_starts(data, offsets)
        found = [(ids, per_text(starts, sizes, offsets)) for ids, sizes in self.chunks.gather(cut(data, starts))]
        if not self.b.local:
            ids, _, _, counts = self.b.encode_batch(texts)
            found.append((ids, counts))
        return spaced, *(list_array(ids, counts, pa.int32()) for ids, counts in found)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, dict]]:
        """(first row, rows, alignment) of slices of a batch; more text is encoded at once than aligned."""
        for at, n in slices(texts, ENCODED):
            some = texts.slice(at, n)
            encoded = self.encode(some)
            for begin, m in slices(some, SLICE):
                yield at + begin, m, self.align(*(x.slice(begin, m) for x in encoded))

    def align(self, spaced: pa.Array, a_lists: pa.ListArray, b_lists: pa.ListArray) -> dict:
        """The groups and links of a batch; a text that either side does not give back has neither.

        By text: ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (decimal ids). A link's
        ``text``, ``pair`` (A id times B's vocabulary size, plus B id) and ``count`` by distinct pair of a text.
        """
        a_counts, b_counts = (x.value_lengths().to_numpy() for x in (a_lists, b_lists))
        a_ids, b_ids = (x.flatten().to_numpy() for x in (a_lists, b_lists))
        whole = spaced.cast(pa.large_binary())
        same = pc.and_(pc.equal(self.a_bytes.joined(a_ids, a_counts), whole), pc.equal(self.b_bytes.joined(b_ids, b_counts), whole))
        real = np.flatnonzero(pc.and_(same, pc.greater(pc.binary_length(spaced), 1)).to_numpy(zero_copy_only=False))
        a_lists, b_lists = (x.take(pa.array(real)) for x in (a_lists, b_lists))
        a, a_ends = self.ends(a_lists, self.a_bytes)
        b, b_ends = self.ends(b_lists, self.b_bytes)
        sides = [pa.table({"end": e, side: pa.array(np.arange(len(e)))}) for side, e in (("a", a_ends), ("b", b_ends))]
        both = sides[0].join(sides[1], "end", join_type="full outer", use_threads=False).combine_chunks()
        both = both.take(pc.sort_indices(both["end"]))
        common = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
        shared = both.filter(common)
        text = pc.shift_right(both["end"], 32)
        # A stretch up to an end is in the token that ends there, or in the next one that ends.
        pair = pc.add(pc.multiply(a.take(pc.fill_null_backward(both["a"])).cast(pa.int64()), self.width), b.take(pc.fill_null_backward(both["b"])).cast(pa.int64()))
        counted = pa.table({"text": text, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])

        n = len(spaced)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_a"][real], out["n_b"][real] = a_counts[real], b_counts[real]
        groups = np.bincount(pc.shift_right(shared["end"], 32).to_numpy(), minlength=len(real))
        out["n_groups"][real] = groups
        out["n_links"][real] = np.bincount(text.to_numpy(), minlength=len(real))
        parts = [pc.binary_join(self.grouped(ids, shared[side]), pa.scalar(",", pa.large_string())) for side, ids in (("a", a), ("b", b))]
        line = pc.binary_join_element_wise(*parts, pa.scalar("|", pa.large_string()))
        by_text = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)), pa.int32()), line)
        joined = pc.binary_join(by_text, pa.scalar(";", pa.large_string()))
        places = np.full(n, -1)
        places[real] = np.arange(len(real))
        out["groups"] = joined.take(pa.array(places, mask=places < 0)).fill_null("")
        out["text"] = real[counted["text"].to_numpy()]
        out["pair"], out["count"] = counted["pair"].to_numpy(), counted["count_all"].to_numpy()
        return out

    def grouped(self, ids: pa.Array, last: pa.ChunkedArray) -> pa.ListArray:
        """Decimal ids by group, where ``last`` are the places that groups end at."""
        return pa.ListArray.from_arrays(pa.array(np.append(0, last.to_numpy() + 1), pa.int32()), self.decimal.take(ids))


def aligner(a: str | None = None, b: str | None = None) -> Aligner:
    """This worker's aligner; paths default to the public vocabulary files."""
    if a is None:
        import public_tokenizers

        a = public_tokenizers.path(VOCABULARY)
    cache = worker_cache()
    if ("aligner", a, b) not in cache:
        cache["aligner", a, b] = Aligner(ByteModel(a), piece_model(b))
    return cache["aligner", a, b]


def light(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """(id, groups): ``a1,a2|b1;a3|b2,b3``, the ids of each group of a text; no tokens: an empty string."""

    def run(batches):
        both = aligner(a, b)
        for batch in batches:
            for at, n, found in both.batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), found["groups"].cast(pa.string())], names=["id", "groups"])

    return light(docs, text, id).mapInArrow(run, "id long, groups string").withColumnRenamed("id", id)


DOCS = "struct<id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>"
BATCHES = f"batch long, width int, docs array<{DOCS}>, pairs array<bigint>, counts array<bigint>, doc array<int>, code array<int>, n array<int>"


def batches_of(docs: DataFrame, text: str = "text", id: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """A row a batch of texts, written to the shared folder: its documents, its distinct pairs
    with their counts, and the links of each document as (doc, code of the pair, n)."""

    def run(batches):
        both, number, part = aligner(a, b), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, n, found in both.batches(batch.column(1)):
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found["groups"].to_pylist()]
                own = [batch.column(0).slice(at, n).cast(pa.int64()), *(pa.array(found[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests, pa.string())]
                rows = pa.StructArray.from_arrays(own, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                totals = pa.table({"pair": found["pair"], "n": found["count"]}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
                code = pc.index_in(pa.array(found["pair"]), value_set=totals["pair"].combine_chunks())
                lists = [totals["pair"].to_numpy(), totals["n_sum"].to_numpy(), found["text"], code.to_numpy(), found["count"]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                columns = [pa.array([part << 33 | number]), pa.array([both.width], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows),
                           *(list_array(x, np.array([len(x)]), k) for x, k in zip(lists, kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "width", "docs", "pairs", "counts", "doc", "code", "n"])
                number += 1
                pa.default_memory_pool().release_unused()
        # An idle worker keeps neither chunks nor buffers.
        both.chunks.clear()
        pa.default_memory_pool().release_unused()

    return materialise(light(docs, text, id).mapInArrow(run, BATCHES), "aligned-batches", file_rows=FILE_ROWS)


def asked(batches: DataFrame) -> DataFrame:
    """(batch, code, pair, n): a row a distinct pair of a batch."""
    rows = batches.select("batch", "width", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "x"))
    return rows.select("batch", "width", "code", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): the links of each pair of ids in the corpus; ``best``: no other pair of the B id has more."""
    split = asked(batches).groupBy("pair", "width").agg(F.sum("n").alias("n"))
    split = split.select("pair", F.expr("pair div width").cast("int").alias("a"), F.expr("pair % width").cast("int").alias("b"), "n")
    split = materialise(split, "aligned-pairs")
    most = split.groupBy("b").agg(F.max("n").alias("most"))  # at most a row an id of the B vocabulary, so it may be broadcast
    return split.join(F.broadcast(most), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, text: str = "text", id: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a row of ``docs``.

    ``n_best`` counts a text's links whose pair has its B id's highest count in the corpus
    (ties included), ``count_sum`` adds up the counts over its links. A text that is null
    or empty, or that either vocabulary does not give back byte by byte, has zeros and an
    empty string and adds nothing to the counts. Texts are aligned whole; null ids, ties
    and repeated rows have their rows (and count each), other columns are not read
    whatever their names, and an empty table gives an empty result.
    """

    def run(batch: pa.Table, need: pa.Table) -> pa.Table:
        rows = batch["docs"].combine_chunks().flatten()
        codes = need["code"].to_numpy()
        total, top = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        total[codes], top[codes] = need["total"].to_numpy(), need["best"].to_numpy()
        doc, code, n = (batch[c].combine_chunks().flatten().to_numpy() for c in ("doc", "code", "n"))
        sums = pa.table({"doc": doc, "best": n * top[code], "sum": n * total[code]}).group_by("doc", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
        out = np.zeros((2, len(rows)), np.int64)
        for k, name in enumerate(("best_sum", "sum_sum")):
            out[k][sums["doc"].to_numpy()] = sums[name].to_numpy()
        own = [rows.field(i) for i in range(6)]
        return pa.Table.from_arrays([*own[:5], *map(pa.array, out), own[5]], names=[c.split()[0] for c in RESULT.split(", ")])

    batches = batches_of(docs, text, id, a, b)
    counts = materialise(pair_counts(batches).select("pair", F.col("n").alias("total"), "best"), "aligned-counts")
    met = asked(batches).select("batch", "code", "pair").join(counts, "pair")
    # A batch and its distinct pairs, both bounded by the batch's texts, meet in one group.
    own = batches.select("batch", "docs", "doc", "code", "n")
    met = met.select(F.col("batch").alias("of"), "code", "total", "best")
    return own.groupBy("batch").cogroup(met.groupBy("of")).applyInArrow(run, RESULT).withColumnRenamed("id", id)
