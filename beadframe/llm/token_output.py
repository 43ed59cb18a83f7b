"""Token-ID output: blocks of static range asymmetric numeral systems (rANS).

One table of symbol frequencies, counted over the whole corpus and scaled to 2**20, is
shared by all blocks. A block holds whole documents and is independent of every other:
its ids go round robin to ``LANES`` coders whose 32-bit words are interleaved in one
stream, so that a step codes or decodes all lanes at once in numpy. A checkpoint every
``CHECK_STEPS`` steps keeps the coder states and the place in the stream, so that a
block can be decoded from its middle; the payload and the decoded ids have checksums.

File format: a folder with ``table`` (symbol, frequency), ``parts`` (part, start) and
``blocks``, Parquet tables written by Spark. A row of ``blocks`` is a block: its part
and place in it, its documents' ids and lengths, and the payload described at
:func:`encode_block`. The order of ids is (part, position).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path
from .tokens import closed, encoder, packed, slices, spread

PRECISION, LANES, CHECK_STEPS, BLOCK_IDS, END = 20, 1024, 64, 1 << 18, 1
LOW = np.uint64(1 << 31)
MAGIC = b"RANS1"
HEAD = "<5sIIIII"
HEAD_SIZE = struct.calcsize(HEAD)


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of sum 2**precision, at least 1 where the count is positive."""
    total, size = int(counts.sum()), 1 << precision
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    if not some.any():
        return out
    if some.sum() > size:
        raise ValueError("more symbols than the table has slots")
    share = counts[some].astype(np.float64) * ((size - some.sum()) / total)
    whole = np.floor(share).astype(np.int64)
    order = np.argsort(-(share - whole), kind="stable")
    whole[order[: size - int(some.sum()) - int(whole.sum())]] += 1
    out[some] = whole + 1
    return out


class Table:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECK_STEPS) -> bytes:
    """MAGIC, number of ids, lanes, number of words, number of checkpoints, CRC-32 of the
    ids; the checkpoints (place in the stream, states) in step order; the words; CRC-32
    of all before. The last step is filled up with the end id.
    """
    n = len(ids)
    steps = -(-n // lanes)
    rows = np.full(steps * lanes, END, np.int64)
    rows[:n] = ids
    x, out, marks, placed = np.full(lanes, LOW, np.uint64), [], [], 0
    shift, top = np.uint64(PRECISION), np.uint64(31 - PRECISION + 32)
    for t in range(steps - 1, -1, -1):
        s = rows[t * lanes : (t + 1) * lanes]
        f, c = table.frequency[s], table.start[s]
        full = x >= (f << top)
        if full.any():
            out.append(x[full].astype("<u4"))
            placed += len(out[-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << shift) + (x - q * f) + c
        if t % every == 0:
            marks.append((placed, x.astype("<u8").tobytes()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = struct.pack(HEAD, MAGIC, n, lanes, len(words), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    body += b"".join(struct.pack("<I", placed - at) + state for at, state in reversed(marks)) + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, table: Table, checkpoint: int = 0, every: int = CHECK_STEPS) -> np.ndarray:
    """The ids from a checkpoint on (0: all); ValueError if a checksum fails.

    All checkpoints' stretches are decoded side by side: a step takes one row of lanes of
    each of them.
    """
    if len(data) < HEAD_SIZE + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, lanes, n_words, n_marks, crc = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("no block")
    if not n:
        return np.zeros(0, np.uint32)
    mark = np.dtype([("place", "<u4"), ("state", "<u8", (lanes,))])
    marks = np.frombuffer(data, mark, n_marks, HEAD_SIZE)[checkpoint:]
    words = np.frombuffer(data, "<u4", n_words, HEAD_SIZE + n_marks * mark.itemsize)
    places, states = marks["place"].astype(np.int64), marks["state"].astype(np.uint64)
    steps = -(-n // lanes) - checkpoint * every
    out = np.empty((len(marks), every, lanes), np.uint32)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for t in range(min(every, steps)):
        k = len(marks) - ((len(marks) - 1) * every + t >= steps)  # the last stretch may be shorter
        x = states[:k]
        slot = x & mask
        s = table.symbol[slot]
        out[:k, t] = s
        x = table.frequency[s] * (x >> shift) + slot - table.start[s]
        need = x < LOW
        count = need.sum(axis=1)
        x[need] = (x[need] << np.uint64(32)) | words[spread(places[:k], count)]
        states[:k], places[:k] = x, places[:k] + count
    ids = out.ravel()[: n - checkpoint * every * lanes]
    if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return ids


def tokenised(docs: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(part, position, doc_id, n_tokens, ids): documents in ascending id order.

    Rows are dealt by ranges of (id, text hash, row), so neither one id's rows nor equal
    rows, whose order does not matter, crowd a part; ``position`` counts the ids before a document in its part. ``ids`` are
    little-endian unsigned 16- or 32-bit integers with the end id last.
    """

    def run(batches):
        from pyspark import TaskContext

        part, at, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for b in batches:
            for k, n in slices(b.column(1)):
                ids, sizes = closed(*coder.encode_batch(b.column(1).slice(k, n)), END)
                places = at + np.cumsum(sizes) - sizes
                at += len(ids)
                columns = [pa.array(np.full(n, part, np.int64)), pa.array(places), b.column(0).slice(k, n), pa.array(sizes), packed(ids, sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "position", "doc_id", "n_tokens", "ids"])

    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), key.alias("h"), F.monotonically_increasing_id().alias("row"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(run, "part long, position long, doc_id long, n_tokens long, ids binary")


def as_ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def counted(tokens: DataFrame) -> DataFrame:
    """(part, symbol, n), from one read: ids of each symbol (part null) and of each part (symbol null);
    each task sends a row for each that it met."""

    def run(batches):
        counts, parts = np.zeros(1 << 16, np.int64), {}
        for b in batches:
            n, lists = b.column(1).to_numpy(), b.column(0).to_pylist()
            wide = np.fromiter(map(len, lists), np.int64, len(lists)) > 2 * n
            for kind, rows in (("<u2", ~wide), ("<u4", wide)):
                new = np.bincount(np.frombuffer(b"".join(lists[i] for i in np.flatnonzero(rows).tolist()), kind), minlength=len(counts))
                new[: len(counts)] += counts
                counts = new
            for part, m in b.select(["part", "n_tokens"]).to_pandas().groupby("part")["n_tokens"].sum().items():
                parts[part] = parts.get(part, 0) + int(m)
        s = np.flatnonzero(counts)
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none(len(s)), pa.array(s), pa.array(counts[s])], names=["part", "symbol", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), none(len(parts)), pa.array(list(parts.values()), pa.int64())], names=["part", "symbol", "n"])

    found = tokens.select("ids", "n_tokens", "part").mapInArrow(run, "part long, symbol long, n long")
    return found.groupBy("part", "symbol").agg(F.sum("n").alias("n"))


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    got = spark.read.schema("symbol long, frequency long").parquet(f"{path}/table").toPandas()  # a row a symbol of the vocabulary
    out = np.zeros(int(got["symbol"].max()) + 1 if len(got) else 1, np.int64)
    out[got["symbol"].to_numpy(np.int64)] = got["frequency"].to_numpy(np.int64)
    return out


def write(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", vocabulary: str | None = None) -> None:
    """Encodes every text and writes the folder ``path``.

    Null texts are empty and hold the end id alone; null ids come first; rows that share
    an id are ordered by their text's hash. A text of any length is one document of one
    block, which may so exceed ``BLOCK_IDS``. Other columns are not read, whatever their
    names. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    tokens = materialise(tokenised(docs, text, id, vocabulary), "token-ids")
    found = counted(tokens).toPandas()  # a row a symbol of the vocabulary, and a part
    counts = found[found["part"].isna()]
    dense = np.zeros(int(counts["symbol"].max()) + 1 if len(counts) else 1, np.int64)
    dense[counts["symbol"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    frequency = scaled(dense)
    pairs = pd.DataFrame({"symbol": np.flatnonzero(frequency), "frequency": frequency[frequency > 0]})
    spark.createDataFrame(pairs, "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    parts = found[found["part"].notna()].sort_values("part")
    starts = [(int(p), int(end - n)) for p, n, end in zip(parts["part"], parts["n"], parts["n"].cumsum())]
    spark.createDataFrame(starts, "part long, start long").coalesce(1).write.parquet(f"{path}/parts")

    def blocks(batches):
        table = Table(frequency)
        held: list = []
        size, at = 0, (None, 0)

        def flush():
            ids = np.concatenate([x for _, x in held])
            sizes = np.array([len(x) for _, x in held], "<i8")
            row = [at[0], at[1], [d for d, _ in held], sizes.tolist(), encode_block(ids, table)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "position", "doc_ids", "sizes", "payload"])

        for b in batches:
            for part, place, doc, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if held and ((part, place) != (at[0], at[1] + size) or size + n > BLOCK_IDS):
                    yield flush()
                    held, size = [], 0
                if not held:
                    at = (part, place)
                held.append((doc, as_ids(data, n)))
                size += n
        if held:
            yield flush()

    tokens.mapInArrow(blocks, "part long, position long, doc_ids array<long>, sizes array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit; not without ``ids``), ids_crc32."""
    shape = "doc_id long, start long, n_tokens long, " + ("ids binary, " if ids else "") + "ids_crc32 long"
    frequency = read_frequencies(spark, path)

    def run(batches):
        table = Table(frequency)
        for b in batches:
            for start, docs, sizes, payload in zip(*(b.column(k) for k in range(4))):
                flat, n = decode_block(payload.as_py(), table).astype("<u4"), np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                data = [flat[e - k : e].data for e, k in zip(ends.tolist(), n.tolist())]
                columns = [pa.array(docs.as_py(), pa.int64()), pa.array(start.as_py() + ends - n), pa.array(n)]
                columns += [pa.array([d.tobytes() for d in data], pa.binary())] if ids else []
                columns.append(pa.array([zlib.crc32(d) for d in data], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in shape.split(", ")])

    parts = spark.read.schema("part long, start long").parquet(f"{path}/parts")
    blocks = spark.read.schema("part long, position long, doc_ids array<long>, sizes array<long>, payload binary").parquet(f"{path}/blocks")
    placed = blocks.join(F.broadcast(parts), "part")  # one row a part of the writing job
    rows = placed.select((F.col("start") + F.col("position")).alias("start"), "doc_ids", "sizes", "payload")
    return rows.mapInArrow(run, shape)


def round_trip(docs: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` to a new folder and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, text, id, vocabulary)
    return read(docs.sparkSession, path, ids=False)
