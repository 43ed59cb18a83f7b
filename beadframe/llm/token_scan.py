"""Token counts by a separator scan over flat token files.

A flat file is nothing but little-endian unsigned 16-bit ids, one document after the
other, each closed by the end-of-document id; there is no index. Spark's text writer
makes the files: a line is ids, and the line separator is the end-of-document id. Each
file is cut into blocks of fixed size that know nothing of documents; a block is searched
at once in numpy. What crosses a border (of blocks, or of the files of one part) is
settled by a prefix scan over the blocks' summaries: ids, separators, last separator.

Documents have no names in such files; they are told by their ordinal. The writer lists
names in order in a folder beside the files, which the scan does not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch_path
from .tokens import closed, encoder, slices

#: Ids of a block; bytes of text of a line (a longer text is a line of its own); lines of a file.
END, BLOCK, LINE_BYTES, LINES = 49407, 1 << 16, 1 << 18, 64
PART = r"part-(\d+)-.*?(?:[-.]c(\d+))?\.\w+$"


def write_flat(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", end: int = END, vocabulary: str | None = None, lines: int = LINES) -> None:
    """Writes the texts' ids to flat files in ``path``/kind=ids, names to ``path``/kind=names.

    Null texts have no ids but their separator. Strings that look like special tokens are
    ordinary text, so the end id marks ends only. A vocabulary with ids of more than 16
    bits is a ValueError.
    """

    def run(batches):
        coder, row = encoder(vocabulary, plain=True, most=120_000), 0
        for b in batches:
            for at, n in slices(b.column(1), LINE_BYTES):
                ids, sizes = coder.encode_batch(b.column(1).slice(at, n))
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("ids of more than 16 bits")
                # The last document's separator is the line's end.
                flat = closed(ids, sizes, end)[0][:-1].astype("<u2").tobytes()
                names = "".join("\n" if x is None else f"{x}\n" for x in b.column(0).slice(at, n).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array(["ids", "names"]), pa.array([row, row], pa.int64()), pa.array([flat, names], pa.binary())], names=["kind", "row", "value"])
                row += 1
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "kind string, row long, value binary")
    rows = rows.sortWithinPartitions("kind", "row").select("kind", F.col("value").cast("string").alias("value"))
    line_end = end.to_bytes(2, "little").decode("latin-1")
    rows.write.partitionBy("kind").options(lineSep=line_end, encoding="ISO-8859-1", maxRecordsPerFile=lines).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(part, turn, kind, content), a row a file: files of one part follow each other by turn."""

    def group(k: int) -> Column:
        return F.coalesce(F.regexp_extract("path", PART, k).try_cast("long"), F.lit(0))

    found = spark.read.format("binaryFile").load(path)
    kind = F.col("kind") if "kind" in found.columns else F.lit(None).cast("string")  # a folder level of the writer's, so others are not opened
    return found.select(group(1).alias("part"), group(2).alias("turn"), kind.alias("kind"), "content")


def scan(found: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """(part, ordinal, start, n_tokens, closed), a row a document of flat files (part, turn, content).

    ``ordinal`` and ``start`` count documents and ids from the part's begin; the separator
    is not counted. Ids after a part's last separator are a document that is not closed; a
    part that ends with its separator has none, nor has an empty file. A file of an odd
    number of bytes is a ValueError.
    """

    def run(batches):
        for b in batches:
            for part, turn, content in zip(b.column(0), b.column(1), b.column(2)):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                blocks = [ids[at : at + block] for at in range(0, len(ids), block)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int64()), pa.array([turn.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array([len(x) for x in blocks], pa.int64()), pa.array([np.flatnonzero(x == end) for x in blocks], pa.list_(pa.int64()))],
                    names=["part", "turn", "block", "n", "places"],
                )

    blocks = found.select("part", "turn", "content").mapInArrow(run, "part long, turn long, block long, n long, places array<long>")
    # Within a part there is one row a block.
    order = W.partitionBy("part").orderBy("turn", "block")
    before, later = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("part").orderBy(F.col("turn").desc(), F.col("block").desc())
    placed = blocks.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("ends", F.transform("places", lambda p: p + F.col("at")))
    placed = placed.withColumns({
        "seen": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "last": F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before), F.lit(-1)),
        "final": F.row_number().over(later) == 1,
    })
    total = F.col("at") + F.col("n")
    tail = F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1)), F.col("last"))
    open_end = F.when(F.col("final") & (tail + 1 < total), F.array(F.struct(total.alias("end"), F.lit(False).alias("closed"))))
    ends = F.concat(F.transform("ends", lambda e: F.struct(e.alias("end"), F.lit(True).alias("closed"))), F.coalesce(open_end, F.expr("CAST(array() AS array<struct<end: bigint, closed: boolean>>)")))
    listed = placed.select("part", "seen", "last", ends.alias("ends"))
    each = listed.select("part", "seen", "last", "ends", F.posexplode("ends").alias("k", "x"))
    start = F.when(F.col("k") == 0, F.col("last") + 1).otherwise(F.expr("ends[k - 1].end + 1"))
    return each.select("part", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("x.end") - start).alias("n_tokens"), F.col("x.closed").alias("closed"))


def names(found: DataFrame, end: int = END) -> DataFrame:
    """(part, ordinal, doc_id) from the writer's lists of names."""
    line_end = end.to_bytes(2, "little")

    def run(batches):
        for b in batches:
            for part, turn, content in zip(b.column(0), b.column(1), b.column(2)):
                listed = content.as_py().replace(line_end, b"").split(b"\n")[:-1]
                for at in range(0, max(len(listed), 1), 10_000):
                    own = [int(x) if x else None for x in listed[at : at + 10_000]]
                    columns = [pa.array([part.as_py()]), pa.array([turn.as_py()]), pa.array([at], pa.int64()), pa.array([own], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "turn", "at", "names"])

    rows = found.select("part", "turn", "content").mapInArrow(run, "part long, turn long, at long, names array<long>")
    before = W.partitionBy("part").orderBy("turn", "at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.coalesce(F.sum(F.size("names")).over(before), F.lit(0)))
    rows = rows.select("part", "seen", F.posexplode("names").alias("k", "doc_id"))
    return rows.select("part", (F.col("seen") + F.col("k")).alias("ordinal"), "doc_id")


def count_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", end: int = END, block: int = BLOCK, vocabulary: str | None = None, lines: int = LINES) -> DataFrame:
    """(doc_id, part, ordinal, start, n_tokens, closed): writes ``docs`` to flat files and scans them.

    One row a row of ``docs``: repeated rows and null ids have theirs, a null text counts
    0. A text of any length is read whole; the table's other columns are not read. An
    empty table gives an empty result.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "flat-tokens")
    write_flat(docs, path, text, id, end, vocabulary, lines)
    return joined(spark, path, end, block)


def joined(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """The scan's rows with their names, of a folder that :func:`write_flat` wrote."""
    # With one folder above, an empty table's files (there are none) are no error.
    every = {k: files(spark, path).where(F.col("kind") == k) for k in ("ids", "names")}
    found = scan(every["ids"], end, block)
    return found.join(names(every["names"], end), ["part", "ordinal"], "left").select("doc_id", "part", "ordinal", "start", "n_tokens", "closed")
