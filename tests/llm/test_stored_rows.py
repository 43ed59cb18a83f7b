"""Large rows that are stored a few to a file."""

import pyarrow.parquet as pq
from beadframe.llm import alignment, common


def test_files_hold_few_rows(spark):
    stored = common.materialise(spark.range(100).coalesce(1), "few", file_rows=8)
    assert max(pq.ParquetFile(x.removeprefix("file://")).metadata.num_rows for x in stored.inputFiles()) == 8 and stored.count() == 100


def test_batches_are_stored_few_to_a_file(spark, monkeypatch):
    """Before, a task's batches were one file, whose rows a reader holds together."""
    monkeypatch.setattr(alignment, "FILE_ROWS", 2)
    docs = spark.createDataFrame([(i, f"text {i} of a few words " * 9000) for i in range(14)], "doc_id long, text string").coalesce(1)
    files = alignment.batches_of(docs).inputFiles()
    rows = [pq.ParquetFile(x.removeprefix("file://")).metadata.num_rows for x in files]
    assert max(rows) == 2 and sum(rows) > 4
