import corpus_pipeline
from beadframe.llm import decontam, mixing, simhash

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, before = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        ids, old = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids < old and len(ids) > 0.6 * len(old), name
        kept[name], before = ids, after
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    assert decontam.contained_items(before.select("doc_id", "text"), items).count() == 0
    assert simhash.near_duplicates(before).groupBy("root").count().where("count > 1").count() == 0
    assert kept["mixing"] == {r.doc_id for r in mixing.sample(docs.where(docs.doc_id.isin(list(kept["decontamination"])))).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in kept["quality_rules"])
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in rows} == kept["mixing"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    """Every stage keeps the columns, whatever their names, and runs through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    odd = [(None, None, None, None, None), (None, "null id, and twenty words or more so that the base rules keep it " * 3, "en", "web", 10), (500_001, "", "en", "web", 0), (500_002, None, "de", None, None)]
    long = docs.first()
    rows = [tuple(r) for r in docs.collect()] + odd + [tuple(docs.first())] * 3 + [(500_003, long.text * 400, "en", "web", 1)]
    names = ["key", "part", "row", "root", "fp", "__id", "__mix", "n_tokens", "id", "h", "position", "kept", "score", "u", "v", "component_id"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in docs.schema)}, {', '.join(f'`{n}` int' for n in names)}")
    before = df.repartition(4)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == df.columns, name
        after = spark.createDataFrame(after.toPandas().astype(object).where(lambda x: x.notna(), None), df.schema)
        assert 0 < after.count() <= before.count(), name
        assert all(r[names.index(n) + 5] == k for r in after.limit(5).collect() for k, n in enumerate(names)), name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count()
    assert before.where("doc_id = 500002 OR doc_id = 500001").isEmpty()
