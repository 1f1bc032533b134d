"""Each stage's decisions take effect and change nothing else."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        spark.createDataFrame([(None, None, None, None, 0), (10**6, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars int"))
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = out.collect()
        assert all(tuple(r) == tuple(given[r.doc_id]) for r in rows)
        if name != "mixing sources":
            assert len(rows) == len({r.doc_id for r in rows})
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.agg(F.count_if(F.col("piece") == 0)).first()[0] == docs.count()


def test_rejected_copies_go_by_text(spark, documents):
    prose = " ".join(f"w{i}" for i in range(40))
    docs = documents([(1, prose), (1, "too short"), (None, prose), (2, "a b " * 40), (3, prose + " x"), (3, prose + " x")])
    kept = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", prose), ("None", prose), ("3", prose + " x"), ("3", prose + " x")])
    one = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, docs.schema), SF).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "None"]


def test_texts_of_one_id_leave_the_least(spark, documents):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    docs = documents([(4, two), (4, one), (4, one, "fr"), (9, three)])
    for parts in (1, 3):
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text, r.lang) for r in kept.collect()) == [(4, one, "en"), (9, three, "en")]


def test_empty_tables(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), SF).count() == 0
