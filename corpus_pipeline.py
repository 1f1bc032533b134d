"""Documents to packed training sequences in five stages.

Each stage takes all that its predecessor kept and returns the columns of documents; the last
returns pieces placed in sequences. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import fertility, mixing, ngram_jaccard, ordinal, packing
from flowmill.llm.graph import small_enough
from flowmill.session import save_and_reload

BROADCAST_ROWS = 500_000  # ids or keys of rejected rows

#: Fitted models and exact near-duplicate components have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the calibrated one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit_grades(docs, ordinal.label_grades(labels), n_grades=3, accept_grade=2)
    graded = ordinal.grade_documents(docs, model, accept_grade=2)
    return graded.filter("accepted").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language."""
    digest = F.xxhash64("text").alias("_digest")
    counts = save_and_reload(fertility.measured(
        docs.select("doc_id", "lang", "text", digest), public_tokenizers.path("piece_bpe_32k.model"),
        keep=["doc_id", "lang", "_digest"]), "counts")
    gone = fertility.judged(counts).filter("not kept").select(
        F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_digest").alias("_gone")).distinct()
    gone = small_enough(save_and_reload(gone, "rejected"), BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang"))
    rows = docs.withColumn("_digest", digest)
    return rows.join(gone, same & (F.col("_digest") == F.col("_gone")), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of smallest id. Five words, similarity 0.8."""
    found = save_and_reload(ngram_jaccard.shingle_components(docs, width=5, percent=80), "components")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small_enough(gone, BROADCAST_ROWS), "doc_id", "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():  # rows of one id are one document
        again = again.select("doc_id")
        rows = kept.join(again, "doc_id")
        first = F.struct("text", "lang", "source")  # the least text, so that reruns agree
        one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), first).alias("_row")).select("_row.*")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    sized = docs.withColumn("_words", mixing.word_count(F.col("text")))
    mixed = mixing.mix_sources(sized, size_col="_words").filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = save_and_reload(docs, name.replace(" ", "-"))
    return docs
