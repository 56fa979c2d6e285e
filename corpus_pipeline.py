"""From documents to packed training sequences in five stages.

1. language ID: documents without a recognised language go;
2. n-gram Jaccard join: of each group of near copies the document with the
   smallest id stays;
3. substring dedup: words of windows that repeat from documents with smaller
   ids go; a document that loses all its words goes;
4. benchmark decontamination: documents with a benchmark item go (also those
   without an id; of rows that share an id only those whose text holds one);
5. best-fit packing: the pieces of what is left, with their places.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
has kept; all but the last return the columns of the documents. :func:`run`
writes each stage's rows to the shared folder and reads them again.

Edge cases: a null text has no language and goes in the first stage; rows that
repeat a document's id and text are one document from the second stage on;
rows with a null id are never near copies or repeats of others; an empty table
runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import remainder, small_batches, table, written

#: A document whose best language scores less is rejected.
LEAST_SCORE = 0.5

#: The language model is fitted in the pipeline, which SQL cannot express.
ORACLE_SQL = None


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from curata.llm.language_id import UNKNOWN, fit, predict

    small_batches(spark)
    model = fit(docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2)))
    judged = predict(docs, model, docs.columns)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from curata.llm.ngram_join import join_documents

    small_batches(spark)
    judged = written(join_documents(docs), "judged")
    copies = judged.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    again = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from curata.llm.substring_dedup import remove_repeats

    small_batches(spark)
    cut = remove_repeats(docs).where("n_words = 0 or n_removed < n_words")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from curata.llm.decontaminate import decontaminated

    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from curata.llm.complement_packing import pack_documents

    small_batches(spark)
    return pack_documents(docs, _vocabulary())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
