"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import sql
from curata.llm.common import remainder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.ngram_join import join_documents

    return join_documents(table(spark, sf_dir, "documents"))


#: Host, path and verdict of each rule.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.url_graph import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                                     "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.substring_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.mih_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.chat_schema import canonical_turns, format_turns, read_back, records_of_rows

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.unionByName(own)
    found = read_back(format_turns(canonical_turns(records_of_rows(rows))))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from curata.llm.complement_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2)))
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.feistel_shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curata.llm.lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)), least=1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_lm_scoring": op13_lm_scoring,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op2_url_filters": sql.url_filters(URL_RULES),
    "op4_substring_dedup": sql.substring_dedup(),
    "op6_chat_formatting": sql.chat_formatting(),
    "op12_phrase_collocations": sql.phrase_collocations(),
    "op11_source_divergence": sql.source_divergence_audit(),
}
