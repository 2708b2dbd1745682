"""The operator queries: thin calls with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import preference
from cohortlens.llm.boosting import quality_rules
from cohortlens.llm.catalog import query, table
from cohortlens.llm.collocations import collocations
from cohortlens.llm.crf import quality_scores
from cohortlens.llm.decontaminate import contaminated
from cohortlens.llm.html_extract import extract
from cohortlens.llm.langid import held_out, identify, train
from cohortlens.llm.licenses import oracle, scan
from cohortlens.llm.ngram_join import ngram_join
from cohortlens.llm.packing import pack
from cohortlens.llm.substring_dedup import repeated_passages
from cohortlens.llm.toxicity import toxicity
from cohortlens.llm.whitening import whiten


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, train(docs.where(~held_out())))


@query("op2_ngram_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query("op7_chat_formatting", preference.oracle())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return preference.texts(preference.preferences(table(spark, folder, "conversations")))


@query("op8_license_scan", oracle())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


@query("op11_phrase_collocations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
