"""The queries of this subpackage: thin functions (spark, sf_dir) -> DataFrame over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bpe, chat, fim, html_main, images, lexical, licenses, packing, quality_model, quality_rules, simhash, span_dedup, vantage
from sievelake.llm.shared import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree of files, see licenses.document_paths()."""
    files = licenses.document_paths(table(spark, sf_dir, "documents"))
    found = licenses.scan_tree(files)
    return found.withColumn("doc_id", licenses.doc_id_of(F.col("path")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return span_dedup.dedup_spans(docs)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digest=True)


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no pictures: every embedding is drawn as one."""
    return images.copies(images.render(table(spark, sf_dir, "embeddings")))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit("\\### Assistant: </turn> ok"))
    return chat.digests(chat.format_conversations(turns.union(more)))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_license_scan,
        op3_best_fit_packing,
        op4_substring_dedup,
        op5_byte_bpe,
        op6_image_copies,
        op7_html_main_text,
        op8_chat_formatting,
        op9_simhash_near_dedup,
        op10_quality_rules,
        op11_ranked_search,
        op12_fill_in_middle,
        op13_nearest_neighbours,
    )
}

ORACLES: dict[str, str] = {"op2_license_scan": licenses.ORACLE, "op8_chat_formatting": chat.ORACLE, "op10_quality_rules": quality_rules.ORACLE, "op11_ranked_search": lexical.ORACLE, "op12_fill_in_middle": fim.ORACLE}
