"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import (bpe, collocations, filter_audit, html_text, mixing, neighbours, quality, simhash, substring, suffix,
                            token_counts, token_files, toxicity)
from tilequarry.llm.common import new_folder, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Mixture of the registered query and the pipeline: domain of a source, and weights among siblings.
MIX_LEVELS = {
    "domain": "CASE WHEN source = 'src0' THEN 'crawl' WHEN source RLIKE '^src[1-9]$' THEN 'reference' ELSE 'community' END",
    "lang": "lang", "source": "source",
}
MIX_WEIGHTS = {("crawl",): 1, ("reference",): 2, ("community",): 3,
               **{(d, "en"): 3 for d in ("crawl", "reference", "community")}}
MIX_EPOCHS, MIX_SEED = 2, 7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"), length=400)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder, with_ids=False).drop("ids")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("doc.page_id").alias("page_id"), F.col("doc.url").alias("url"), "text",
                        F.length("text").cast("long").alias("n_chars"))


@query
def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    rows = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), MIX_LEVELS, MIX_WEIGHTS, 1.0, MIX_EPOCHS, MIX_SEED)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes("v2").alias("kept"), "failed")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Labels grow with the documents, so they are merged, never broadcast.
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").hint("merge")
    seen = docs.select("doc_id", "text").where(~toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    found = toxicity.score(docs, toxicity.fit(seen))
    doc_id = F.col("doc.doc_id")
    return found.select(doc_id.alias("doc_id"), F.coalesce(toxicity.held_out(doc_id), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "credit", "passages")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
