"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and calls one operator of tilequarry.llm."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import bpe, mixing, quality, simhash, suffix
from tilequarry.llm.common import delete, new_folder, noting, table, tokenizer_path
from tilequarry.llm.queries import MIX_EPOCHS, MIX_LEVELS, MIX_SEED, MIX_WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before left behind; its output is written when the next stage begins.
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage that first deletes what the stage before it kept while its output was being written.

    Stages follow one another, one pipeline at a time; each one's output is written before the next is called.
    """

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, *_left)
        _left.clear()
        with noting(_left):
            return fn(spark, docs, sf_dir)

    return run


def _columns(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs out of `doc`, some of them anew."""
    return found.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality ledger keeps."""
    return quality.keep(docs, "v2")


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that op10 finds (three-word shingles, fingerprints linked at 3 or fewer bits): the smallest doc_id."""
    return simhash.keep_first(docs, shingle=3, radius=3)


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes or more that stand elsewhere too.

    A character cut in two at the edge of such a string goes as a whole; n_chars follows the text.
    """
    found = suffix.dedup(docs, length=400, as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("doc.text")).otherwise(F.col("kept"))
    found = found.withColumn("new", text)
    counted = {"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _columns(found, docs, text=F.col("new"), **counted)


@stage
def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's proportions; one taken in two passes stands twice."""
    return _columns(mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, 1.0, MIX_EPOCHS, MIX_SEED), docs)


@stage
def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian u32) and whether decoding gives the text again."""
    found = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"), decoded=True)
    text = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    return found.select("doc.doc_id", "doc.lang", "doc.source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: No SQL: fingerprints, suffix sorting and byte-pair merges cannot be said in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, run_stage) in enumerate(STAGES):
        docs = run_stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
