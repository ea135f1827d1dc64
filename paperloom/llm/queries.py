"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hmm, jaccard, langid, mixing, topk, toxicity, warc, wrapper
from .shared import load, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, one row per page."""
    records = warc.plan_records(load(spark, sf_dir, "pages"))
    archives = written(warc.write_archives(records), "archives")
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its distance."""
    return decontaminate.find_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(load(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(load(spark, sf_dir, "documents"), langid.in_fold(F.col("doc_id"), 7, 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = langid.in_fold(F.col("doc_id"), 3, 1)
    lexicon = toxicity.learn(docs, labels.where(~held_out))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.in_fold(F.col("doc_id"), 3, 1)
    network = langid.train(docs, ~held_out)
    return langid.identify(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_chat, op3_decontaminate, op4_topk, op5_wrapper, op6_mixing, op7_hmm, op8_toxicity, op9_langid, op10_jaccard)}
