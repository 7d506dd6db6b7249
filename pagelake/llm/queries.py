"""The operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import best_fit_packing, bpe_automaton, conversation_repair, hard_negatives, jaccard_join, language_id, license_scan, quality_crf, sentencepiece_bpe, sharding, simhash, substring_dedup, toxicity_knn
from pagelake.llm.tables import table, tokenizer_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(name: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = fn
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


@_query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_documents(table(spark, sf_dir, "documents"))


@_query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@_query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, likelihoods = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), langs, likelihoods)


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_knn.score_documents(docs, toxicity_knn.train(docs, table(spark, sf_dir, "labels")))


@_query("op5_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_query("op7_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


@_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.judge_documents(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


@_query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


@_query("op12_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_query("op13_conversations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), texts=False)
