"""One query per operator, each over its whole table. Tokenizer files are parameters with the public vocabularies as defaults."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, encoding, exact_search, hard_negatives, html_text, mixing, packing, pii, quality, sharding, simhash, suffix_tree, token_store, turns
from .common import table

BYTE_TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(BYTE_TOKENIZER))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(WORD_TOKENIZER), encoding.CACHE_BYTES, encoding.BATCH_BYTES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.approximate_top_k(table(spark, sf_dir, "embeddings"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(table(spark, sf_dir, "conversations"), faults=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality, op2_sharding, op3_mixing, op4_exact_search, op5_html, op6_tokens, op7_pii, op8_packing, op9_simhash, op10_ann, op11_turns,
    op12_hard_negatives, op13_suffix_tree,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_sharding": sharding.ORACLE_SQL, "op4_exact_search": exact_search.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
