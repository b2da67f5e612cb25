"""The registered queries of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table
from tidewright.llm.conversation_repair import REPAIR_SQL, repair_damaged
from tidewright.llm.decontaminate import contaminated_pairs
from tidewright.llm.fill_middle import DIGEST_SQL, fill_in_middle_digest
from tidewright.llm.language_id import language_id
from tidewright.llm.lm_score import lm_scores
from tidewright.llm.lz_fingerprint import lz_fingerprints
from tidewright.llm.mixing import mix
from tidewright.llm.quality import quality_scores
from tidewright.llm.sharding import shard_documents
from tidewright.llm.simhash import near_duplicates
from tidewright.llm.token_count import token_counts
from tidewright.llm.toxicity import toxicity_scores
from tidewright.llm.url_filter import judge_urls


def tokenizer_file(name: str) -> str:
    """A vocabulary file: in TIDEWRIGHT_TOKENIZERS, else where its package is."""
    folder = os.environ.get("TIDEWRIGHT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of sources."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select(
        "doc_id", "source", "mix_block", "mix_slot", "mix_offset", "mix_release", "mix_deadline", "mix_weight"
    )


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.drop("text")  # so that texts are read once, for their bytes, and not moved


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_mixing,
        op2_lz_fingerprint,
        op3_simhash,
        op4_language_id,
        op5_lm_score,
        op6_sharding,
        op7_decontaminate,
        op8_token_counts,
        op9_quality,
        op10_url_filter,
        op11_conversation_repair,
        op12_fill_middle,
        op13_toxicity,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": REPAIR_SQL, "op12_fill_middle": DIGEST_SQL}
