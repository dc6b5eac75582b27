"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, language_id, media, mixing, ngram_jaccard, packing, pii, secrets, sharding, token_counts
from lodestone.llm.common import documents

_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = _TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's lodestone.pii.key. Without one, a random key is drawn
    and forgotten: nobody can then draw the same surrogates again."""
    return pii.replace_entities(documents(spark, sf_dir), key=spark.conf.get("lodestone.pii.key", None) or token_hex(32))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_hash_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.linked_documents(documents(spark, sf_dir)).drop("rid")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_exact_dedup,
        op3_pii_surrogates,
        op4_secret_scan,
        op5_token_counts,
        op6_hash_ring_sharding,
        op7_ogg_media,
        op8_ngram_jaccard,
        op9_language_id,
        op10_source_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
    """,
}
