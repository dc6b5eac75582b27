"""A training-data pipeline over `documents`, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents, from mixing on with the place in the
mixture; the last returns the packed pieces, in windows of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, language_id, mixing, ngram_jaccard, packing
from lodestone.llm.common import documents, materialise
from lodestone.llm.queries import tokenizer_path

#: The column of a document's place in the mixture.
PLACE = "mix_position"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language_id.recognised(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link, the one with the smallest doc_id stays."""
    return ngram_jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the order in which sources come by their
    target weights."""
    return mixing.mixed(docs, position=PLACE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens, which
    come in the order of the mixture."""
    return packing.pack(docs, tokenizer_path(), order=PLACE)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has no tokeniser, classifier or transitive closure of this size: the
#: tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialise(docs, f"stage-{k}-{name.replace(' ', '-').lower()}")
    return docs
