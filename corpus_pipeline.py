"""The corpus pipeline: quality classifier, near duplicates, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and reread. All but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.decontamination import without_leaks
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack
from tessera.llm.secrets import redacted
from tessera.llm.shared import written
from tessera.llm.site_quality import kept_documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware quality classifier keeps: null texts count as empty, null sources and languages as
    sites of their own, equal rows are judged alike; without labels of both kinds all stay; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept_documents(docs, labels, F.col("source"), F.col("lang"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked at a Jaccard similarity of 0.8: that with the least id.
    Documents without words or text stay, and so do rows without id; rows that share an id stay or go together, of equal
    ones one stays; an empty table stays empty."""
    return one_of_each(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row goes by its own text, also among rows that share an id or have none;
    null texts hold nothing; without items, or documents, the table stays as it is."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with likely secrets replaced in their texts; n_chars follows. Null texts stay null, each row is read
    for itself, and an empty table stays empty."""
    return redacted(docs, F.col("source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null text is its end token alone; equal rows are packed
    each; a null id is kept; an empty table gives no pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets_redacted),
    ("packing", packed),
]

#: No stage's decisions can be put as SQL (fitted models, adaptive prefixes, a tokenizer); tests/llm compares each
#: stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; what lies between two stages is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
