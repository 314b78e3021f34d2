"""From raw documents to encoded ones, in five stages.

Each stage takes what the one before has kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns them with the token ids in place
of the text.

Edge cases: a document whose text is null, empty, without letters or in none of the languages that
the table teaches goes in the first stage;
rows without an id are neither duplicates nor sources of passages; repeated rows are treated
alike; very long texts are worked on whole; an empty table gives no rows; extra columns,
whatever their names, are carried, but for ``ids``, ``decoded`` and ``lossless``, which the last
stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, langid, mergedrop, phrases, simhash
from lodestrata.llm.common import stored, table
from lodestrata.llm.folds import held_out
from lodestrata.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go that have no letter, or whose n-grams no mixture of the learned languages explains
    better than chance."""
    return langid.accepted(docs, langid.learn(docs.where(~held_out("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out."""
    return phrases.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text they came from."""
    return mergedrop.encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model").drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Language ID and encoding are beyond SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
