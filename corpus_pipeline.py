"""A corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, source mixing, tokens.

Each stage takes the documents that the one before it kept, written as Parquet and read again, and all but the
last return the columns of documents.

Null and empty texts fail the quality rules, so later stages meet them only where a passage stage leaves nothing of
a text: it then has no words, is mixed with size 0 and has no tokens. Null doc_ids stand last, null languages and
sources are strata and sources of their own. Very long texts are worked on whole. Rows that are repeated in all
columns are near copies, of which one stays. Columns of documents beyond the usual ones pass through the stages,
whatever their names, and the last stage drops them. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from tally.llm.common import materialize, ship, table
from tally.sources.scratch import scope

#: Repeated passages from here on are cut: some fifty words, at five bytes a word with its space.
PASSAGE_BYTES = 250
#: Workers stay while the other stages run, so this stage's stores are smaller than the operator's own.
KEPT_PARTS = 60_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id. Near copies share 0.8 or more of
    their shingles of five words, as whole sets."""
    ship(spark)
    return simhash.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_BYTES or more stay where they occur first, by doc_id, and are cut out elsewhere; documents
    stay, with what is left of them."""
    ship(spark)
    return suffix_dedup.without_repeated(docs, PASSAGE_BYTES, keep_first=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    ship(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids (little-endian unsigned 32-bit) and the text that they decode to."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded", kept=KEPT_PARTS)
    return coded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: The near-duplicate, passage and token stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark, keep="pipeline-"):  # what a stage keeps for itself goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
