"""A training-corpus pipeline: each stage applies one corpus operator to what its predecessor kept.

Near duplicates are documents whose sets of 5-word shingles have a Jaccard similarity of 0.8
or more; of each group the smallest id stays. The last stage gives the packed pieces.

Cases, in every stage: an empty table gives an empty one with the same columns; a null text counts as an empty one, which is
never toxic, fails the quality base (under 10 words), and is linked with nothing; rows that are repeated are
judged alike, so all of them stay or go, and what shares the smallest id of a group stays; other columns, null or not, pass through. Classifiers
are fitted on labelled rows that aren't held out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from midden.llm import jaccard, packing, pii, rules, toxicity
from midden.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic; without usable labels all stay."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that pass the base (10 words, at most 20 of 100 words in repeated windows) and that no learned rule rejects."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group, and all that is linked with nothing; rows without an id stay."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each, with personal data replaced by its kind in brackets; n_chars follows, null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it stands in which sequence of at most 4,096 tokens; a null text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Classifiers, learned rules and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again before the next, and deleted when the one after it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = before = cut(docs, f"pipeline-{name}", instead=before)
    return docs
