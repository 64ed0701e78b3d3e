"""A training corpus from raw documents: language, exact copies, near copies, privacy, packing.

Each stage works on all rows that the one before kept and is written as Parquet
before the next reads it.  All but the last return the columns of ``documents``
(and any further columns of the input).  Rows without an id or text, empty tables
and repeated rows are handled as the operators of ``quorumbook.llm`` define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumbook.llm import exact_dedup, language, near_dedup, pseudonyms
from quorumbook.llm.queries import PSEUDONYM_KEY, packed, tokenizer_path
from quorumbook.llm.tables import read_table, written


#: Languages to keep (None keeps all), and the score from which a text is held to be of another one than its label or these.
WANTED_LANGUAGES, LEAST_SCORE = None, 0.9


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what has no language or none of the wanted ones, and fill in a missing or surely wrong ``lang``.

    The pieces carry that language to the end, so that a mix of languages can be drawn from them.

    The model is trained on the documents themselves, without those held out.  By default every language is wanted:
    null texts and texts without a letter are rejected then, and nothing for a low score, as short clean texts have
    low scores too, or because the documents have no labels to learn from.
    """
    model = language.train_language_model(docs)
    return language.keep_known(docs, model, lang_col="lang", wanted=WANTED_LANGUAGES, least_score=LEAST_SCORE, correct=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the smallest id stays."""
    return near_dedup.keep_one_of_each(docs)


def replace_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates, addresses and keys become pseudonyms of the same format; lengths do not change."""
    return pseudonyms.replace_personal(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their sequence and language."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"), kept=["lang"])


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("private_values", replace_private_values),
    ("packing", pack),
]

#: Training, hashing by permutations and tokens have no form in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
