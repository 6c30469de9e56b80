"""The corpus pipeline: five stages over the documents, each an operator of millrace.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import containment, crf_language, mixing, near_dedup, token_store
from millrace.llm.common import Workspace, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have a language by the model that their labels train.

    A null text, an empty one or one without a letter has none and goes; without
    any label nothing can be learned and all go. A null ``lang`` or ``doc_id`` is
    only left out of training. Texts of any length are judged as wholes; rows
    that repeat are judged alike; columns of any other name pass through.
    """
    return crf_language.with_language(docs, crf_language.train(crf_language.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group with a similarity of 0.8 or more.

    Null and empty texts are like nothing and stay, as do rows with a null
    doc_id. Of rows that repeat a doc_id one stays: the one whose text has the
    smallest hash, ties by the text. Columns of any other name pass through.
    """
    return near_dedup.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; items that are null or have no words are
    in none; without items all stay. Rows that repeat are judged alike; columns
    of any other name pass through.
    """
    return containment.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated by epochs.

    Null and empty texts have no words and come as often as their source's whole
    epochs; null sources are one source, the last. Ties of the random key go by
    doc_id and size; rows that repeat are rows of their own. A copy of a document
    is a row like it, and columns of any other name pass through.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token segments written and read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone. A null doc_id comes first; rows
    that repeat a doc_id (the copies of the mix) are stored each, ordered by
    text. Other columns are left out.
    """
    return token_store.store(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL has neither the random field, the signatures nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
