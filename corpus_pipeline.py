"""The corpus pipeline: STAGES over documents, each stage's rows written and read again.

All stages take an empty table (and return one), texts of any length, repeated rows and extra
columns of any name; all but the last keep the columns. What each does with nulls, empty
texts and ties stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import langid, mixing, neardup, packing, queries, repetition
from voxloom.llm.common import forget, stored, table

#: A row is taken at most once here, so packing meets no document twice.
RECIPE = mixing.Recipe(budget_percent=80, max_epochs=1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter or unlike every language learnt from the rows themselves.

    Null and empty texts go; a null lang isn't learnt from but its row is judged like others; equal
    distances go to the language first in order, which doesn't change what is kept; repeated rows
    share one verdict. Where nothing can be learnt every row goes.
    """
    return langid.keep_known(docs, queries.learn_languages(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that break a repetition, symbol or length rule.

    Null, empty and blank texts have no word and go; repeated rows share one verdict.
    """
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of copies and near copies.

    Texts without words (null, empty, blank) are no copies of each other and stay, as do rows
    without a doc_id; rows repeated whole, doc_id included, stay together; a doc_id with
    several texts keeps those whose group it is the smallest doc_id of.
    """
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the source tree's token budget takes.

    Null lang or source is a node of its own; texts without words take no budget and follow their
    leaf; ties in the drawn order are repeated rows, which are taken alike.
    """
    return mixing.take(docs, RECIPE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their sequences.

    A null or empty text is its end id alone; every row is packed, repeated ones too; pieces of
    equal length are taken in the order of the tasks that cut them.
    """
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), queries.PACK_END, queries.CAPACITY)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: The first stage counts n-gram ranks and the last runs a tokenizer: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's rows are deleted when the next one's are written, its own steps by ``common.clean``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
