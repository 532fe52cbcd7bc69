"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Every stage but the last returns the columns of ``docs`` as they came, in their
order; further columns, whatever they are called, are carried along and never read.
A null doc_id is an id like any other, but for near-duplicates, where such a row is
in no group.  Very long texts are read whole.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cedarflow.llm import decontam, langid, linededup, minhash, packing
from cedarflow.llm.common import discard, read_table, settled

#: Percent of shingles that near-duplicates share.
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones go.

    Null and empty texts, and texts without a letter, go.  Repeated rows are each
    judged, alike.  Without labelled rows nothing is recognised and all go.
    """
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere already.

    The first passage (smallest doc_id, a null one before all, then text) stays.
    Rows equal in doc_id and text are one document and keep theirs alike.  Null and
    empty texts stay; a document of which nothing but white space is left goes.
    ``n_chars`` is counted anew where lines went.
    """
    return linededup.keep_first_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Rows of that doc_id all stay, repeated ones too.  Texts without words, null or
    empty, are alike to nothing and stay, as do rows without a doc_id.
    """
    return minhash.keep_one_of_each(docs, SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark text.

    Null and empty texts have no words and stay; repeated rows are each judged,
    alike; an empty benchmark takes nothing away.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null or empty text is the end id alone; repeated rows are packed each, in any
    order.  The columns are the pieces', not those of ``docs``.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packed", packed)]

#: Hashed models, tokens and sketches are beyond SQL; the tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
