"""A corpus from language identification to packed sequences: the stages, and their run on ``documents``.

Each stage gets its predecessor's rows (columns of ``documents``) as a table of its own and returns what it
keeps; only the last returns packed pieces.  An empty table gives an empty one in every stage, other columns than those of ``documents`` go.
Rows are judged one by one by their texts: rows that repeat an id, and rows without one, are kept or go like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import store
from tidemill.llm.langid import with_language
from tidemill.llm.linededup import line_dedup
from tidemill.llm.neardup import without_near_duplicates
from tidemill.llm.packing import pack
from tidemill.llm.queries import table, tokenizer
from tidemill.llm.toxicity import with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = r"[^\x20\x09-\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null and empty texts, texts without a letter; all, if nothing was learned."""
    return with_language(docs.select(COLUMNS)).filter("__lang <> 'und'").select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says toxic go; null and empty texts have the score of a text without features."""
    return with_toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("__toxic < 0.5").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and passages go, and documents of which nothing is left; ``n_chars`` follows a text that was cut.

    Texts without words (null, empty) have nothing to lose and stay.
    """
    done = line_dedup(docs.select(COLUMNS))
    cut = F.col("runs").isNotNull()
    left = done.filter(~cut | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5 words, 0.8) stays: the one with the smallest id, those without an id last.

    Rows equal in id and text are one document.  Documents without words are near nothing and stay.
    """
    return without_near_duplicates(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed along the curve; null and empty texts have the end mark alone."""
    return pack(docs, tokenizer())


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = store.Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        begun = store.mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, name)
            store.release(begun)  # the stage's own tables are read no more
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
