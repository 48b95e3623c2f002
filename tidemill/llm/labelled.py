"""Bounded samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folds of the hold-out rule; rows of fold 0 are never learned from.
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by ``FOLDS`` (a null id counts as 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("0")).cast("binary")) % FOLDS == 0


def sample_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, even: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` rows ``id, text, label`` outside the held-out fold, by the order of a hash of the id; texts are whole, however long.

    ``even``: as many rows for each label, as far as there are, so that rare labels are learned too.
    Of an id's several labels or texts the smallest counts; rows without an id or a label play no part.
    The chosen ids are few (``rows`` bounds them), so they are broadcast to one scan of the texts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    order = [F.xxhash64("id"), F.col("id"), F.col("label")]
    if even:
        counts = known.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(rows)
        quota = max(1, rows // max(counts.count(), 1))
        # A hash thins out common labels first, to a little over the quota, so that no task sorts all rows of one.
        place = F.pmod(F.xxhash64("id", F.lit("place")), F.lit(1 << 30)) / float(1 << 30)
        thin = known.join(F.broadcast(counts), "label").filter(place * F.col("n") < 1.3 * quota + 30).drop("n")
        known = thin.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("n") <= quota).drop("n")
    chosen = known.orderBy(*order).limit(rows).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
