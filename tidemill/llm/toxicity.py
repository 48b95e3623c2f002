"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

Features are the presence of byte 4-, 5- and 6-grams (letters folded) in the whole text.  On the labelled
sample each n-gram gets the smoothed log-count ratio r of its counts in toxic and
other texts; the ``FEATURES`` n-grams with the most significant ratios stay.  A logistic
regression with an L2 penalty is trained on the presence vectors multiplied by r.

The sample holds ``SAMPLE`` labelled rows at most, of any length, none from the held-out fold.  Executors count its n-grams and find its
features; the driver gets the chosen n-grams and one list of feature numbers a row.

Every text is scored whole, however long; null and empty texts get the score of a text without features.  Without labels of both kinds
every score is next to the label there is (0 if none).  Rows are scored one by one, so repeated rows and equal texts have equal scores; an
empty table gives an empty result.  ``with_toxicity`` adds the column ``__toxic``, in place of one of that name; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import vectext as V
from .labelled import held_out, sample_texts
from .store import Scratch

SAMPLE = 8000
BITS, SIZES = 20, (4, 5, 6)
FEATURES = 1024
SMOOTH = 1.0
LAMBDA = 1e-4


def _present(column: pa.Array, keep: np.ndarray | None = None):
    """Pairs (row, bucket) of the n-grams that occur in each text, without repeats, by slices.

    keep: a table bucket -> feature number from 1, 0 for buckets without one.
    """
    data, offsets = V.utf8(column)
    for i, j in V.slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = V.FOLD[data[offsets[i] : offsets[j]]]
        keys = []
        for n in SIZES:
            g, row = V.ngrams(part, own, n, BITS)
            if keep is not None:
                g = keep[g]
                row, g = row[g > 0], g[g > 0]
            keys.append((row.astype(np.int64) << BITS) | g.astype(np.int64))
        k = np.unique(np.concatenate(keys))
        yield i, j, k >> BITS, k & ((1 << BITS) - 1)


class Model:
    """feature: bucket -> feature number from 1; weight: by feature number."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, bias: float):
        self.feature, self.weight, self.bias = feature, weight, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for i, j, row, f in _present(column, self.feature):
            out[i:j] += np.bincount(row, self.weight[f], j - i)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def _logistic(rows, cols, n, m, y, steps=300):
    """Weights and bias of an L2-penalised logistic regression on sparse 0/1 rows already scaled; Adam on the full batch."""
    at, value = cols
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, value * w[at], n) + b
        d = (1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - y) / n
        gw, gb = np.bincount(at, value * d[rows], m) + LAMBDA * w, float(d.sum())
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.05 * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def _constant(toxic: bool) -> Model:
    return Model(np.zeros(1 << BITS, np.uint32), np.zeros(1), 35.0 if toxic else -35.0)


def _counted(batches):
    """Texts of either label that hold each n-gram, of one partition."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)
        for i, _, row, g in _present(batch.column("text")):
            for k in (0, 1):
                counts[k] += np.bincount(g[toxic[row + i] == k], minlength=1 << BITS)
    some = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(some), 100_000):
        at = some[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["gram", "other", "toxic"])


def _found(batches, table):
    """Each text's feature numbers."""
    for batch in batches:
        lists: list[np.ndarray] = []
        for i, j, row, f in _present(batch.column("text"), table):
            lists += np.split(f.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["id", "label", "features"])


def _sliced(batches, rows=1000):
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def fit(sample: DataFrame) -> Model:
    """The model of ``id, text, label``; ``sample`` is read several times."""
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    if toxic in (0, n):
        return _constant(n > 0 and toxic == n)
    counts = sample.select("text", "label").mapInArrow(lambda it: _counted(_sliced(it)), "gram int, other long, toxic long").groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    seen, share = F.col("other") + F.col("toxic"), toxic / n
    z = (F.col("toxic") - share * seen) / F.sqrt(share * (1 - share) * seen + 1.0)
    best = counts.filter(seen >= 4).withColumn("z", z).filter("z <> 0").orderBy(F.abs("z").desc(), "gram").limit(FEATURES).toPandas().sort_values("gram")
    ratio = np.log(((best["toxic"] + SMOOTH) / (SMOOTH + toxic)) / ((best["other"] + SMOOTH) / (SMOOTH + n - toxic))).to_numpy()
    table = np.zeros(1 << BITS, np.uint32)
    table[best["gram"].to_numpy()] = np.arange(1, len(best) + 1)
    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(lambda it: _found(_sliced(it), table), f"id {kind}, label int, features array<int>").toArrow().sort_by("id")
    y = rows["label"].to_numpy().astype(np.float64)
    held = rows["features"].combine_chunks()
    cols = held.flatten().to_numpy().astype(np.int64)
    who = np.repeat(np.arange(len(y)), np.diff(held.offsets.to_numpy()))
    scale = np.concatenate([[0.0], ratio])
    w, b = _logistic(who, (cols, scale[cols]), len(y), len(scale), y)
    return Model(table, w * scale, b)


def _score(batches, model, text_col, drop):
    for batch in batches:
        s = model.scores(batch.column(text_col))
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != drop), pa.array(s)], [*(n for n in batch.schema.names if n != drop), "__toxic"])


def with_toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the score in ``__toxic``.

    ``labels`` has ids and the 0/1 column ``label``; texts to learn from come from ``learn_from`` (``docs`` by default).
    """
    ship(docs.sparkSession)
    docs = docs.drop("__toxic")
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = fit(scratch.put(sample_texts(docs if learn_from is None else learn_from, labels, label, SAMPLE, False, id_col, text_col), "sample"))
    drop = None if keep_text else text_col
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != drop)
    return docs.mapInArrow(lambda it: _score(_sliced(it), model, text_col, drop), f"{fields}, __toxic double")


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document of ``docs``."""
    scored = with_toxicity(docs.select(id_col, text_col), labels, learn_from, label, id_col, text_col, keep_text=False)
    return scored.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col("__toxic").alias("score"), (F.col("__toxic") >= 0.5).cast("int").alias("predicted"))
