"""Language identification by multilingual mixtures.

A text is modelled as byte trigrams (letters folded, everything that is not a letter
read as one space) drawn from a mixture of the learned languages' trigram distributions.
Expectation-maximisation estimates the mixture's proportions for a set of languages; the set
starts with the single likeliest language and grows by the language whose addition
raises the log-likelihood most, while the gain is above the penalty
``PENALTY * log(trigrams)`` per language.  The prediction is the language of
the largest proportion.  Its score is the posterior mean of that proportion (a uniform prior over the learned languages counts like one
trigram of each) times the posterior probability of the language against those that were left out.

The trigram models are counted by executors on a bounded sample of labelled texts of any length: ``SAMPLE`` rows, as many for each language as
far as there are, none of them from the held-out fold.  The model has 65,536 numbers a language.  Every text is scored whole, however long.

Null texts and texts without a letter are ``und`` with score 0; so is everything when no
labelled text exists.  Ties go to the language that sorts first.  Rows are judged one by one, so repeated rows and equal texts have equal
results; an empty table gives an empty result.  ``with_language`` adds the columns ``__lang``, ``__score`` and ``__langs``, in place of columns
of these names; other columns stay.
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

SAMPLE = 4000
BITS = 16
SMOOTH = 0.5
PENALTY = 8.0
ROUNDS = 12
_LETTER = V.FOLD.copy()
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[65:91] = True
_IS_LETTER[128:] = True
_LETTER[~_IS_LETTER] = 32
_BLANK = int(V.ngrams(np.full(3, 32, np.uint8), np.array([0, 3]), 3, BITS)[0][0])


def _grams(column: pa.Array):
    """For each text: distinct trigram buckets and their counts."""
    data, offsets = V.utf8(column)
    for i, j in V.slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = _LETTER[data[offsets[i] : offsets[j]]]
        g, row = V.ngrams(part, own, 3, BITS)
        g = g.astype(np.uint16)
        at = V.row_bounds(row, 0, j - i)
        for a, b in zip(at[:-1], at[1:], strict=True):
            u, c = np.unique(g[a:b], return_counts=True)
            if len(u):
                ok = u != _BLANK
                u, c = u[ok], c[ok]
            yield u, c.astype(np.float64)


def has_letter(text: str | None) -> bool:
    """Whether any character is a Unicode letter."""
    if not text:
        return False
    return any(ch.isalpha() for ch in text[:64]) or any(ch.isalpha() for ch in text)


def _counted(batches):
    """Trigrams of each label, of one partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for (u, c), lang in zip(_grams(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            counts.setdefault(lang, np.zeros(1 << BITS))[u] += c
    for lang, held in sorted(counts.items()):
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(held[some])], ["label", "gram", "n"])


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names, and a matrix (bucket, language) of probabilities, of ``text, label``."""
    rows = sample.select("text", F.col("label").cast("string").alias("label")).mapInArrow(_counted, "label string, gram int, n double").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["label"].to_pylist()))
    counts = np.zeros((1 << BITS, len(names)))
    where = {x: k for k, x in enumerate(names)}
    counts[rows["gram"].to_numpy(), np.array([where[x] for x in rows["label"].to_pylist()], np.int64)] = rows["n"].to_numpy()
    counts += SMOOTH * 1e-2
    return names, counts / counts.sum(axis=0) if names else counts


def proportions(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the mixture's proportions over the columns of p (grams, languages), and the log-likelihood."""
    pi = np.full(p.shape[1], 1.0 / p.shape[1])
    total = c.sum()
    for _ in range(rounds):
        pi = pi * ((c / (p @ pi)) @ p) / total
    return pi, float(c @ np.log(p @ pi))


def infer(p: np.ndarray, c: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The chosen set of languages, its proportions, and every language's log-likelihood alone."""
    single = c @ np.log(p)
    chosen, pi, best = [int(single.argmax())], np.ones(1), float(single.max())
    price = PENALTY * np.log(c.sum() + 1.0)
    while len(chosen) < p.shape[1]:
        tried = []
        for k in range(p.shape[1]):
            if k not in chosen:
                cols = [*chosen, k]
                q, ll = proportions(p[:, cols], c)
                tried.append((ll, -k, cols, q))
        ll, _, cols, q = max(tried, key=lambda x: x[:2])
        if ll - best <= price:
            break
        chosen, pi, best = cols, q, ll
    return chosen, pi, single


def confidence(language: int, share: float, chosen: list[int], single: np.ndarray, grams: float) -> float:
    """The score of a prediction; see the module's text."""
    left = [k for k in range(len(single)) if k not in chosen]
    posterior = 1.0 / (1.0 + np.exp(np.minimum(single[left] - single[language], 700.0)).sum())
    return float(posterior * (share * grams + 1.0) / (grams + len(single)))


def _predict(batches, names, table, text_col, drop):
    for batch in batches:
        texts = batch.column(text_col)
        lang, score, mixture = [], [], []
        for (u, c), text in zip(_grams(texts), texts, strict=True):
            if not names or not has_letter(text.as_py()):
                lang.append("und")
                score.append(0.0)
                mixture.append([])
                continue
            if not len(u):  # letters, but no trigram
                u, c = np.array([_BLANK]), np.ones(1)
            chosen, pi, single = infer(table[u], c)
            order = sorted(range(len(chosen)), key=lambda i: (-pi[i], names[chosen[i]]))
            lang.append(names[chosen[order[0]]])
            score.append(confidence(chosen[order[0]], float(pi[order[0]]), chosen, single, float(c.sum())))
            mixture.append([names[chosen[i]] for i in order])
        new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != drop), *new], [*(n for n in batch.schema.names if n != drop), "__lang", "__score", "__langs"])


def with_language(docs: DataFrame, learn_from: DataFrame | None = None, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``__lang``, ``__score`` and ``__langs`` (the chosen set, largest share first).

    ``learn_from`` (``docs`` by default) has ids, texts and the language column ``label``.
    """
    ship(docs.sparkSession)
    docs = docs.drop("__lang", "__score", "__langs")
    source = docs if learn_from is None else learn_from
    scratch = Scratch(docs.sparkSession, "language")
    names, table = fit(scratch.put(sample_texts(source, source, label, SAMPLE, True, id_col, text_col), "sample"))
    drop = None if keep_text else text_col
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != drop)
    return docs.mapInArrow(
        lambda it: _predict((b.slice(i, 1000) for b in it for i in range(0, b.num_rows, 1000)), names, table, text_col, drop),
        f"{fields}, __lang string, __score double, __langs array<string>",
    )


def identify(docs: DataFrame, learn_from: DataFrame | None = None, label: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` per document."""
    source = docs if learn_from is None else learn_from
    named = with_language(docs.select(id_col, text_col), source, label, id_col, text_col, keep_text=False)
    return named.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__langs").alias("languages")
    )
