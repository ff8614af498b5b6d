"""The language of texts by a model of character trigrams that is learned from labelled texts.

Trigrams (of small letters, overlapping, over the whole text) are counted by language in one aggregate. A trigram is a number
below `CELLS`, from its three code points; so the model is a table of `CELLS` numbers for each language whatever the corpus,
small enough to be sent to every task. The language of a text is the one of greatest smoothed log-likelihood, ties to the
first by name; a text of fewer than `SHORT` characters, or of a language without a model, is English.

Defined cases: null texts are short; labels that are null are not learned from; without labelled texts all is English.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The language without evidence, and the characters that a text must have.
DEFAULT, SHORT = "en", 20
#: Numbers of trigrams, the weights of their first two characters, and languages at most.
CELLS, FIRST, SECOND, MOST = 1 << 14, 961, 31, 500
#: Characters that are turned into trigrams at once.
AT_ONCE = 1 << 19


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of each trigram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return doc[:0], codes[:0]
    same = doc[2:] == doc[:-2]
    return doc[2:][same], ((codes[:-2] * FIRST + codes[1:-1] * SECOND + codes[2:]) % CELLS)[same]


def _pieces(texts: list[str]):
    """Slices of the texts of about `AT_ONCE` characters, so that a batch's arrays stay small whatever its texts."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield slice(first, len(texts))


def learned(texts: DataFrame) -> dict[str, np.ndarray]:
    """Log-probability of each cell by language, from (text, lang)."""

    def run(incoming):
        total: dict[str, np.ndarray] = {}
        for b in incoming:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _pieces(texts):
                doc, cell = _cells(texts[part])
                for lang in set(langs[part]):
                    mine = np.array([x == lang for x in langs[part]])[doc]
                    total[lang] = total.get(lang, np.zeros(CELLS, np.int64)) + np.bincount(cell[mine], minlength=CELLS)
            if len(total) > MOST:
                raise ValueError(f"more than {MOST} languages")
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "cell", "n"])

    rows = texts.where("lang is not null and text is not null").select(F.lower("text"), F.col("lang").cast("string"))
    counts = rows.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    if counts.select("lang").distinct().count() > MOST:
        raise ValueError(f"more than {MOST} languages")
    model: dict[str, np.ndarray] = {}
    for lang, cell, n in zip(*(c.to_pylist() for c in counts.toArrow().columns), strict=True):
        model.setdefault(lang, np.zeros(CELLS))[cell] = n
    return {lang: np.log((n + 1) / (n.sum() + CELLS)) for lang, n in sorted(model.items())}


def detected(rows: DataFrame, model: dict[str, np.ndarray], text: str = "text", name: str = "language") -> DataFrame:
    """`rows` with the language of each text."""
    langs, table = list(model), np.array(list(model.values())).reshape(len(model), CELLS)

    def run(series):
        for s in series:
            texts = ["" if x is None else x for x in s]
            found: list[str] = []
            for part in _pieces(texts):
                doc, cell = _cells(texts[part])
                n = len(texts[part])
                score = np.stack([np.bincount(doc, weights=row[cell], minlength=n) for row in table]) if langs else np.zeros((1, n))
                found += [(langs or [DEFAULT])[i] for i in score.argmax(axis=0)]
            yield s.__class__(found, dtype=object)

    guess = F.pandas_udf(_series(run), "string")
    long = F.length(F.trim(F.coalesce(text, F.lit("")))) >= SHORT
    return rows.withColumn(name, F.when(long, guess(F.lower(text))).otherwise(DEFAULT))


def _series(run):
    from collections.abc import Iterator

    import pandas as pd

    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(series)

    of.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return of
