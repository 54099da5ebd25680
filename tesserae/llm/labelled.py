"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty

#: Most labelled documents that a classifier is fitted on.
FIT_DOCS = 6000
#: Most characters of text that are kept for fitting; sampled documents beyond it are left to scoring.
FIT_CHARS = 40_000_000


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = FIT_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` documents that ``learn`` admits, those of smallest hash.

    A document with several labels takes the largest; null labels do not count.
    Only the sampled ids' texts are kept, up to FIT_CHARS characters in all; one that
    does not fit is passed over, with a warning if its label is lost that way.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows of two numbers
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    texts, ys, chars, over = [], [], 0, set()
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if chars + len(r["text"]) > FIT_CHARS:
            over.add(int(r["y"]))
            continue
        chars += len(r["text"])
        texts.append(r["text"])
        ys.append(int(r["y"]))
    if lost := over - set(ys):
        warnings.warn(f"{label}: no text of label {sorted(lost)} fits {FIT_CHARS} characters", stacklevel=2)
    return texts, ys


def fitted(fit: Callable, docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int):
    """fit(texts, labels) of the sample; what fitting held besides the model is given back."""
    model = fit(*sample(docs, labels, label, learn, most))
    give_back()
    return model
