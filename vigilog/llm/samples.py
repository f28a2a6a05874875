"""Bounded, repeatable samples of labelled and unlabelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds,
                      F.lit(0)).cast("int")


def pick(keys: DataFrame, bound: int) -> DataFrame:
    """At most `bound` distinct keys, the first by hash: the same ones at every partitioning."""
    (key,) = keys.columns
    return (keys.where(F.col(key).isNotNull()).distinct()
            .orderBy(F.xxhash64(key, F.lit(17)), key).limit(bound))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, train: Column,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most `bound` labelled keys that satisfy `train`.

    Rows without a label don't count; a key labelled twice has the greater label, a key with
    several texts the least. The chosen keys are at most `bound`, so they are broadcast and the
    documents aren't shuffled.
    """
    given = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(train)
             .groupBy(key).agg(F.max(label).cast("int").alias("label")))
    chosen = given.orderBy(F.xxhash64(key, F.lit(17)), key).limit(bound)
    return texts_of(docs, chosen, key, text)


def texts_of(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    more = [c for c in chosen.columns if c != key]
    return (rows.join(F.broadcast(chosen), key)
            .groupBy(key, *more).agg(F.min("text").alias("text")))
