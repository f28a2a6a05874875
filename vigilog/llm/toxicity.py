"""Operator 5: toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained with numpy from confirmed toxic texts (positives, P) and texts of the
training folds whose label it does not look at (U). With the class prior p of toxic texts the risk is
p R(P, +) + max(0, R(U, -) - p R(P, -)): the unlabelled set stands for the negatives once the
positives in it are taken off, and the correction never drives the negative part below zero.
Features are words and word beginnings that positives have more often than other texts do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from vigilog.llm import samples
from vigilog.llm.common import Recent, extend, ids_of_pieces, small_batches, tidy
from vigilog.session import materialize

#: Documented bounds of the fit: positives, unlabelled texts, and features of the model.
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 8_000
FEATURES = 1_024
FOLDS = 5
#: Words: runs of Latin letters and digits, or of other letters; marks and underscores part them.
_WORD = re.compile(r"[0-9a-z\u00df-\u00f6\u00f8-\u024f]+|[^\W_0-9a-z\u00df-\u00f6\u00f8-\u024f]+")
#: Longer runs count by all their stretches of so many characters.
LONGEST_WORD, STRETCH = 48, 6


def features_of(piece: str) -> tuple[str, ...]:
    """Of each lower-cased word: itself and its beginnings of 4 to 6 letters.

    A run that is no single word, as it is very long or of a script written without blanks, counts by
    all of its stretches: six characters of a long Latin run, two and three of others.
    """
    out: list[str] = []
    for word in _WORD.findall(piece.lower()):
        n = len(word)
        if n <= LONGEST_WORD:
            out.append(word)
            out += [f"{word[:k]}-" for k in (4, 5, 6) if n > k]
        if n > LONGEST_WORD or word[0] > "\u024f":
            for k in (2, 3) if word[0] > "\u024f" else (STRETCH,):
                out += [f"~{word[i:i + k]}" for i in range(n - k + 1)]
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Model:
    """Feature weights and bias; `score` maps a text's distinct features to 0..1."""

    weights: dict[str, float]
    bias: float


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400,
             rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize the non-negative risk with the sigmoid loss (Adam).

    Rows are 0/1 feature vectors. When the negative part falls below zero its gradient is taken
    backwards, as the correction asks.
    """
    x = np.vstack([positive, unlabelled]).astype(np.float32)
    n_pos, n_unl = len(positive), len(unlabelled)
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = x @ theta[:-1] + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = s * (1 - s)
        negative = s[n_pos:].mean() - prior * s[:n_pos].mean()
        sign = 1.0 if negative >= 0 else -1.0
        g = np.empty(len(z))
        g[n_pos:] = sign * slope[n_pos:] / n_unl
        g[:n_pos] = -prior * slope[:n_pos] / n_pos * ((1 + sign) if sign > 0 else sign)
        grad = np.append(x.T @ g.astype(np.float32), g.sum()) + decay * np.append(theta[:-1], 0) / len(z)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic", train=None) -> Model | None:
    """Fits on at most MOST_POSITIVE labelled toxic and MOST_UNLABELLED other texts.

    `train` is a condition on the key (default: fold 1 to 4 of 5); neither positives nor
    unlabelled texts come from elsewhere. None if there is no positive or no other text.
    """
    train = samples.fold_of(key, FOLDS) != 0 if train is None else train
    known = labels.where(train & F.col(label).isNotNull())
    prior = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if not prior:
        return None
    positive = samples.labelled(docs, labels.where(F.col(label) == 1), label, MOST_POSITIVE,
                                train, key, text)
    others = samples.pick(docs.where(train).select(key), MOST_UNLABELLED)
    unlabelled = samples.texts_of(docs, others.withColumn("label", F.lit(0)), key, text)
    rows = materialize(positive.select("text", "label").unionByName(
        unlabelled.select("text", "label")), "toxicity-sample", compression="zstd")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl:
        return None
    names = _choose(rows, n_pos, n_unl)
    x, y = _matrix(rows, names)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weights, bias = fit_nnpu(x[y == 1], x[y == 0], prior)
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def _choose(rows: DataFrame, n_pos: int, n_unl: int) -> list[str]:
    """The FEATURES features whose share among positives most exceeds that among the others, in
    standard errors; each in three positives at least, or in two of fewer than a hundred."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for f in {f for w in t.split() for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()),
                 pa.array([c[1] for c in seen.values()], pa.int64()),
                 pa.array([c[0] for c in seen.values()], pa.int64())], ["f", "p", "u"])

    small_batches(rows.sparkSession)
    counts = (rows.select("text", "label").mapInArrow(tidy(count), "f string, p bigint, u bigint")
              .groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
              .where(F.col("p") >= (3 if n_pos >= 100 else 2)))
    share = (F.col("u") + 1) / (n_unl + 2)
    excess = (F.col("p") / n_pos - share) / F.sqrt(share * (1 - share) / n_pos)
    best = (counts.withColumn("excess", excess).where("excess > 2")
            .orderBy(F.desc("excess"), "f").limit(FEATURES))
    return [r.f for r in best.collect()]


def _matrix(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of the sampled texts, a few bytes per row and feature, and their labels."""
    index = {f: i for i, f in enumerate(names)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for t in batch.column(0).to_pylist():
                row = np.zeros(len(index), bool)
                row[[index[f] for w in set(t.split()) for f in features_of(w) if f in index]] = 1
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)],
                                             ["x", "label"])

    got = rows.select("text", "label").mapInArrow(tidy(bits), "x binary, label int").toPandas()
    raw = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), -1)
    return np.unpackbits(raw, axis=1)[:, :len(names)], got["label"].to_numpy()


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Adds the score (double, 0 to 1) of every whole text.

    Each distinct feature of a text counts once. Null and empty texts have the bias alone; equal
    texts have equal scores; without a model every score is 0. No row is dropped, no shuffle;
    the model of at most FEATURES weights travels with the task.
    """
    def build():
        if model is None:
            return lambda texts: [[0.0] * len(texts)]
        index = {f: i for i, f in enumerate(model.weights)}
        weights = np.array([*model.weights.values(), 0.0])
        recent = Recent(400_000)

        def lookup(piece: str) -> bytes:
            found = recent.get(piece)
            if found is None:
                found = np.array([index[f] for w in piece.split() for f in features_of(w)
                                  if f in index], "<u4").tobytes()
                recent.put(piece, found)
            return found

        def work(texts: list) -> list:
            flat, bounds = ids_of_pieces([t and t.replace("\n", " ") for t in texts], lookup,
                                         known=recent)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            once = np.unique(doc * len(weights) + flat)
            z = model.bias + np.bincount(once // len(weights), weights[once % len(weights)],
                                         len(texts))
            return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return work

    return extend(docs, text, [StructField(out, DoubleType())], build, keep)
