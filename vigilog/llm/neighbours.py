"""Operator 2: text quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts is turned into weighted counts of hashed byte pairs; the
leading right singular vectors of that matrix span the latent space. The labelled vectors (their
number and width are parameters) travel with the task; every document's cosine with all of them is
computed exactly, in blocks, and its nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from vigilog.llm import samples
from vigilog.llm.common import extend, utf8
from vigilog.llm.rules import Document

#: Documented bounds of the fit: labelled rows, hashed byte pairs, latent dimensions, votes.
MOST_LABELLED = 6_000
BUCKETS = 1_024
EXTRA = 2
DIMENSIONS = 48
VOTERS = 15
FOLDS = 3
BLOCK = 512


def pair_counts(text: str | None) -> np.ndarray:
    """Damped counts of the text's byte pairs by bucket, then its shares of repeated words and
    of repeated lines, which no local count shows."""
    out = np.zeros(BUCKETS + EXTRA, np.float32)
    raw = np.frombuffer(utf8(text), np.uint8).astype(np.int32)
    if len(raw) < 2:
        return out
    pair = (raw[:-1] * 193 + raw[1:] * 7 + (raw[:-1] ^ raw[1:])) % BUCKETS
    out[:BUCKETS] = np.log1p(np.bincount(pair, minlength=BUCKETS))
    seen = Document(text)
    out[BUCKETS] = seen.repeated_words() / max(1, len(seen.words))
    out[BUCKETS + 1] = seen.duplicate_lines() / (seen.raw.count(b"\n") + 1)
    return out


@dataclass(frozen=True)
class Space:
    """Bucket weights, latent axes, and the labelled vectors (unit length) with their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        latent = unit(counts[:, :BUCKETS] * self.weight) @ self.axes
        return unit(np.hstack([unit(latent), counts[:, BUCKETS:]]))

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Scores of a block; the labels' mean where no neighbour is similar at all."""
        cosines = self.embed(counts) @ self.vectors.T
        k = min(VOTERS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 8
        total = w.sum(1)
        said = (w * self.labels[near]).sum(1)
        return np.where(total > 0, said / np.where(total > 0, total, 1), self.labels.mean())


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", train=None) -> Space | None:
    """Latent space and voters from at most MOST_LABELLED labelled rows in `train` (default:
    folds 0 and 2 of 3). None without such rows."""
    train = samples.fold_of(key, FOLDS) != 1 if train is None else train
    rows = samples.labelled(docs, labels, label, MOST_LABELLED, train, key, text)

    def build():
        return lambda texts: [[pair_counts(t).tobytes() for t in texts]]

    got = (extend(rows, "text", [StructField("x", BinaryType())], build, keep=[key, "label"])
           .orderBy(key).toPandas())
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), BUCKETS + EXTRA)
    pairs = x[:, :BUCKETS]
    weight = np.log((1 + len(x)) / (1 + (pairs > 0).sum(0))).astype(np.float32) + 0.1
    scaled = unit(pairs * weight)
    _, axes = np.linalg.eigh(scaled.T @ scaled)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    space = Space(weight, axes, np.zeros((0, 0)), got["label"].to_numpy(np.float64))
    return replace(space, vectors=space.embed(x).astype(np.float32))


def score(docs: DataFrame, space: Space | None, text: str = "text", out: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Adds the vote (double, 0 to 1) of every whole text's nearest labelled neighbours.

    Null, empty and one-byte texts are like no voter and get the labels' mean; without a space
    every score is 0.5. Equal texts have equal scores; no row is dropped; no shuffle.
    """
    # A broadcast rather than a closure: a megabyte or two, bounded by the parameters above.
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def build():
        space = sent.value

        def work(texts: list) -> list:
            if space is None:
                return [[0.5] * len(texts)]
            scores = [space.vote(np.stack([pair_counts(t) for t in texts[a:a + BLOCK]]))
                      for a in range(0, len(texts), BLOCK)]
            return [np.concatenate(scores) if scores else []]

        return work

    return extend(docs, text, [StructField(out, DoubleType())], build, keep)


def predicted(score: str = "score") -> F.Column:
    return (F.col(score) >= 0.5).cast("int")
