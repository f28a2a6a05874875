"""Text embedding: the plug-in contract and the default hashed bag of words.

An embedder turns a list of texts into a matrix, one row per text. Spark feeds it Arrow
batches through an iterator UDF, so a model is built once per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
EmbedderFactory = Callable[[], Embedder]

#: Texts whose words are held at once.
TEXTS_AT_ONCE = 256
_WORD = re.compile("[a-z0-9]+")


def hashed_words(dim: int = 64) -> EmbedderFactory:
    """Word counts in `dim` buckets, scaled to unit length.

    A word's bucket is the first four hex digits of its MD5, modulo `dim`. A text without
    words becomes the zero vector.
    """

    def build() -> Embedder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            if len(buckets) > 100_000:
                buckets.clear()
            found = buckets.get(word)
            if found is None:
                found = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim
            return found

        def embed(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dim))
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                words = [_WORD.findall((t or "").lower()) for t in texts[at:at + TEXTS_AT_ONCE]]
                cells = np.fromiter((i * dim + bucket(w) for i, found in enumerate(words) for w in found), np.int64)
                counts[at:at + len(words)] = np.bincount(cells, minlength=len(words) * dim).reshape(-1, dim)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return (counts / np.where(norms > 0, norms, 1.0)).astype(np.float32)

        return embed

    return build


def embedding(text: Column, embedder: EmbedderFactory | None = None) -> Column:
    """`ARRAY<FLOAT>` vectors of a text column."""
    factory = embedder or hashed_words()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = factory()
        for texts in batches:
            vectors = np.asarray(embed(texts.to_pylist()), np.float32)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            width = vectors.shape[1] if len(vectors) else 0
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()),
                                           pa.array(vectors.ravel(), pa.float32()))

    return run(text)


def with_embedding(df: DataFrame, text_column: str = "document",
                   embedder: EmbedderFactory | None = None) -> DataFrame:
    return df.withColumn("embedding", embedding(F.col(text_column), embedder))
