"""Nearest neighbours by cosine distance: exact, and approximate by hashed directions.

The query side is a short list of vectors (a handful of phrases) or a table, which is taken in
blocks. The corpus is scanned once per block: each task multiplies its Arrow batches with the query matrix and keeps its
own best `k`, so only `k` rows per query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.session import materialize

QueryVectors = list[tuple[str, Sequence[float]]]
#: Query vectors of one pass over the corpus, and of one product inside it.
QUERIES_PER_PASS, QUERIES_PER_PRODUCT = 2_048, 256


def query_blocks(queries: DataFrame) -> Iterator[QueryVectors]:
    """The rows `(query_id, vector)` in blocks that fit in a task; any number of them.

    Queries are dealt to blocks by hash and only one block is on the driver at a time (2,048
    vectors of 1,024 numbers are about 20 MB).
    """
    keyed = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    blocks = -(-keyed.count() // QUERIES_PER_PASS)
    if blocks > 1:
        keyed = materialize(keyed.withColumn(
            "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    for block in range(blocks):
        part = keyed if blocks == 1 else keyed.filter(F.col("block") == block)
        rows = part.select("query_id", "vector").orderBy("query_id").collect()
        if rows:
            yield [(row[0], row[1]) for row in rows]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms > 0, norms, 1.0)


def matrix_of(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _smallest(part: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    return part.sort_values([*keys, "distance", "id"]).groupby(keys, sort=False).head(k)


def nearest_candidates(corpus: DataFrame, queries: QueryVectors, k: int,
                       group: list[str] | None = None) -> DataFrame:
    """A superset of the `k` nearest rows per query (and `group`): each task's own best.

    `corpus` needs `id`, `embedding` and the group columns. Distances are rounded to six
    decimals so that ties are broken by id the same way everywhere. The zero vector is at
    distance 1 from everything.
    """
    group = group or []
    names = [name for name, _ in queries]
    unit = unit_rows(np.array([vector for _, vector in queries], dtype=np.float64))
    keys = [*group, "query_id"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(matrix_of(pdf["embedding"]))
        return pd.concat([scored(pdf, rows, at) for at in range(
            0, len(unit), QUERIES_PER_PRODUCT)], ignore_index=True)

    def scored(pdf: pd.DataFrame, vectors: np.ndarray, at: int) -> pd.DataFrame:
        some = slice(at, at + QUERIES_PER_PRODUCT)
        distance = np.round(1.0 - vectors @ unit[some].T, 6) + 0.0
        rows, width = distance.shape
        flat = distance.ravel()
        pick = np.arange(rows * width)
        if not group and rows > k:
            limit = np.partition(distance, k - 1, axis=0)[k - 1]
            pick = np.flatnonzero(distance <= limit)
        row, col = pick // width, pick % width
        part = {c: pdf[c].to_numpy()[row] for c in group}
        return pd.DataFrame({**part, "query_id": np.array(names[some], dtype=object)[col],
                             "id": pdf["id"].to_numpy()[row], "distance": flat[pick]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            part = _smallest(score(pdf), keys, k)
            if group:
                yield part
            else:
                best = part if best is None else _smallest(pd.concat([best, part]), keys, k)
        if best is not None:
            yield best

    fields = [corpus.schema[c] for c in group]
    schema = T.StructType([*fields, T.StructField("query_id", T.StringType()),
                           corpus.schema["id"], T.StructField("distance", T.DoubleType())])
    return corpus.select(*group, "id", "embedding").filter(
        F.col("embedding").isNotNull()).mapInPandas(run, schema)


def best_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The `k` rows of smallest distance per key with their rank."""
    order = Window.partitionBy(*keys).orderBy("distance", "id")
    return (scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
            .filter(F.col("rank") <= k))


def nearest(corpus: DataFrame, queries: QueryVectors | DataFrame, k: int) -> DataFrame:
    """`(query_id, rank, id, distance)`: the `k` nearest corpus rows of every query, exact.

    A table of queries `(query_id, vector)` is searched block by block, one pass over the corpus
    for each 2,048 queries.
    """
    if isinstance(queries, DataFrame):
        parts = [nearest(corpus, block, k) for block in query_blocks(queries)]
        return reduce(DataFrame.unionByName, parts) if parts else nearest(corpus, [], k)
    if k <= 0 or not queries:
        return nearest_candidates(corpus, queries or [("", [0.0])], 1).withColumn(
            "rank", F.lit(0).cast("bigint")).filter(F.lit(False))
    return best_k(nearest_candidates(corpus, queries, k), ["query_id"], k).select(
        "query_id", "rank", "id", "distance")


def direction_planes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def direction_buckets(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """One bucket number per table: the signs of `bits` random projections."""
    signs = (vectors @ planes.T >= 0).reshape(len(vectors), -1, bits)
    return signs @ (1 << np.arange(bits))


def with_buckets(corpus: DataFrame, dim: int, tables: int = 8, bits: int = 6,
                 seed: int = 7) -> DataFrame:
    """Adds `buckets ARRAY<INT>`, computed once when the corpus is stored."""
    planes = direction_planes(dim, tables, bits, seed)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors):
                found = direction_buckets(matrix_of(vectors), planes, bits).astype(np.int32)
                yield pd.Series(list(found), index=vectors.index, dtype=object)
            else:
                yield pd.Series([], dtype=object)

    return corpus.withColumn("buckets", run("embedding"))


def probes(bits: int, radius: int) -> np.ndarray:
    """The bit patterns of at most `radius` ones: a bucket xor these are its neighbours."""
    return np.array([sum(1 << b for b in flipped) for n in range(min(radius, bits) + 1)
                     for flipped in combinations(range(bits), n)])


def nearest_hashed(indexed: DataFrame, queries: QueryVectors | DataFrame, k: int, tables: int = 8,
                   bits: int = 6, seed: int = 7, radius: int = 2) -> DataFrame:
    """Approximate `nearest` over a corpus prepared by `with_buckets`.

    Only rows in a bucket at most `radius` signs away from one of some query's are scored; the
    bucket test is a plain filter on the stored array, so the corpus is not shuffled and a crowded
    bucket only means more rows to score in place. All candidates are re-ranked exactly. A
    neighbour is lost only if it differs in more than `radius` signs in every table.
    """
    if isinstance(queries, DataFrame):
        parts = [nearest_hashed(indexed, block, k, tables, bits, seed, radius)
                 for block in query_blocks(queries)]
        return reduce(DataFrame.unionByName, parts) if parts else nearest(indexed, [], k)
    matrix = np.array([vector for _, vector in queries], dtype=np.float64)
    planes = direction_planes(matrix.shape[1], tables, bits, seed)
    wanted = direction_buckets(matrix, planes, bits)
    shares = F.lit(False)
    for table in range(tables):
        values = np.unique(wanted[:, table, None] ^ probes(bits, radius)).tolist()
        shares = shares | F.get("buckets", F.lit(table)).isin(values)
    return nearest(indexed.filter(shares), queries, k)
