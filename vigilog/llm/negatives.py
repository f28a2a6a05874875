"""Operator 13: hard negatives by Strassen products of integer tiles and mergeable heaps.

Vectors become integers, so scores are exact. The anchors go over the table in blocks of bounded
size: every task multiplies the block's tile with tiles of its own rows by Strassen's recursion
(seven products of halves in place of eight, zero padding where a side is odd, exact integer
additions) and keeps a heap of the best rows per anchor. Heaps of tasks merge into one in two steps,
so that no step gathers more than the square root of the number of tasks. A first pass finds each
anchor's positives, a second one, which knows their scores, the best rows inside each window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.llm.common import small_batches
from vigilog.session import materialize, scratch_root

#: Anchors of one pass over the table, and the bytes that their vectors may take.
ANCHORS = 4096
ANCHOR_BYTES = 32 << 20
#: Rows of a candidate tile; anchors are taken in tiles of a quarter of it.
TILE = 2048
#: Sides up to which a product is taken directly.
LEAF = 32
#: What no score is: the heaps' empty place.
LOW = np.iinfo(np.int64).min
#: Parts into which the heaps of a pass are merged before the last merge.
PARTS = 64


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices; exact wherever the entries fit in 64 bits.

    Sums inside the recursion may wrap around; they do so modulo 2^64, so the entries come right.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), a.dtype)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of `a` with the rows of `b`; a score beyond 64 bits is an error."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = np.abs(a.astype(np.float64)).max(0, initial=0) @ np.abs(b.astype(np.float64)).max(0, initial=0)
    if most >= 2.0 ** 62:
        raise ArithmeticError("the inner products of these vectors don't fit in 64 bits")
    return strassen(a, np.ascontiguousarray(b.T))


class Heaps:
    """The `k` best (score, row) of each of several slots; ties go to the lesser id, nulls last."""

    FIELDS = ("slot", "score", "blank", "id", "number")

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, LOW)
        self.held = {f: np.empty(0, np.int64) for f in self.FIELDS}

    def offer(self, first: int, scores: np.ndarray, allowed: np.ndarray, rows: dict) -> None:
        """Scores of the slots from `first` on with tile rows in the order of (blank, id)."""
        s = np.where(allowed, scores, LOW)
        slots, width = s.shape
        least = self.least[first:first + slots]
        if width > self.k:
            least = np.maximum(least, np.partition(s, width - self.k, axis=1)[:, width - self.k])
        least = least[:, None]
        # Of the scores that tie with the last place, only the first k rows can matter.
        ties = (s == least) & (s > LOW)
        slot, row = np.nonzero((s > least) | ties & (np.cumsum(ties, axis=1) <= self.k))
        if len(slot):
            self.merge({"slot": slot + first, "score": s[slot, row],
                        **{f: rows[f][row] for f in ("blank", "id", "number")}})

    def merge(self, more: dict) -> None:
        h = {f: np.concatenate([self.held[f], more[f]]) for f in self.FIELDS}
        order = np.lexsort((h["number"], h["id"], h["blank"], -h["score"], h["slot"]))
        slot = h["slot"][order]
        starts = np.searchsorted(slot, np.arange(len(self.least)))
        place = np.arange(len(slot)) - starts[slot]
        self.held = {f: h[f][order][place < self.k] for f in self.FIELDS}
        last = slot[place == self.k - 1]
        self.least[last] = h["score"][order][place == self.k - 1]


def prepared(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(number, id, label, v) of the rows that take part; components as floor(256 * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    group = F.col(label).cast("bigint")
    relabelled = F.when(F.col(key) % 7 == 0, (group + 1) % 10).otherwise(group)
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return materialize(rows.select(
        F.monotonically_increasing_id().alias("number"), F.col(key).cast("bigint").alias("id"),
        relabelled.alias("label"),
        F.transform(vector, lambda x: F.floor(256 * x.cast("double"))).alias("v")), "vectors", "zstd")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten(), np.int64)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """The rows of a partition in tiles, each in the order of (blank, id)."""
    for batch in batches:
        for a in range(0, len(batch), TILE):
            part = batch.slice(a, TILE)
            number, key, label = (part.column(i) for i in range(3))
            rows = {"number": np.asarray(number), "blank": np.asarray(key.is_null()).astype(np.int64),
                    "id": np.asarray(key.fill_null(0)), "label": np.asarray(label)}
            order = np.lexsort((rows["number"], rows["id"], rows["blank"]))
            yield {f: x[order] for f, x in rows.items()}, _matrix(part.column(3))[order]


def _pass(rows: DataFrame, slots: int, k: int, work: Callable) -> DataFrame:
    """(slot, score, blank, id, number, rank): what `work(heaps, tile, vectors)` keeps, merged."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(slots, k)
        for tile, vectors in _tiles(batches):
            work(heaps, tile, vectors)
        here = TaskContext.get()
        part = np.full(len(heaps.held["slot"]), (here.partitionId() if here else 0) % PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(heaps.held[f]) for f in Heaps.FIELDS] + [pa.array(part)],
            names=[*Heaps.FIELDS, "part"])

    kept = rows.mapInArrow(run, ", ".join(f"{f} bigint" for f in (*Heaps.FIELDS, "part")))
    best = [F.desc("score"), "blank", "id", "number"]
    for keys in (["slot", "part"], ["slot"]):               # the second merge sees k rows a part
        kept = kept.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return kept.drop("part")


def _blocks(rows: DataFrame, anchor: Column) -> list[Column]:
    """Conditions that deal the anchors into blocks whose vectors fit in a task."""
    n, width = rows.where(anchor).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(16, min(ANCHORS, ANCHOR_BYTES // (8 * max(width, 1))))
    if n <= most:
        return [anchor]
    blocks = -(-4 * n // (3 * most))                        # by hash, so with a quarter to spare
    return [anchor & (F.pmod(F.xxhash64("number"), F.lit(blocks)) == b) for b in range(blocks)]


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         anchor: Column | None = None, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` tells the anchors by the columns id and label (default: id divisible by 100). An
    anchor's positives are its best `positives` other rows of its label; a pair's negatives are the
    best `negatives` rows of other labels whose scores lie within `low` to `high` percent of the
    positive's. Rows with a null label or vector, or a null or non-finite component, take no part.
    A null id is no anchor and loses every tie. Repeated rows are rows of their own, so a copy of
    an anchor is its positive and an anchor too. Shorter vectors count as ending in zeros, empty
    ones score 0; a score beyond 64 bits is an error. Other columns don't matter, whatever their
    names; an empty table gives no rows. Every row is scored against every anchor.
    """
    spark = df.sparkSession
    rows = prepared(df, key, vector, label)
    chosen = F.coalesce(F.col("id") % 100 == 0, F.lit(False)) if anchor is None else anchor
    root = f"{scratch_root(spark)}/hard-negatives-{uuid.uuid4().hex}"
    for i, block in enumerate(_blocks(rows, chosen)):
        _mine_block(spark, rows, block, positives, negatives, low, high).write.parquet(f"{root}/block={i}")
    return spark.read.parquet(root).drop("block")


def _mine_block(spark: SparkSession, rows: DataFrame, block: Column, positives: int, negatives: int,
                low: int, high: int) -> DataFrame:
    # A bounded number of anchors; they are sent to the tasks with the functions below.
    got = rows.where(block).orderBy("number").toArrow().combine_chunks()
    column = lambda name: got.column(name).combine_chunks()
    vectors = _matrix(column("v"))
    number, own, label = (np.asarray(column(c)) for c in ("number", "id", "label"))
    n, step = len(number), TILE // 4

    def nearest(heaps: Heaps, tile: dict, candidates: np.ndarray) -> None:
        for a in range(0, n, step):
            part = slice(a, a + step)
            same = (label[part, None] == tile["label"]) & (number[part, None] != tile["number"])
            heaps.offer(a, products(vectors[part], candidates), same, tile)

    found = _pass(rows, n, positives, nearest).orderBy("slot", "rank").toArrow()
    slot, score, blank, ids = (np.asarray(found[c].combine_chunks())
                               for c in ("slot", "score", "blank", "id"))
    # One heap per pair of anchor and positive; pairs of the same place are offered together.
    place = np.asarray(found["rank"].combine_chunks(), np.int64) - 1
    wanted = np.full((n, positives), LOW)
    wanted[slot, place] = score

    def inside(heaps: Heaps, tile: dict, candidates: np.ndarray) -> None:
        for a in range(0, n, step):
            part = slice(a, a + step)
            s = products(vectors[part], candidates)
            other = label[part, None] != tile["label"]
            for p in range(positives):
                goal = wanted[part, p, None]
                fits = (goal > LOW) & other & _within(s, goal, low, high)
                heaps.offer(p * n + a, s, fits, tile)

    ranked = _pass(rows, n * positives, negatives, inside)
    pairs = pa.table({"slot": place * n + slot, "anchor_id": own[slot],
                      "positive_id": pa.array(ids, mask=blank.astype(bool)), "positive_score": score})
    return ranked.join(F.broadcast(spark.createDataFrame(pairs)), "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.when(F.col("blank") == 0, F.col("id")).alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _within(score: np.ndarray, goal: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether low * goal <= 100 * score <= high * goal, without leaving 64 bits."""
    # 100 * s >= t holds if s is at least the ceiling of t / 100, and likewise below.
    goal = np.where(goal > LOW, goal, 0)
    whole, rest = np.divmod(goal, 100)
    least = low * whole + -(-low * rest // 100)
    most = high * whole + high * rest // 100
    return (score >= least) & (score <= most)
