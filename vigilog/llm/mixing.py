"""Operator 12: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in an order by hash, are one long stream of words, cut into blocks of
equal length. A source's target fixes how many of its words are taken, to the word: whole passes
over the stream, and of the last pass the blocks that a keyed permutation of the block numbers puts
first, the last of them in part. So every source has an exact quota of block copies, each with a
place of its own.

The quotas are split among output shards of equal size by a binary tree: what a node holds of each
source is split between its halves by a multivariate hypergeometric draw, down to the shards. That
gives every shard a range of places per source, disjoint from all others, and the exact counts that
a shuffle of all blocks would have given, without one. Blocks are shuffled inside their shard only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vigilog.llm.common import few, mix as scramble
from vigilog.session import materialize

#: Words of a block; more where there would be more than MOST_BLOCKS (a limit of the draws).
BLOCK_WORDS = 256
MOST_BLOCKS = 400_000_000
#: Block copies of a shard.
SHARD_BLOCKS = 4096
#: Documents of a source that are laid end to end in one task; the square root of its documents
#: where that is more, so that its buckets are no more either.
DOCS_PER_BUCKET = 1000
#: Levels of the splitting tree that one task goes down.
LEVELS = 9
ROUNDS = 4


@dataclass(frozen=True)
class Mix:
    """`rows`: the documents with what is taken of them. `pieces`: the mix, by shard and place."""

    rows: DataFrame
    pieces: DataFrame


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 to n - 1, chosen by `key`, puts `i`: a balanced Feistel network
    over the next even number of bits, repeated until the value is below n."""
    bits = np.maximum(1, np.frexp((n - 1).astype(np.float64))[1] + 1 >> 1).astype(np.uint64)
    mask, key = (np.uint64(1) << bits) - np.uint64(1), key.astype(np.uint64)
    out, open_ = i.astype(np.uint64), np.arange(len(i))
    while len(open_):
        b, m, k, x = bits[open_], mask[open_], key[open_], out[open_]
        left, right = x >> b, x & m
        for turn in range(ROUNDS):
            left, right = right, left ^ (scramble(right + scramble(k + np.uint64(turn))) & m)
        out[open_] = left << b | right
        open_ = open_[out[open_] >= n[open_].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _place(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(i.to_numpy(), n.to_numpy(), key.to_numpy()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Adds `target` to (source, size): the sources by code point, null last, have the weights in
    turn, and `share` times all sizes is dealt out by weight; no target is above `most` times its
    source's size, what is above goes to the others by weight.

    Ranked in ranges, so many sources meet in no single task. Each round of dealing is one sum.
    """
    order = F.col("source").asc_nulls_last()
    placed = materialize(sources.repartitionByRange(order).sortWithinPartitions(order)
                         .withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(before, F.lit(0)).alias("_before"))      # one row per range
    ranked = placed.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn(
        "no", F.col("_at") - F.shiftleft("_part", 33) + F.col("_before"))
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("_w", F.get(turn, F.col("no") % len(weights)))
    cap = F.col("size") * most
    total, weight = weighed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    rate, full = (share * total / weight if weight else 0.0), None
    while True:
        above = cap <= F.col("_w") * F.lit(rate)
        held, free, now = weighed.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
                                      F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0)),
                                      F.count_if(above)).first()
        if now == full or not free:
            break
        full, rate = now, (share * total - held) / free
    target = F.when(above, cap.cast("double")).otherwise(F.col("_w") * F.lit(rate))
    return weighed.select("source", "no", "docs", "size", target.alias("target"))


def _quotas(sources: DataFrame, seed: int) -> DataFrame:
    """Adds block length and count, pass keys, and the quota of block copies to the targets.

    Before place `full` of pass `passes` all blocks are taken; of the one there, `part` words."""
    c = F.col
    blocks = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // MOST_BLOCKS + 1
    long = max(BLOCK_WORDS, blocks)
    out = (sources.withColumn("words", F.round("target").cast("bigint"))
           .withColumn("long", F.lit(long).cast("bigint"))
           .withColumn("n", F.ceil(c("size") / c("long")))
           .withColumn("short", c("n") * c("long") - c("size"))
           .withColumn("passes", F.expr("coalesce(words div nullif(size, 0), 0)"))
           .withColumn("rest", c("words") - c("passes") * c("size"))
           .withColumn("key", F.xxhash64(F.lit(seed), "source", F.lit("blocks"))))
    # The source's last block may be short: whether it comes before the cut decides the count.
    last = F.when(c("n") > 0, _place(F.greatest(c("n") - 1, F.lit(0)), F.greatest("n", F.lit(1)),
                                     F.xxhash64("key", "passes"))).otherwise(0)
    beyond = F.floor((c("rest") + c("short")) / c("long"))
    out = (out.withColumn("_last", last)
           .withColumn("full", F.when(beyond > c("_last"), beyond)
                       .otherwise(F.least(F.floor(c("rest") / c("long")), c("_last"))))
           .withColumn("part", c("rest") - c("full") * c("long")
                       + F.when(c("full") > c("_last"), c("short")).otherwise(0))
           .withColumn("quota", c("passes") * c("n") + c("full") + (c("part") > 0).cast("int")))
    return materialize(out.drop("_last"), "mix-quotas")


def _split(total: int, shards: int, seed: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Splits what a node (shards `lo` to `hi` - 1) holds of each source down the tree."""

    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("no")
        no, out = node["no"].to_numpy(), []
        stack = [(int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), node["first"].to_numpy(),
                  node["count"].to_numpy(), levels)]
        while stack:
            lo, hi, first, count, left = stack.pop()
            if hi - lo == 1 or not left:
                kept = count > 0
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "no": no[kept], "first": first[kept],
                                         "count": count[kept]}))
                continue
            middle = (lo + hi) // 2
            room = middle * total // shards - lo * total // shards
            draw = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(
                count, room, method="marginals")
            stack.append((lo, middle, first, draw, left - 1))
            stack.append((middle, hi, first + draw, count - draw, left - 1))
        return pd.concat(out, ignore_index=True)

    return run


def shard_ranges(quotas: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, int]:
    """(shard, no, first, count): the places of each source's block copies that a shard draws.

    `quotas` has (no, quota). A task goes `LEVELS` levels down the tree from a node; a node has one
    row per source, so the sources' names, not their rows, have to fit in a task.
    """
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_blocks))
    nodes = quotas.where("quota > 0").select(
        F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "no",
        F.lit(0).cast("bigint").alias("first"), F.col("quota").cast("bigint").alias("count"))
    width = shards
    while width > 1:
        nodes = nodes.groupBy("lo").applyInPandas(
            _split(total, shards, seed, LEVELS), "lo bigint, hi bigint, no bigint, first bigint, count bigint")
        width = -(-width // (1 << LEVELS))
    return materialize(nodes.select(F.col("lo").alias("shard"), "no", "first", "count"), "mix-shards"), shards


def _laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `start`, the words of the source before a document, in an order by hash.

    A source is cut into buckets by hash, so its rows are spread however many they are."""
    c = F.col
    high = F.shiftrightunsigned("h", 32)
    wide = F.greatest(F.lit(float(DOCS_PER_BUCKET)), F.sqrt("docs"))
    cut = rows.join(few(sources.select("source", "no", "docs")), rows["source"].eqNullSafe(sources["source"])).select(
        rows["*"], "no", F.shiftright(high * (1 + F.floor(c("docs") / wide)), 32).alias("bucket"))
    cut = materialize(cut, "mix-cut")
    before = (Window.unboundedPreceding, -1)
    sums = cut.groupBy("no", "bucket").agg(F.sum("size").alias("_n")).select(
        "no", "bucket", F.coalesce(F.sum("_n").over(
            Window.partitionBy("no").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("no", "bucket").orderBy(
        high, "h", "key", "content", "number").rowsBetween(*before))
    return cut.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(
        few(sums), ["no", "bucket"]).withColumn("start", c("_before") + c("_inside")).drop(
            "_before", "_inside", "bucket", "h")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
        seed: int = 12, key: str = "doc_id", text: str = "text", source: str = "source",
        keep: list[str] | None = None, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """The documents with their share of the mix, and the mix itself.

    `rows` has the columns in `keep` and, in place of any of that name, size (words), source_size,
    target (words, of the document's source) and taken (words of it in the mix, repeats counted).
    What is taken of a source is its target, rounded; of a document, at most `most` times its size.
    `pieces` has (shard, place, key, content, copy, first_word, n_words): stretches of documents in the
    order of the mix, content being the hash of the text. `texts` gives their words.
    A null source is a source of its own, the last; null and empty texts have size 0 and none of
    them is taken, and a source of them has target 0. Repeated rows are documents of their own; a
    null key is one like others. Very long texts are cut into blocks as others. An empty table gives
    empty tables. The same table gives the same mix, however it is partitioned.
    """
    c = F.col
    new = ["size", "source_size", "target", "taken"]
    kept = [x for x in (docs.columns if keep is None else keep) if x not in new]
    rows = materialize(docs.select(
        F.struct(*[c(f"`{x}`") for x in kept], F.lit(0).alias("_")).alias("row"),
        c(key).alias("key"), c(source).cast("string").alias("source"), word_count(c(text)).alias("size"),
        F.xxhash64(F.coalesce(c(text), F.lit(""))).alias("content"),
        F.monotonically_increasing_id().alias("number")), "mix-rows").withColumn(
            "h", F.xxhash64(F.lit(seed), "key", "content"))
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size"))
    sources = _quotas(targets(sums, weights, share, most), seed)
    ranges, shards = shard_ranges(sources, seed, shard_blocks)
    placed = materialize(_laid_out(rows, sources), "mix-places")
    pieces = materialize(_pieces(placed, sources, ranges, shards, seed), "mix-pieces")
    taken = pieces.groupBy("number").agg(F.sum("n_words").alias("taken"))
    facts = sources.select("no", F.col("size").alias("source_size"), "target")
    out = placed.join(few(facts), "no").join(taken, "number", "left").select(
        *[c(f"row.`{x}`").alias(x) for x in kept], "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return Mix(out, pieces.drop("number"))


def _pieces(placed: DataFrame, sources: DataFrame, ranges: DataFrame, shards: int, seed: int) -> DataFrame:
    """Every stretch of a document in a taken block copy, with its shard and place there."""
    c = F.col
    facts = few(sources.where("quota > 0").select("no", "n", "long", "passes", "full", "part", "quota",
                                                 F.col("key").alias("_key")))
    end = c("start") + c("size")
    copies = c("passes") + (c("passes") * c("n") < c("quota")).cast("int")
    cut = (placed.where("size > 0").join(facts, "no")
           .withColumn("block", F.explode(F.sequence(F.floor(c("start") / c("long")), F.floor((end - 1) / c("long")))))
           .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
           .withColumn("at", c("copy") * c("n") + _place("block", "n", F.xxhash64("_key", "copy"))))
    whole = c("passes") * c("n") + c("full")
    base = c("block") * c("long")
    lo = F.greatest("start", base)
    hi = F.least(end, base + F.when(c("at") < whole, c("long")).when(c("at") == whole, c("part")).otherwise(0))
    step = F.greatest(F.lit(1), F.ceil(c("quota") / F.lit(shards)))
    taken = cut.where(hi > lo).select(
        "number", "no", "key", "content", "copy", "at", (lo - c("start")).alias("first_word"),
        (hi - lo).alias("n_words"), F.floor(c("at") / step).alias("cell"), "start")
    # Ranges of places by the cells of equal length that they reach into, about two each.
    cells = ranges.join(few(sources.select("no", "quota")), "no").select(
        "shard", "no", "first", "count", F.explode(F.sequence(
            F.floor(c("first") / step), F.floor((c("first") + c("count") - 1) / step))).alias("cell"))
    found = taken.join(few(cells), ["no", "cell"]).where(
        (c("at") >= c("first")) & (c("at") < c("first") + c("count")))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "no", "at"), "no", "at", "start", "number")
    return found.select("shard", (F.row_number().over(order) - 1).alias("place"), "number", "key", "content",
                        "copy", "first_word", "n_words")


def texts(docs: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, place, key, words): the pieces' words, joined by blanks. Copies of a row are one text."""
    held = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_content"),
                       F.col(text).alias("_text")).dropDuplicates(["_key", "_content"])
    words = F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return pieces.join(held, pieces["key"].eqNullSafe(held["_key"]) & (pieces["content"] == held["_content"])).select(
        "shard", "place", "key", F.array_join(F.slice(
            words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("words"))


def write(docs: DataFrame, pieces: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the mix as Parquet, a folder per shard, in the order of places."""
    (texts(docs, pieces, key, text).repartition("shard").sortWithinPartitions("shard", "place")
     .write.partitionBy("shard").parquet(path))
