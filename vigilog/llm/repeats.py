"""Operator 6: substring deduplication with prefix-partitioned suffix trees.

A window is `width` consecutive words; it is repeated if the same words also start elsewhere.

1. Every window has an anchor: of its `CORE`-word stretches the one with the least hash, the first
   of equals. Equal windows have equal anchors at equal distances, so a window whose anchor stands
   nowhere else is unique. Neighbouring windows mostly share an anchor; a run of windows with one
   anchor is a segment, about fifty words long.
2. Segments are partitioned by their anchor, the prefix that all suffixes of a group share with
   one another from the anchor on. Equal segments are one, with a count.
3. In a task the suffixes of many groups are refined together: words, pairs, fours and so on up to
   `width` words, so that each class is a node of the groups' suffix trees at that depth. Nodes at
   full depth with more than one leaf are the repeats; neighbouring ones make maximal repeats.
4. A group that is too large for a task is split by the longest prefix, the whole window: each
   window then is a leaf that is counted by a pre-aggregating shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from vigilog.llm.common import (
    extend,
    few,
    fresh,
    hex_digest,
    small_batches,
    tidy,
    window_hashes,
    word_hashes,
)
from vigilog.session import materialize

WIDTH = 35
CORE = 8
#: Distinct segments of one anchor that a task takes; larger groups get longer prefixes.
GROUP_SEGMENTS = 20_000
#: Words of the groups that are refined together; a word takes about 150 bytes there.
TASK_WORDS = 1 << 17


class Segments:
    """The segments of a batch of texts, by flat word place: anchor, first and last window."""

    def __init__(self, texts: list, width: int):
        self.words, self.bounds = word_hashes(texts, lower=False)
        n, span = len(self.words), width - CORE + 1
        sizes = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - width + 1, 0))
        skipped = np.repeat(self.bounds[:-1], np.maximum(sizes - width + 1, 0))
        inside = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        starts = skipped + inside                           # all windows, in order
        if not len(starts):
            self.key = np.zeros(0, np.uint64)
            self.anchor = self.first = self.last = self.doc = np.zeros(0, np.int64)
            return
        core = window_hashes(self.words, CORE)
        # Order of (hash, place) without equals, so the least of a window is one place.
        if n < 1 << 24:
            ranked = (core & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(core), dtype=np.uint64)
            place = np.uint64(0xFFFFFF)
        else:
            order = np.argsort(core, kind="stable")
            ranked = np.empty(len(core), np.uint64)
            ranked[order] = np.arange(len(core), dtype=np.uint64)
            place = None
        least, have = ranked, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
        anchor = (least[starts] & place if place is not None else order[least[starts]]).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(self.doc) != 0)
        at = np.nonzero(new)[0]
        self.anchor, self.first, self.doc = anchor[at], starts[at], self.doc[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1]
        self.key = core[self.anchor]


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc, first): the anchor's hash and the place of the segment's first window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Segments(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.key.astype(np.int64)), batch.column(0).take(pa.array(s.doc)),
                 pa.array((s.first - s.bounds[:-1][s.doc]).astype(np.int32))],
                ["key", "doc", "first"])

    return docs.select("doc", "text").mapInArrow(tidy(run), "key bigint, doc bigint, first int")


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc, version, first, windows, digest, words) of segments whose anchor recurs."""
    anchors = _anchors(docs, width)
    # Written first: a join of two plain shuffles can split a key that very many anchors have.
    often = materialize(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
                        .select("key"), "repeated-anchors")
    places = materialize(_anchors(docs, width).join(often, "key").select("doc", "first"), "places")
    wanted = places.groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_set("first").alias("firsts"))
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    flagged = few(places.select(F.col("doc").alias("_doc")).distinct())
    rows = (docs.join(flagged, same, "left_semi").join(wanted, same)
            .select("doc", "version", "text", "firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column(2).to_pylist()
            s = Segments(texts, width)
            local = s.first - s.bounds[:-1][s.doc]
            picked = [set(f) for f in batch.column(3).to_pylist()]
            use = [i for i, (d, f) in enumerate(zip(s.doc.tolist(), local.tolist()))
                   if f in picked[d]]
            split, words, digests = {}, [], []
            for i in use:
                d = int(s.doc[i])
                if d not in split:
                    split = {d: texts[d].encode("utf-8", "surrogatepass").split()}
                a = int(local[i])
                text = b" ".join(split[d][a:a + int(s.last[i] - s.first[i]) + width])
                words.append(text)
                digests.append(xxh3_128_digest(text))
            use = np.array(use, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.key[use].astype(np.int64)), batch.column(0).take(pa.array(s.doc[use])),
                 batch.column(1).take(pa.array(s.doc[use])), pa.array(local[use].astype(np.int32)),
                 pa.array(digests, pa.binary()), pa.array(words, pa.binary())],
                ["key", "doc", "version", "first", "digest", "words"])

    return rows.mapInArrow(tidy(run), "key bigint, doc bigint, version bigint, first int,"
                                " digest binary, words binary")


def refine(words: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Node of each place in the suffix trees at depth `width`; -1 where a text ends before.

    `ends` is the end of the text that a place lies in. Depths double: a node at depth 2d is the
    pair of the nodes at depth d of a place and of the place d further on.
    """
    n = len(words)
    node = np.unique(words, return_inverse=True)[1].astype(np.int64)
    depth, place = 1, np.arange(n)
    while depth < width:
        step = min(depth, width - depth)
        reach = place + depth + step <= ends
        then = np.zeros(n, np.int64)
        then[:n - step] = node[step:]
        pair = np.where(reach, node * (n + 1) + then, -1)
        found = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        node = np.where(reach, found, 0)
        depth += step
    return np.where(place + width <= ends, node, -1)


def _trees(width: int):
    """Masks of the repeated windows of segments that come sorted by key."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        words, bounds = word_hashes([r[2].decode("utf-8", "surrogatepass") for r in rows], False)
        counts = np.array([r[3] for r in rows])
        node = refine(words, np.repeat(bounds[1:], np.diff(bounds)), width)
        owner = np.repeat(np.arange(len(rows)), np.diff(bounds))
        real = node >= 0
        leaves = np.bincount(node[real], counts[owner[real]])
        again = np.zeros(len(node), bool)
        again[real] = leaves[node[real]] > 1
        place = np.arange(len(node)) - bounds[:-1][owner]
        masks = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(masks, owner[again], np.int64(1) << place[again])
        hit = np.nonzero(masks)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in hit], pa.binary()), pa.array(masks[hit])],
            ["digest", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, key = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= TASK_WORDS and row[0] != key:
                    yield solve(pending)
                    pending, size = [], 0
                key = row[0]
                pending.append(row)
                size += row[2].count(b" ") + 1
        if pending:
            yield solve(pending)

    return run


def _leaves(width: int):
    """One row per window of a segment: its digest and its bit in the segment's mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            digest, leaf, bit, n = [], [], [], []
            for _, d, text, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.split(b" ")
                for i in range(len(words) - width + 1):
                    digest.append(d)
                    leaf.append(xxh3_128_digest(b" ".join(words[i:i + width])))
                    bit.append(1 << i)
                    n.append(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(leaf, pa.binary()),
                 pa.array(bit, pa.int64()), pa.array(n, pa.int64())],
                ["digest", "leaf", "bit", "n"])

    return run


def find_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, version, runs): per document the repeated windows, as (first window, bit mask) pairs.

    `docs` has doc (bigint), version (a hash of the text, telling rows apart that share an id) and
    text. Rows without a repeated window are left out.
    """
    if not CORE <= width < CORE + 62:
        raise ValueError(f"a window must have {CORE} to {CORE + 61} words")
    small_batches(docs.sparkSession)
    found = materialize(_segments(docs, width), "segments", compression="zstd")
    copies = found.groupBy("key", "digest").agg(F.count("*").alias("n"))
    texts = found.select("key", "digest", "words").dropDuplicates(["key", "digest"])
    distinct = materialize(texts.join(copies, ["key", "digest"]).select(
        "key", "digest", "words", "n"), "distinct-segments", compression="zstd")
    sizes = distinct.groupBy("key").agg(F.count("*").alias("m"))
    large = materialize(sizes.where(F.col("m") > GROUP_SEGMENTS).select("key"), "large-groups")
    small = distinct.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    masks = small.mapInArrow(tidy(_trees(width)), "digest binary, mask bigint")
    leaves = distinct.join(large, "key", "left_semi").mapInArrow(
        tidy(_leaves(width)), "digest binary, leaf binary, bit bigint, n bigint")
    common = leaves.groupBy("leaf").agg(F.sum("n").alias("m")).where("m > 1").select("leaf")
    long_masks = leaves.join(common, "leaf").groupBy("digest").agg(F.bit_or("bit").alias("mask"))
    return (found.select("doc", "version", "first", "digest")
            .join(masks.unionByName(long_masks), "digest")
            .groupBy("doc", "version")
            .agg(F.collect_set(F.struct("first", "mask")).alias("runs")))


def covered(runs: list | None, n: int, width: int) -> np.ndarray:
    """Which of `n` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for run in runs or ():
        first, mask = run["first"], run["mask"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            edge[first + low] += 1
            edge[first + low + width] -= 1
            mask &= mask - 1
    return np.cumsum(edge)[:n] > 0


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
         ) -> tuple[DataFrame, DataFrame]:
    """`docs` with a last column of runs, as (rows with repeats, rows without, whose runs are null).

    Only rows with repeats are moved to meet them, while their keys may be broadcast.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("version"),
                       F.col(text).alias("text"))
    runs = materialize(find_repeats(rows, width), "repeats").select(
        F.col("doc").alias("_doc"), F.col("version").alias("_version"), "runs")
    keys = few(runs.select("_doc", "_version"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(key).cast("bigint").alias("_id"), F.xxhash64(text).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_version"))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    name = fresh("_runs", docs.columns)
    met = tagged.join(keys, same, "left_semi").join(runs, same).select(
        *columns, F.col("runs").alias(name))
    rest = tagged.join(keys, same, "left_anti").select(
        *columns, F.lit(None).cast(runs.schema["runs"].dataType).alias(name))
    return met, rest


def _apply(rows: DataFrame, text: str, width: int, fields: list[StructField], keep: list[str],
           result) -> DataFrame:
    """New columns from a row's words and which of them are covered."""
    def build():
        def work(values: list) -> list:
            out = []
            for v in values:
                words = (v["text"] or "").encode("utf-8", "surrogatepass").split()
                out.append(result(v["text"], words, covered(v["runs"], len(words), width)))
            return [list(c) for c in zip(*out)] or [[] for _ in fields]

        return work

    name = fresh("_packed", rows.columns)
    packed = rows.withColumn(name, F.struct(F.col(text).alias("text"), F.col(rows.columns[-1]).alias("runs")))
    return extend(packed, name, fields, build, keep)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text",
            width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row; null texts have no words."""
    def result(_, words, gone):
        left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
        return len(words), int(gone.sum()), hex_digest(b" ".join(left))

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()),
              StructField("kept_sha256", StringType())]
    some, none = mark(docs, key, text, width)
    return _apply(some, text, width, fields, [key], result).unionByName(
        _apply(none, text, width, fields, [key], result))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   width: int = WIDTH) -> DataFrame:
    """The rows of `docs` without the words of repeated windows, columns unchanged.

    A text that loses words becomes its other words, joined by blanks; the others, null and empty
    ones among them, stay as they are. All rows stay, also those that lose all words. Rows that
    are repeated lose theirs in every copy; windows are judged on the input.
    """
    def result(value, words, gone):
        return (b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode(
            "utf-8", "replace"),)

    some, none = mark(docs, key, text, width)
    rest = [c for c in docs.columns if c != text]
    changed = _apply(some, text, width, [StructField(text, StringType())], rest, result)
    return changed.select(*docs.columns).unionByName(none.select(*docs.columns))
