"""Operator 10: near-duplicate groups by SuperMinHash, banding, full verification, union-find.

Each shingle of a document places one value per round: in round i it takes the i-th place of its
own random permutation of the signature's slots, with a value between i and i + 1. A slot keeps
the least value, so once every slot is filled no later round can change the signature and the
rounds stop; a long text needs one or two. Documents with equal sets are one node. Nodes that
agree on all rows of a band share a bucket, and candidates of a bucket are confirmed on their full
sets. Confirmed links are joined by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import (
    PLACE,
    few,
    mix,
    small_batches,
    tidy,
    window_hashes,
    word_hashes,
)
from vigilog.llm.components import components
from vigilog.session import materialize

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 4


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words than `width`, but not none, has its whole sequence as one shingle.
    """
    words, bounds = word_hashes(texts, lower=True)
    shingles = window_hashes(words, width)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(shingles[a:b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(shingles: np.ndarray, slots: int) -> np.ndarray:
    """The signature: per slot the round in the high and a random fraction in the low 32 bits."""
    n = len(shingles)
    signature = np.full(slots, np.iinfo(np.int64).max)
    if not n:
        return signature
    order = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
    row = np.arange(n)
    for i in range(slots):
        r = mix(shingles + np.uint64(((i + 1) * PLACE) & 0xFFFFFFFFFFFFFFFF))
        other = i + ((r >> np.uint64(32)) % np.uint64(slots - i)).astype(np.int64)
        slot = order[row, other]
        order[row, other] = order[:, i]
        np.minimum.at(signature, slot, (i << 32) | (r & np.uint64(0xFFFFFFFF)).astype(np.int64))
        if signature.max() < (i + 1) << 32:
            break
    return signature


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int = BANDS,
               rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_id, bands): a digest of the full set and one hash per band."""
    small_batches(docs.sparkSession)
    weigh = np.array([pow(PLACE, i + 1, 1 << 64) for i in range(rows)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        tag = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, digest, buckets = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                digest.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = super_minhash(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                buckets.append(mix((sig * weigh).sum(1) ^ tag).astype(np.int64))
            flat = pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(offsets, flat)], ["id", "n_shingles", "set_id", "bands"])

    rows_ = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    return rows_.mapInArrow(tidy(run), "id bigint, n_shingles bigint, set_id binary, bands array<bigint>")


def _sets(docs: DataFrame, key: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the given ids, the full set as sorted 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "shingles"])

    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    return texts.join(few(ids), "id").mapInArrow(
        tidy(run), "id bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets share `percent` of their union at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask),
                                              batch.column(1).filter(mask)], ["a", "b"])

    hubs = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    left = hubs.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
            .mapInArrow(tidy(run), "a bigint, b bigint"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
           percent: int = PERCENT) -> DataFrame:
    """(doc id, n_shingles, component_id) of every row of `docs`.

    The component is the least id reachable over links of `percent` similarity; a document without
    words, or null, is linked with none. Rows with a null id have a null component. Rows that
    repeat an id count as that one document. Equal sets are one node, so copies are never
    paired. In a bucket each member is first compared with the least one, then with the one that has
    the fewest shingles of its own, the centre of most groups. Buckets that then still hold members
    of several components are open; all links between open nodes of different components are found
    by a prefix filter, so no candidate link is lost, whatever the number of a bucket's members, and
    pairs within a component are never made.
    """
    signed = materialize(signatures(docs, key, text, width), "signatures")
    nodes = materialize(
        signed.where("set_id IS NOT NULL AND id IS NOT NULL").groupBy("set_id")
        .agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    spread = nodes.select(F.explode("bands").alias("bucket"), "node").distinct()
    # Written first: a join of two plain shuffles can split a bucket that very many nodes share.
    shared = materialize(
        spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n"))
        .where("n > 1"), "shared-buckets")
    members = materialize(spread.join(shared, "bucket"), "buckets")
    sets = materialize(_sets(docs, key, text, width, members.select(
        F.col("node").alias("id")).distinct()), "shingle-sets")
    pairs = members.where("node <> hub").select(
        F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(pairs, sets, percent), "links")
    roots = components(links)
    left = _open(members.select("bucket", "node"), roots)
    if not left.isEmpty():
        ranked = materialize(_by_rarity(sets, left), "ranked-shingles")
        new = materialize(confirmed(_centre_pairs(left, ranked, percent), sets, percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)
            left = _open(left.select("bucket", "node"), roots)
        if not left.isEmpty():
            new = materialize(confirmed(_prefix_pairs(left, ranked, percent), sets, percent), "links")
            if not new.isEmpty():
                roots = components(links.unionByName(new))
    least = nodes.select("set_id", "node").join(roots, "node", "left").select(
        "set_id", F.coalesce("root", "node").alias("component"))
    return signed.join(least, "set_id", "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
        .alias("component_id"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root) of the members of buckets that hold several components."""
    placed = members.join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"))
    several = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
               .where("lo < hi").select("bucket"))
    return materialize(placed.join(several, "bucket", "left_semi"), "open-buckets")


def _by_rarity(sets: DataFrame, left: DataFrame) -> DataFrame:
    """(node, size, own, tokens) of the open nodes: the shingles in the order of how many open nodes
    have them, and how many no other has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                 pa.array(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64))],
                ["node", "shingle"])

    nodes = left.select(F.col("node").alias("id")).distinct()
    some = sets.join(few(nodes), "id", "left_semi").dropDuplicates(["id"])
    tokens = materialize(some.mapInArrow(tidy(run), "node bigint, shingle bigint"), "open-shingles")
    held = tokens.groupBy("shingle").agg(F.count("*").alias("n"))
    return (tokens.join(held, "shingle").groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("t"))
            .select("node", F.size("t").alias("size"),
                    F.size(F.filter("t", lambda x: x["n"] == 1)).alias("own"),
                    F.transform("t", lambda x: x["shingle"]).alias("tokens")))


def _shared(x: F.Column, y: F.Column, percent: int) -> F.Column:
    """The fewest shingles that sets of these sizes must share to be linked."""
    return F.ceil(percent * (x + y) / (100 + percent))


def _centre_pairs(left: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Each open bucket's member with the fewest shingles of its own, against its other components.

    If x and y share s shingles, s <= size(x) - own(x), and size(y) >= s + own(y), so with p percent
    p * own(y) <= 100 * (size(x) - own(x)) - p * size(x): `room` is the most that own(y) may be, and
    pairs beyond it are not made.
    """
    facts = ranked.select("node", "own", F.expr(
        f"(100 * (size - own) - {percent} * size) / {percent}").alias("room"))
    known = left.join(facts, "node")
    hubs = known.groupBy("bucket").agg(F.min(F.struct("own", "node", "root", "room")).alias("h")).select(
        "bucket", "h.*")
    rows = known.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"),
                        F.col("own").alias("ob"), F.col("room").alias("fb"))
    possible = (F.col("root") != F.col("rb")) & (F.col("own") <= F.col("fb")) & (F.col("ob") <= F.col("room"))
    return hubs.join(rows, "bucket").where(possible).select(
        F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _prefix_pairs(left: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """All pairs of open nodes of different components that can be linked, by a prefix filter.

    Linked sets share a number of shingles that follows from their sizes, so the rarest one they
    share stands, in either order by rarity, no later than that number from the end. Nodes meet by
    such a shingle and by the class of the smaller one's size (steps of five percent), which bounds
    how far into its order the larger one has to look: sets with many rare shingles meet nobody.
    """
    root = left.select("node", "root").distinct()
    step = F.log(F.lit(1.05))
    size_class = lambda n: F.floor(F.log(n) / step)
    c = F.col
    rows = ranked.join(root, "node").select("node", "root", "size", "tokens")
    places = c("size") - _shared(c("size"), c("size"), percent) + 1
    small = rows.select(
        c("node").alias("a"), c("root").alias("ra"), c("size").alias("na"), size_class(c("size")).alias("cls"),
        F.posexplode(F.slice("tokens", F.lit(1), places.cast("int"))).alias("ia", "shingle"))
    least = F.ceil(percent * c("size") / 100)
    classes = rows.withColumn("cls", F.explode(F.sequence(size_class(F.greatest(least, F.lit(1))), size_class(c("size")))))
    # The least size in the class that can be linked with this one, a little less for rounding.
    lowest = F.greatest(least, F.floor(F.pow(F.lit(1.05), "cls") * 0.999))
    far = F.least(c("size"), c("size") - _shared(lowest, c("size"), percent) + 1)
    large = classes.where(far > 0).select(
        c("node").alias("b"), c("root").alias("rb"), c("size").alias("nb"), "cls",
        F.posexplode(F.slice("tokens", F.lit(1), far.cast("int"))).alias("ib", "shingle"))
    need = _shared(c("na"), c("nb"), percent)
    meet = ((c("ra") != c("rb")) & ((c("na") < c("nb")) | (c("na") == c("nb")) & (c("a") < c("b")))
            & (100 * c("na") >= percent * c("nb")) & (c("ia") + need <= c("na")) & (c("ib") + need <= c("nb")))
    return small.join(large, ["shingle", "cls"]).where(meet).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
               percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the least id stays.

    Columns stay as they are. Rows with a null id and texts without words all stay.
    """
    found = groups(docs, key, text, width, percent)
    out = materialize(found.where(F.col(key) != F.col("component_id")).select(key).distinct(),
                      "copies")
    return docs.join(few(out), key, "left_anti").select(*docs.columns)
