"""Operator 11: alignment of two tokenizers' ids over the same texts, by whitespace anchors.

Both tokenizers encode the whole text. Where the bytes of both sides are the same, an end that
both sides share before two space-marked tokens is an anchor. Anchors cut a document into windows
of token ids, mostly one word long; the alignment of a window depends on its ids alone, so it is
made once per pair of id tuples and kept in a bounded memo. Inside a window, tokens of both sides
are cut into groups wherever they end together, and the tokens that end there are linked.

Counts of linked id pairs are taken over the whole corpus. The pairs counted most often, at most
`HOT_PAIRS`, are broadcast to the links of every document; links of rarer pairs are joined by
shuffling, so no key holds many rows. A document's links travel as distinct pairs with counts.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from vigilog.llm.bpe import PRE_SPLIT, SETTLED, byte_letters, joined
from vigilog.llm.common import extend, utf8
from vigilog.session import materialize

#: Bytes of window alignments that a task keeps before the older half goes.
MEMO_BYTES = 48 << 20
#: Pairs of ids that may be broadcast (about 50 MB as a join table).
HOT_PAIRS = 500_000
#: Longer windows are hardly seen again; they aren't kept.
LONGEST_KEY = 64
#: Characters of text that are aligned at once.
SLICE = 1 << 20


class Memo:
    """Entries by key, bounded by the bytes of both; the older half goes when it is full."""

    def __init__(self, limit: int):
        self.half, self.used = limit // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key: bytes):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: tuple) -> None:
        # Three objects of bytes, a number and a tuple have about 300 bytes beside their content.
        size = 300 + len(key) + len(value[0]) + len(value[1])
        if self.used + size > self.half:
            self.old, self.new, self.used = self.new, {}, 0
        self.new[key] = value
        self.used += size


class Side:
    """Ids of whole texts by one tokenizer, and the bytes that each id stands for."""

    def __init__(self, labels: list[bytes], encode):
        self.encode = encode
        self.label = pa.array(labels, pa.large_binary())
        self.size = np.array([len(x) for x in labels], np.int64)
        self.marked = np.array([x[:1] == b" " for x in labels], bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids begin and end."""
        parts = [np.array(ids, np.int32) for ids in self.encode(texts)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def byte_level(path: str) -> Side:
    """A byte-level vocabulary file; it gets the text behind a space, special tokens as plain text.

    Where ids follow the merges' order and the text has settled characters only, the same
    vocabulary as ranks gives the same ids in a third of the time.
    """
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    byte_of = byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    raw = lambda token: bytes(byte_of[c] for c in token)
    vocabulary = spec["model"]["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    labels = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for token, i in vocabulary.items():
        labels[i] = utf8(token) if token in special else raw(token)
    for token, i in special.items():
        labels[i] = utf8(token)
    ranks = tiktoken.Encoding("ranks", pat_str=PRE_SPLIT.pattern, special_tokens={}, mergeable_ranks={
        raw(x): i for x, i in vocabulary.items() if x not in special}) if merged == sorted(merged) else None

    def encode(texts: list[str]) -> list[list[int]]:
        settled = [ranks is not None and (not x or max(x) < SETTLED) for x in texts]
        rest = iter(t.encode_batch_fast([" " + x for x, s in zip(texts, settled) if not s],
                                        add_special_tokens=False))
        return [ranks.encode_ordinary(" " + x) if s else next(rest).ids for x, s in zip(texts, settled)]

    return Side(labels, encode)


def sentence_pieces(path: str) -> Side:
    """A sentencepiece model with byte pieces; it adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    labels = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        labels.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                      else utf8(piece.replace("▁", " ")))
    return Side(labels, lambda texts: model.encode(texts, num_threads=1))


class Aligner:
    """Aligns batches of whole texts; tables live as long as the task that made it."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.memo = a, b, Memo(MEMO_BYTES)
        self.rows = 0
        #: Decimal ids of both sides, each with its sign inside and at the end of its part.
        told = [[b"%d%c" % (i, sign) for i in range(len(side.label)) for sign in signs]
                for side, signs in ((a, b",|"), (b, b",;"))]
        self.told, self.told_b = pa.array(told[0] + told[1], pa.large_binary()), len(told[0])

    def _same_bytes(self, texts: list, a_ids, a_to, b_ids, b_to) -> np.ndarray:
        """Which texts both sides spell: a space and the text, and at least one byte of it."""
        spelt_a, spelt_b = joined(self.a.label, a_ids, a_to), joined(self.b.label, b_ids, b_to)
        return np.array([bool(t) and x == y == b" " + utf8(t) for t, x, y in zip(
            texts, spelt_a, spelt_b, strict=True)], bool)

    def _windows(self, a, a_to, b, b_to) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin in both flat id arrays, by shared ends before marked tokens."""
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])

        def before_marked(side: Side, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
            may = np.append(side.marked[ids[1:]], True)
            may[to[to > 0] - 1] = True           # and the ends of texts
            return may

        a_may, b_may = before_marked(self.a, a, a_to), before_marked(self.b, b, b_to)
        total = int(a_end[-1]) + 1
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[a_end[a_may]] = True
        in_b[b_end[b_may]] = True
        shared = in_a & in_b                 # verified: both sides end there
        a_cut = np.flatnonzero(a_may & shared[a_end]) + 1
        b_cut = np.flatnonzero(b_may & shared[b_end]) + 1
        return np.concatenate([[0], a_cut]), np.concatenate([[0], b_cut])

    def _keys(self, a, a_cut, b, b_cut) -> pa.LargeBinaryArray:
        """Each window's id tuples as bytes: the number of left ids, left ids, right ids."""
        n_a, n_b = np.diff(a_cut), np.diff(b_cut)
        at = np.concatenate([[0], np.cumsum(1 + n_a + n_b)])
        out = np.empty(at[-1], "<i4")
        out[at[:-1]] = n_a
        out[np.arange(len(a)) + np.repeat(at[:-1] + 1 - a_cut[:-1], n_a)] = a
        out[np.arange(len(b)) + np.repeat(at[:-1] + 1 + n_a - b_cut[:-1], n_b)] = b
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(n_a), [None, pa.py_buffer((at * 4).astype(np.int64)),
                                          pa.py_buffer(out)])

    def _aligned(self, keys: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """Of each window its groups as `a1,a2|b1;` each, its links as packed id pairs, their number.

        Windows that the memo doesn't have are aligned together.
        """
        found = [self.memo.get(k) for k in keys]
        new = [i for i, f in enumerate(found) if f is None]
        for i, made in zip(new, self._align_windows([keys[i] for i in new]), strict=True):
            found[i] = made
            if len(keys[i]) <= LONGEST_KEY:
                self.memo.put(keys[i], made)
        return found

    def _align_windows(self, keys: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        if not keys:
            return []
        flat = np.frombuffer(b"".join(keys), "<i4").astype(np.int64)
        start = np.concatenate([[0], np.cumsum([len(k) // 4 for k in keys])])
        n_a = flat[start[:-1]]
        n_b = np.diff(start) - 1 - n_a
        spread = lambda first, n: np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = flat[spread(start[:-1] + 1, n_a)], flat[spread(start[:-1] + 1 + n_a, n_b)]
        # The windows end to end: both sides have the same bytes in each, so ends stay comparable.
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        marks = np.zeros((2, a_end[-1] + 1), bool)
        marks[0, a_end], marks[1, b_end] = True, True
        shared = marks[0] & marks[1]
        a_last, b_last = shared[a_end], shared[b_end]           # last tokens of groups
        # Each group's left ids, then its right ids.
        group = np.concatenate([np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last])
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        told = np.concatenate([2 * a + a_last, self.told_b + 2 * b + b_last])[order]
        texts = joined(self.told, told, np.concatenate([[0], np.cumsum(n_a + n_b)]))
        raw = memoryview((a[a_last] << 32 | b[b_last]).astype("<i8").tobytes())
        ends = np.concatenate([[0], np.cumsum(a_last)])[np.concatenate([[0], np.cumsum(n_a)])].tolist()
        return [(t, bytes(raw[8 * p:8 * q]), q - p) for t, p, q in zip(texts, ends, ends[1:])]

    def __call__(self, texts: list) -> list:
        """Columns of a batch: row number, n_a, n_b, n_groups, n_links, digest, pairs."""
        parts, first, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= SLICE or i + 1 == len(texts):
                parts.append(self._columns(texts[first:i + 1]))
                first, held = i + 1, 0
        return [pa.concat_arrays([pa.array(p) for p in column]) for column in zip(*parts)] or [[]] * 7

    def _columns(self, texts: list) -> list:
        here = TaskContext.get()
        base = (here.partitionId() if here else 0) << 40
        number = base + self.rows + np.arange(len(texts))
        self.rows += len(texts)
        plain = ["" if t is None else t for t in texts]
        a_ids, a_to = self.a.ids(plain)
        b_ids, b_to = self.b.ids(plain)
        good = self._same_bytes(plain, a_ids, a_to, b_ids, b_to)
        n_a, n_b = np.diff(a_to) * good, np.diff(b_to) * good
        a_ids = a_ids[np.repeat(good, np.diff(a_to))]
        b_ids = b_ids[np.repeat(good, np.diff(b_to))]
        a_to, b_to = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        if not good.any():
            none = np.zeros(len(texts), np.int64)
            return [number, n_a, n_b, none, none, [""] * len(texts),
                    _pairs(none[:0], none[:0], np.zeros(len(texts) + 1, np.int64))]
        a_cut, b_cut = self._windows(a_ids, a_to, b_ids, b_to)
        coded = self._keys(a_ids, a_cut, b_ids, b_cut).dictionary_encode()
        codes = np.asarray(coded.indices)
        found = self._aligned(coded.dictionary.to_pylist())
        of_text = np.searchsorted(a_cut, a_to)              # windows before each text
        upto = np.concatenate([[0], np.cumsum(np.array([f[2] for f in found], np.int64)[codes])])
        n_groups = np.diff(upto[of_text])
        told = joined(pa.array([f[0] for f in found], pa.large_binary()), codes, of_text)
        digest = [hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in told]
        links = np.concatenate([np.frombuffer(f[1], "<i8") for f in found])
        ends = np.cumsum([0] + [f[2] for f in found])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(links))
        pairs = np.asarray(lists.take(pa.array(codes)).flatten())
        return [number, n_a, n_b, n_groups, n_groups, digest,
                _counted(pairs, np.repeat(np.arange(len(texts)), n_groups), len(texts))]


_PAIR = StructType([StructField("a", IntegerType(), False), StructField("b", IntegerType(), False),
                    StructField("n", IntegerType(), False)])


def _pairs(pairs: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    items = pa.StructArray.from_arrays(
        [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
         pa.array(n.astype(np.int32))],
        fields=[pa.field(x, pa.int32(), nullable=False) for x in ("a", "b", "n")])
    kind = pa.list_(pa.field("element", items.type, nullable=False))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items, type=kind)


def _counted(pairs: np.ndarray, text: np.ndarray, texts: int) -> pa.ListArray:
    """Each text's distinct pairs with their counts."""
    distinct, code = np.unique(pairs, return_inverse=True)
    both, n = np.unique(text * len(distinct) + code, return_counts=True)
    bounds = np.searchsorted(both, np.arange(texts + 1) * len(distinct))
    return _pairs(distinct[both % len(distinct)], n, bounds)


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Token counts, groups and links of each text under a byte-level and a piece tokenizer.

    Adds n_a, n_b, n_groups, n_links, n_best (links whose pair is linked most often for its right
    id over all texts, ties included), count_sum (of the pairs' counts over the links) and
    groups_sha256 to the columns in `keep`; a kept column of such a name gives way. Null and empty
    texts, and texts that the tokenizers don't spell byte for byte, have zeros and an empty digest.
    Texts are taken whole, however long; every row stands for itself, repeated ones too, and its
    links count. An empty table gives an empty table. Both paths are files present on every node.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    # The caller's columns travel in one struct, so that their names can't clash with others.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("row"),
                     F.col(text).alias("text"))
    long = lambda name: StructField(name, LongType())
    stored = materialize(extend(
        rows, "text", [long("number"), long("n_a"), long("n_b"), long("n_groups"), long("n_links"),
                       StructField("groups_sha256", StringType()),
                       StructField("pairs", ArrayType(_PAIR, False))],
        lambda: Aligner(byte_level(a_path), sentence_pieces(b_path)), keep=["row"]),
        "aligned", "zstd")
    links = stored.select("number", F.inline("pairs"))
    found = _sums(links, _pair_counts(links))
    return stored.join(found, "number", "left").select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")


def _pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each pair over all texts, and whether its b has no more."""
    counts = materialize(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(counts.join(most, "b").select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _sums(links: DataFrame, counts: DataFrame, bound: int = HOT_PAIRS) -> DataFrame:
    """(number, n_best, count_sum) of every row with links.

    The pairs from the least power of two on that at most `bound` pairs reach are broadcast.
    The rest has small counts, so a shuffle by pair deals it evenly.
    """
    level = F.floor(F.log2("count")).cast("int")
    sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n")).collect()}             # one row per power of two
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= bound:
        least -= 1
        held += sizes.get(least, 0)

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("number").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    hot = F.broadcast(counts.where(level >= least))
    sums = summed(links.join(hot, ["a", "b"]))
    if least > 0:
        rare = links.join(F.broadcast(counts.where(level >= least).select("a", "b")), ["a", "b"],
                          "left_anti")
        sums = sums.unionByName(summed(rare.join(counts.where(level < least), ["a", "b"])))
        sums = sums.groupBy("number").agg(F.sum("n_best").alias("n_best"),
                                          F.sum("count_sum").alias("count_sum"))
    return sums
