"""Operator 9: benchmark decontamination with a generalised suffix automaton.

All test items of a block are read into one automaton over words. A document's words are streamed
through it; after each word the state and the matched length tell the longest stretch, ending
there, that occurs in an item. A match of `window` words or more means a window of an item ends
here; items shorter than that count when they are matched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from vigilog.llm.common import small_batches, tidy, utf8
from vigilog.session import materialize

WINDOW = 10
#: Words of items per automaton: bounds the broadcast and the worker's tables. More words make
#: more blocks, and all documents go through each of them.
BLOCK_WORDS = 200_000
#: Words of an item per piece; pieces overlap by a window less one word, so none is lost.
PIECE_WORDS = 5_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else
                 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
                 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and all characters beyond ASCII."""
    return utf8(text).translate(_LETTERS).split()


class ItemAutomaton:
    """Generalised suffix automaton of items given as (item id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words])
                 for i, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: Items that contain a state's `window`-word string; items that are a state's string.
        self.holders: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, codes in coded:
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    self.holders.setdefault(self._at_window(state), set()).add(item)
            if len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(codes), item))
        self.least = min([window, *(len(c) for _, c in coded)])
        #: Next state up the suffix links that is a short item.
        self.up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.link[state]
            self.up[state] = parent if parent in self.short else self.up[parent]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _at_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence, and the items that occur."""
        codes = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        hit, items = np.zeros(len(words), bool), set()
        edges = np.diff((codes >= 0).astype(np.int8), prepend=0, append=0)
        begins, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        for a, b in zip(begins.tolist(), ends.tolist()):
            if b - a >= self.least:
                self._stream(codes[a:b].tolist(), a, hit, items)
        return hit, items

    def _stream(self, codes: list[int], base: int, hit: np.ndarray, items: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for place, c in enumerate(codes, base + 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                hit[place - matched:place] = True
                items |= self.holders[self._at_window(state)]
            if self.short:
                at = state
                while at:
                    for n, item in self.short.get(at, ()):
                        if n <= matched:
                            hit[place - n:place] = True
                            items.add(item)
                    at = self.up[at]


def _pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, words) with long items cut into overlapping pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                            strict=True):
                words = words_of(t)
                step = PIECE_WORDS - window + 1
                for a in range(0, max(1, len(words) - window + 1), step):
                    ids.append(i)
                    pieces.append(words[a:a + PIECE_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.binary())),
                 pa.array([len(p) for p in pieces], pa.int64())], ["item_id", "words", "n"])

    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(tidy(run), "item_id string, words array<binary>, n bigint")


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, hit (a byte per word, 1 inside an occurrence of an item's window) and
    item_ids (array of the items with an occurring window, as strings) to every row.

    Null and empty texts have no words and no hits; null or wordless items never occur; repeated
    items are one window set each under their own id, a null id is dropped from item_ids; columns
    of `docs` with the new names give way. Documents are never shuffled: each block of at most
    BLOCK_WORDS item words is broadcast, and all rows pass through it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = _pieces(items, item_id, item_text, window).where("n > 0")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_WORDS) or 1
    if blocks > 1:
        pieces = materialize(pieces.withColumn(
            "block", F.expr(f"pmod(xxhash64(item_id, words), {2 * blocks})")), "test-items")
        blocks *= 2                     # half full on average, so none is far above the bound
    names = {"n_words", "hit", "item_ids"}
    kept = [c for c in docs.columns if c not in names]
    current = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("bigint").alias(
        "n_words"), F.lit(None).cast("binary").alias("hit"),
        F.array().cast("array<string>").alias("item_ids"))
    for block in range(blocks):
        part = pieces.where(F.col("block") == block) if blocks > 1 else pieces
        rows = [(r.item_id, [bytes(w) for w in r.words])
                for r in part.select("item_id", "words").collect()]
        current = _pass(current, rows, text, window)
        if blocks > 1:
            current = materialize(current, "decontamination")
    return current


def _pass(docs: DataFrame, rows: list, text: str, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    at = docs.columns.index(text)
    kept = len(docs.columns) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(sent.value, window)       # the task's own: nothing stays in the worker
        for batch in batches:
            n, hits, found = [], [], []
            for t, old, seen in zip(batch.column(at).to_pylist(),
                                    batch.column(kept + 1).to_pylist(),
                                    batch.column(kept + 2).to_pylist(), strict=True):
                words = words_of(t)
                hit, items = automaton.match(words)
                if old is not None:
                    hit |= np.frombuffer(old, bool)
                n.append(len(words))
                hits.append(hit.tobytes())
                found.append(sorted({*(seen or ()), *items} - {None}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(n, pa.int64()), pa.array(hits, pa.binary()),
                 pa.array(found, pa.list_(pa.string()))], names=batch.schema.names)

    schema = StructType(docs.schema.fields[:kept] + [
        StructField("n_words", LongType()), StructField("hit", BinaryType()),
        StructField("item_ids", ArrayType(StringType()))])
    return docs.mapInArrow(tidy(run), schema)


def hit_count(hit: str = "hit") -> F.Column:
    """Number of hit words: the set bytes of the mask."""
    return F.length(F.replace(F.hex(hit), F.lit("00"), F.lit(""))) / 2


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text",
                 max_coverage: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` without what they share with the items; all columns but the text, whatever
    their names, come back unchanged.

    Every stretch of hit words goes, with what stands between its words. A document loses all its
    text to the limit `max_coverage`: if more than that part of its words is hit, it is dropped.
    Documents without a hit come back as they are.
    """
    # The rows travel in one struct, so that none of their names can clash with the marks'.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(f"`{text}`").alias("text"))
    marked = find_hits(packed, items, **options)
    share = hit_count() / F.greatest(F.col("n_words"), F.lit(1))
    left = marked.where(share <= max_coverage).select("row", "text", "hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, np.frombuffer(h, bool)) for t, h in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["row", "text"])

    done = left.mapInArrow(tidy(run), packed.schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])


def cut(text: str | None, hit: np.ndarray) -> str | None:
    if text is None or not hit.any():
        return text
    out, at, run = [], 0, False
    for word, bad in zip(_WORD.finditer(text), hit.tolist(), strict=True):
        if bad and not run:
            out.append(text[at:word.start()])
        if bad:
            at = word.end()
        run = bad
    return "".join(out) + text[at:]
