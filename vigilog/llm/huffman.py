"""Operator 8: token ids in a compact file format with canonical Huffman codes.

Ids are counted over the whole corpus; lengths come from the package-merge rule, so no code is
longer than a table index, and codes are numbered by (length, id), so the lengths alone restore
them. Every partition of the ordered documents is written as independent blocks: a block holds
whole documents, their bits, and the bit offset of every 128th id of a document, from which a
decoder can start. Decoding reads the next `max_bits` bits as an index into one table, in many places of a
block at once.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.llm.common import Recent, ids_of_pieces, small_batches
from vigilog.session import materialize

BLOCK_IDS = 1 << 18
STRIDE = 128
MAX_BITS = 16
#: Larger batches than elsewhere: each distinct piece of a batch is looked up once.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4096
#: Most ids a vocabulary may have: bounds the counts and lengths sent to and from the driver.
MOST_IDS = 1 << 20

#: The word rule of this tokenizer family.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Pieces made of these characters alone are normalized by lower-casing each one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: A full stop or comma that follows another mark and so belongs to one word with it. Separators
#: from 1C to 1F are marks to the tokenizer, though white space in Python's patterns. The pattern
#: begins with its rarer part, as one that begins with a choice is tried at every character.
_MARKS = re.compile(r"[.,](?<=(?:[^\w\s]|[_\x1c-\x1f])[.,]) ")
#: Lower-case letters of Latin-1: such a piece is one word, as it stands.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once.

    The normalizer maps all white space to a blank and the words never hold any, so a text's
    ids are those of its blank-separated pieces in turn.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {chr(c): letters.pre_tokenize_str(chr(c))[0][0]
                        for c in range(0x21, 0x100) if _PLAIN.fullmatch(chr(c))}
        self.special = [str(t.content)
                        for t in self.whole.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.pieces = Recent(500_000)

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if _LETTERS.fullmatch(piece) and not self.marked.search(piece):
            return self._word(piece)
        if not _PLAIN.fullmatch(piece) or self.marked.search(piece):
            return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        piece = piece.lower()
        if piece.isalpha():
            return self._word(piece)
        return b"".join(map(self._word, _WORDS.findall(piece)))

    def _known(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._piece(piece)
            self.pieces.put(piece, ids)
        return ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and each text's bounds; null is empty."""
        return ids_of_pieces([t and _loosen(t) for t in texts], self._known, self.pieces)


def _loosen(text: str) -> str:
    """The text with the same ids but fewer distinct pieces: lower case, and a blank before a
    full stop or comma that stands alone, where characters have but one lower case form."""
    text = text.replace("\n", " ")
    if "<|" in text or not (text.isascii() or _is_latin(text)):
        return text
    text = text.lower()
    if _MARKS.search(text):
        return text
    return text.replace(". ", " . ").replace(", ", " , ")


def _is_latin(text: str) -> bool:
    """Whether no character lies beyond Latin-1; encoding tells it faster than a pattern does."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(df: DataFrame, path: str, end_id: int, text: str = "text",
             order: str = "doc_id") -> DataFrame:
    """(order_id, ids, n) of every row, with `end_id` after each document's ids, and one row per
    partition whose `counts` has how often each id occurred in it (the others null)."""
    small_batches(df.sparkSession, BATCH_BYTES, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        counts = np.zeros(max(t.size, end_id + 1), np.int64)
        width = np.dtype(id_type(len(counts)))
        names = ["order_id", "ids", "n", "counts"]
        for batch in batches:
            flat, bounds = t.encode_batch(batch.column(1).to_pylist())
            flat = np.insert(flat, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            counts += np.bincount(flat, minlength=len(counts))
            ids = pa.Array.from_buffers(
                pa.binary(), len(bounds) - 1,
                [None, pa.py_buffer((bounds * width.itemsize).astype(np.int32)),
                 pa.py_buffer(flat.astype(width).tobytes())])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), ids, pa.array(np.diff(bounds)),
                pa.nulls(len(bounds) - 1, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
            pa.array([counts.tobytes()], pa.binary())], names=names)

    rows = df.select(F.col(order).cast("bigint").alias("order_id"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, "order_id bigint, ids binary, n bigint, counts binary")


def id_type(size: int) -> str:
    """How ids are kept between passes: two bytes if the vocabulary allows."""
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id: partial counts are added on the executors, and what reaches
    the driver has one row per id of the vocabulary (checked against MOST_IDS)."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                more = np.frombuffer(raw, np.int64)
                if len(more) > len(total):
                    total = np.pad(total, (0, len(more) - len(total)))
                total[:len(more)] += more
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()),
                                          pa.array(total[used], pa.int64())], ["id", "n"])

    parts = (tokens.where("counts IS NOT NULL").select("counts")
             .mapInArrow(split, "id bigint, n bigint"))
    rows = parts.groupBy("id").agg(F.sum("n").alias("n")).limit(MOST_IDS + 1).toPandas()
    if len(rows) > MOST_IDS:
        raise ValueError("more distinct ids than MOST_IDS")
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits`, by package-merge; 0 for unused ids.

    Ties in the counts are broken by id. One used id gets one bit. A limit that can't hold
    all used ids is raised to one that can.
    """
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf_flags, level = [], weight
    for _ in range(limit):
        leaf_flags.append(np.ones(len(weight), bool) if level is weight else flags)
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")      # leaves come before packages of equal weight
        level, flags = both[rank], rank < len(weight)
    take = 2 * len(order) - 2
    depth = np.zeros(len(order), np.int64)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): each is the one before it plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code = previous = 0
    for i in sorted(np.nonzero(lengths)[0].tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - previous
        previous = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    """Tables of one code; made from the lengths alone."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.bits = int(lengths.max()) if len(lengths) else 1
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.used = np.zeros(1 << self.bits, np.int64)
        for i in np.nonzero(lengths)[0]:
            free = self.bits - int(lengths[i])
            first = int(self.codes[i]) << free
            self.symbol[first:first + (1 << free)] = i
            self.used[first:first + (1 << free)] = lengths[i]

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For each document its bits, first one highest and padded to a byte, and the bit
        offsets of every STRIDE-th id in it."""
        n = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        first = upto[bounds]                                   # in one run of bits
        sizes = (np.diff(first) + 31) >> 5                     # documents in whole words
        base = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(bounds)
        shift = np.repeat((base[:-1] << 5) - first[:-1], counts)
        starts = upto[:-1] + shift
        word, into = starts >> 5, starts & 31
        window = self.codes[ids] << (64 - into - n).astype(np.uint64)
        out = np.zeros(int(base[-1]) + 2, np.uint64)
        if len(ids):
            firsts = np.nonzero(np.diff(word, prepend=-1))[0]
            at = word[firsts]
            out[at] += np.add.reduceat(window >> np.uint64(32), firsts)
            out[at + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), firsts)
        data = out.astype(">u4").tobytes()
        bits, checkpoints = [], []
        relative = starts - np.repeat(base[:-1] << 5, counts)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            size = (int(first[i + 1] - first[i]) + 7) >> 3
            bits.append(data[4 * base[i]:4 * base[i] + size])
            checkpoints.append(relative[a:b:STRIDE].astype("<u4").tobytes())
        return bits, checkpoints

    def decode(self, data: bytes, lane_at: np.ndarray, lane_n: np.ndarray) -> np.ndarray:
        """All ids of a block; one lane per checkpoint, all lanes step together."""
        padded = data + bytes(-len(data) % 4 + 8)
        words = np.frombuffer(padded, ">u4").astype(np.uint64)
        order = np.argsort(-lane_n, kind="stable")
        at, left = lane_at[order].astype(np.int64), lane_n[order]
        out = np.zeros((len(at), int(left[0]) if len(left) else 0), np.uint32)
        shift, mask = 64 - self.bits, np.uint64((1 << self.bits) - 1)
        active = np.searchsorted(-left, -np.arange(1, out.shape[1] + 1), side="right")
        for k, m in enumerate(active.tolist()):
            at = at[:m]
            word = at >> 5
            pair = words[word] << np.uint64(32) | words[word + 1]
            index = (pair >> (shift - (at & 31)).astype(np.uint64)) & mask
            out[:m, k] = self.symbol[index]
            at = at + self.used[index]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return out[place][np.arange(out.shape[1]) < lane_n[:, None]]


def encode(tokens: DataFrame, lengths: np.ndarray, size: int) -> DataFrame:
    """Blocks of the documents of `tokens`, which lie in order in their shards: coded and packed in
    one pass, so that no bits leave the task before their block is full."""
    raw = tokens.sparkSession.sparkContext.broadcast(lengths.tobytes())  # a byte per id
    width = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(raw.value, np.uint8))
        for batch in batches:
            rows = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(rows), width)
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            bits, checkpoints = coder.encode(flat, bounds // np.dtype(width).itemsize)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(bits, pa.binary()),
                 pa.array(checkpoints, pa.binary()), batch.column(3)],
                ["order_id", "n", "bits", "checkpoints", "shard"])

    return tokens.select("order_id", "ids", "n", "shard").mapInArrow(
        lambda batches: _blocks(run(batches)), _BLOCK)


def in_shards(tokens: DataFrame, shards: int) -> DataFrame:
    """The documents of `tokens` in ascending shards, in order inside them, before they are coded: the
    range partitioner samples its input by running it a second time."""
    key = F.col("order_id").asc_nulls_first()
    return (tokens.where("ids IS NOT NULL").select("order_id", "ids", "n")
            .repartitionByRange(shards, key).sortWithinPartitions(key)
            .withColumn("shard", F.spark_partition_id()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the ordered documents of a shard into blocks; a document is never cut, so a block
    ends with the document that fills it."""
    pending: list[tuple] = []
    have = before = block = 0
    shard = None

    def emit() -> pa.RecordBatch:
        nonlocal pending, have, before, block
        bits = b"".join(p[2] for p in pending)
        at, lanes = 0, []
        for p in pending:
            lanes.append(np.frombuffer(p[3], "<u4").astype(np.int64) + 8 * at)
            at += len(p[2])
        out = pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([block], pa.int64()),
            pa.array([before], pa.int64()), pa.array([have], pa.int64()),
            pa.array([bits], pa.binary()),
            pa.array([np.concatenate(lanes).astype("<i8").tobytes()], pa.binary()),
            pa.array([[p[0] for p in pending]], pa.list_(pa.int64())),
            pa.array([[p[1] for p in pending]], pa.list_(pa.int64()))],
            ["shard", "block", "before", "n_ids", "bits", "checkpoints", "docs", "sizes"])
        pending, before, have, block = [], before + have, 0, block + 1
        return out

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            shard = row[4]
            pending.append(row)
            have += row[1]
            if have >= BLOCK_IDS:
                yield emit()
    if pending:
        yield emit()


_BLOCK = ("shard int, block bigint, before bigint, n_ids bigint, bits binary, checkpoints binary,"
          " docs array<bigint>, sizes array<bigint>")


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text",
          order: str = "doc_id", max_bits: int = MAX_BITS) -> None:
    """Writes the ids of every text, `end_id` after each, in ascending order of `order`.

    Files: `path`/blocks, one row per block (shard, block, ids of the shard before it, number
    of ids, bits, bit offsets of the checkpoints, document ids and their numbers of ids), and
    `path`/code, the code lengths. Shards ascend in the order. Null and empty texts hold the end
    id alone; rows without an order value come first; rows of equal order value are all kept, in
    no fixed order. The corpus is tokenized once, and its ids are shuffled once, then coded.
    """
    spark = df.sparkSession
    size = max(tokenizer(tokenizer_path).size, end_id + 1)
    tokens = materialize(tokenize(df, tokenizer_path, end_id, text, order), "tokens",
                         compression="zstd")
    lengths = code_lengths(id_counts(tokens), max_bits)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small_batches(spark)                                # ids make larger arrays than texts
    (encode(in_shards(tokens, shards), lengths, size)
     .write.mode("overwrite").parquet(f"{path}/blocks"))
    (spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/code"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files at `path`.

    `start` counts the ids of all documents before it; `ids` are little-endian unsigned 32-bit
    integers. Blocks are decoded where they are read; only one number per shard is gathered.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first().lengths)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for shard, before, bits, checkpoints, docs, sizes in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                n = np.array(sizes, np.int64)
                lanes = (n + STRIDE - 1) // STRIDE
                lane_n = np.full(int(lanes.sum()), STRIDE, np.int64)
                lane_n[np.cumsum(lanes) - 1] = n - (lanes - 1) * STRIDE
                ids = coder.decode(bits, np.frombuffer(checkpoints, "<i8"), lane_n)
                upto = np.concatenate([[0], np.cumsum(n)])
                for a in range(0, len(docs), 512):
                    b = min(a + 512, len(docs))
                    cut = upto[a:b + 1] - upto[a]
                    raw = ids[upto[a]:upto[b]].astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * (b - a), pa.int32()),
                        pa.array(docs[a:b], pa.int64()), pa.array(before + upto[a:b]),
                        pa.array(n[a:b]),
                        pa.Array.from_buffers(pa.binary(), b - a, [
                            None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(raw)])],
                        ["shard", "doc_id", "inside", "n_tokens", "ids"])

    rows = blocks.select("shard", "before", "bits", "checkpoints", "docs", "sizes").mapInArrow(
        run, "shard int, doc_id bigint, inside bigint, n_tokens bigint, ids binary")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # one row per shard
    earlier = F.sum("_n").over(Window.orderBy("shard")
                               .rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("_earlier") + F.col("inside")).alias("start"), "n_tokens", "ids")
