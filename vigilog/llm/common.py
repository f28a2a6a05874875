"""What the operators share: table access, Arrow passes over a text column, digests."""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes that the corpus contracts count as white space: blank and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS = 2048
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(keys: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """The keys, to be broadcast if they are few (8 or 16 MB), else to be joined by shuffling."""
    return F.broadcast(keys) if keys.limit(bound + 1).count() <= bound else keys


_MOST = contextvars.ContextVar("most_batch_bytes", default=None)


@contextlib.contextmanager
def batches_of_at_most(most: int) -> Iterator[None]:
    """Inside, no operator asks for batches of more than `most` bytes."""
    before = _MOST.set(most)
    try:
        yield
    finally:
        _MOST.reset(before)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds: texts are long, so few rows make a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    most = min(most, _MOST.get() or most)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


class Recent:
    """A bounded table of recent entries: two halves, the older of which goes when full."""

    def __init__(self, entries: int, longest_key: int = 64):
        self.half, self.longest_key = entries // 2, longest_key
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def many(self, keys: list, make: Callable) -> list:
        """The entries of all keys; `make` looks up or makes those that are not among the newest."""
        found = list(map(self.new.get, keys))
        return [make(k) if f is None else f for k, f in zip(keys, found)] if None in found else found

    def put(self, key, value) -> None:
        if len(key) <= self.longest_key:
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            self.new[key] = value


def cut_at_blanks(texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces between the blanks of a batch of texts, all pieces by their number among
    those, and where each text's pieces begin. A null text counts as empty; each text has a piece."""
    plain = pa.array(["" if t is None else t for t in texts], pa.large_string())
    split = pc.split_pattern(plain, " ")
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.asarray(split.offsets)


def lists_of(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists with the numbers `codes`, one after another, and where each begins; list i is
    `values` from `bounds[i]` to `bounds[i + 1]`."""
    lists = pa.LargeListArray.from_arrays(bounds, pa.array(values))
    flat = lists.take(pa.array(codes)).flatten()
    return np.asarray(flat), np.concatenate([[0], np.cumsum(np.diff(bounds)[codes])])


def ids_of_pieces(texts: list, lookup: Callable[[str], bytes],
                  known: Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts, one after another, and where each text's ids begin.

    Texts are cut at blanks. Each distinct piece of the batch is looked up once (ids as
    little-endian unsigned 32-bit). `known` is where `lookup` keeps what it found.
    """
    distinct, codes, bounds = cut_at_blanks(texts)
    pieces = distinct.to_numpy(zero_copy_only=False).tolist()
    found = [lookup(p) for p in pieces] if known is None else known.many(pieces, lookup)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat, upto = lists_of(np.frombuffer(b"".join(found), "<u4"),
                          np.concatenate([[0], np.cumsum(sizes)]), codes)
    return flat, upto[bounds]


def word_hashes(texts: list, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, and where each text's words begin.

    Words are the stretches between blanks, tabs and line ends; `lower` maps A-Z to a-z first.
    Each distinct word of the batch is hashed once.
    """
    from xxhash import xxh3_64_intdigest

    plain = pa.array(["" if t is None else t for t in texts], pa.large_string())
    plain = pc.replace_substring_regex(plain, r"[\t\n\v\f\r ]+", " ")
    split = pc.split_pattern(pc.ascii_lower(plain) if lower else plain, " ")
    coded = split.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))
    solid = np.fromiter(map(bool, distinct), bool, len(distinct))[codes]
    before = np.concatenate([[0], np.cumsum(solid)])
    return hashes[codes][solid], before[np.asarray(split.offsets)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier; its powers weigh the words of a window by place.
PLACE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on (len(words) - width + 1 of them)."""
    n = len(words) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        total += words[i:i + len(total)] * np.uint64(pow(PLACE, i + 1, 1 << 64))
    return mix(total)


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and idle ones add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What `make` returns, kept in this process for its next tasks until `let_go`; one thing at most."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
        give_back()                                         # making it takes more than it holds
    return _KEPT[key]


def let_go() -> None:
    """Drop what is kept: passes without a use for it begin so, as workers go from one stage to the next."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that begins without what other passes kept and gives its memory
    back when it ends."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def extend(df: DataFrame, column: str, fields: list[StructField],
           build: Callable[[], Callable[[list], list]], keep: list[str] | None = None,
           batch_bytes: int = BATCH_BYTES, uses_kept: bool = False) -> DataFrame:
    """Columns computed from one column, batch by batch, beside the columns in `keep`.

    `build` runs once per task and returns the function that maps a batch's values to one
    list per new field; `uses_kept` tells that it asks for what the worker has `kept`. A kept column
    with the name of a new one gives way to it.
    """
    small_batches(df.sparkSession, batch_bytes)
    new = {f.name for f in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c not in new]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    names = stay + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not uses_kept:
            let_go()
        work = build()
        try:
            for batch in batches:
                values = batch.column(len(stay)).to_pylist()
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=t)
                        for v, t in zip(work(values), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:len(stay)] + made, names=names)
        finally:
            work = batch = values = made = None             # noqa: F841
            give_back()

    source = df.select(*[F.col(f"`{c}`") for c in stay], F.col(column).alias("_input"))
    schema = StructType(source.schema.fields[:-1] + fields)
    return source.mapInArrow(run, schema)
