"""Text files by byte ranges: a table of ranges is planned once, and one reader follows it.

A range owns the lines whose first byte lies in it and reads on to the end of its last line, so
ranges can start anywhere. Lines end with a line feed, a carriage return, or both. The planned
table, not Spark's file planning, says what a range is: two passes over it see the same lines
whatever the session's settings are when they run.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.schema import RAW_LINES
from vigilog.session import materialize

#: Bytes of a range, and of what a task reads at once.
RANGE_BYTES = 128 << 20
STEP_BYTES = 4 << 20
#: Tasks of one pass; a task follows several ranges where there are more.
MOST_TASKS = 20_000
#: Files with these endings are read from their start by one task, unpacked on the way.
PACKED = (".gz", ".bz2", ".zst")
_LF, _CR = 10, 13
_PLAN = "source STRING, start BIGINT, stop BIGINT, size BIGINT"


def open_input(uri: str, start: int = 0) -> BinaryIO:
    """The bytes of a file from `start` on; local files and stores that pyarrow reaches."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        path = unquote(uri.removeprefix("file://").removeprefix("file:")) if uri.startswith("file:") else uri
        files: fs.FileSystem = fs.LocalFileSystem()
    else:
        files, path = fs.FileSystem.from_uri(uri)
    if path.endswith(PACKED):
        return files.open_input_stream(path, compression="detect")
    found = files.open_input_file(path)
    found.seek(start)
    return found


def lines_of_range(uri: str, start: int, stop: int, size: int) -> Iterator[list[bytes]]:
    """The lines whose first byte lies in [start, stop), in order, some at a time.

    `size` is where the file counts as ended: its last line may lack an end there.
    """
    before = _LF
    with open_input(uri, max(start - 1, 0)) as f:
        if start > 0:
            before = f.read(1)[0]
        at, held = start, None
        while at < size:
            part = f.read(min(STEP_BYTES, size - at))
            if not part:
                break
            data = np.frombuffer(part, np.uint8)
            last = np.concatenate([np.array([before], np.uint8), data[:-1]])
            begins = np.flatnonzero((last == _LF) | (last == _CR) & (data != _LF))
            mine = begins[:np.searchsorted(begins, stop - at)]
            done = len(mine) < len(begins)              # a line of the next range begins here
            ends = begins[1:len(mine) + done] if len(mine) else mine
            out = []
            if held is not None:
                held.append(part[:begins[0]] if len(begins) else part)
                if len(begins):
                    out.append(_bare(b"".join(held)))
                    held = None
            out += [_bare(part[a:b]) for a, b in zip(mine.tolist(), ends.tolist())]
            if len(mine) > len(ends):
                held = [part[mine[-1]:]]
            if out:
                yield out
            if done or held is None and at >= stop:
                return
            before, at = data[-1], at + len(part)
        if held is not None:
            yield [_bare(b"".join(held))]


def _bare(line: bytes) -> bytes:
    """A line without its end."""
    if line.endswith(b"\n"):
        line = line[:-1]
        return line[:-1] if line.endswith(b"\r") else line
    return line[:-1] if line.endswith(b"\r") else line


def plan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source, start, stop, size) of all ranges of the files under `path`; no file is opened."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("length").alias("size")).where("size > 0")
    whole = F.lit(False)
    for ending in PACKED:
        whole = whole | F.col("source").endswith(ending)
    endless = F.lit((1 << 62) - 1)
    cut = files.withColumn("start", F.explode(F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint")))))
    return cut.select("source", "start", F.when(whole, endless).otherwise(
        F.least(F.col("start") + range_bytes, "size")).alias("stop"),
        F.when(whole, endless).otherwise(F.col("size")).alias("size"))


def _each_range(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _each_range(batches):
        n = sum(map(len, lines_of_range(r["source"], r["start"], r["stop"], r["size"])))
        yield pa.RecordBatch.from_pylist([r | {"lines": n}])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _each_range(batches):
        number, expected = r["first"], r["first"] + r["lines"]
        for lines in lines_of_range(r["source"], r["start"], r["stop"], r["size"]):
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["source"]]).take(pa.array(np.zeros(n, np.int64))),
                 pa.array(np.arange(number + 1, number + n + 1)), pa.array(lines, pa.binary())],
                names=["source", "line_number", "value"])
            number += n
        if number != expected:
            raise OSError(f"{r['source']} changed: {number - r['first']} lines from byte {r['start']} on, "
                          f"{r['lines']} when they were counted")


def start_of_tail(uri: str, size: int, n: int) -> int:
    """The byte at which the last `n` lines of a file begin, found from its end backwards."""
    stop, wanted = size, n
    while stop > 0 and wanted > 0:
        start = max(0, stop - STEP_BYTES)
        with open_input(uri, max(start - 1, 0)) as f:
            before = f.read(1)[0] if start else _LF
            data = np.frombuffer(f.read(stop - start), np.uint8)
        last = np.concatenate([np.array([before], np.uint8), data[:-1]])
        begins = np.flatnonzero((last == _LF) | (last == _CR) & (data != _LF))
        if len(begins) >= wanted:
            return start + int(begins[-wanted])
        stop, wanted = start, wanted - len(begins)
    return 0 if wanted > 0 else size


def _tails(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each_range(batches):
            last: deque = deque(maxlen=n)
            start = 0 if r["source"].endswith(PACKED) else start_of_tail(r["source"], r["size"], n)
            for lines in lines_of_range(r["source"], start, r["size"], r["size"]):
                last.extend(lines)
            back = np.arange(len(last), 0, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["source"]] * len(last), pa.string()), pa.array(back, pa.int64()),
                 pa.array(list(last), pa.binary())], names=["source", "from_end", "value"])

    return run


def read_tails(ranges: DataFrame, n: int) -> DataFrame:
    """The last `n` lines of every planned file, `from_end` counting down to 1; only their bytes are read
    (packed files are read through)."""
    read = spread(ranges.where("start = 0")).mapInArrow(_tails(n), "source STRING, from_end BIGINT, value BINARY")
    return read.withColumn("value", F.make_valid_utf8(F.col("value").cast("string")))


def number_ranges(ranges: DataFrame) -> DataFrame:
    """Adds `lines` and `first`, the lines before a range; one pass over the bytes, written once."""
    pinned = materialize(ranges, "planned-ranges")
    counted = materialize(spread(pinned).mapInArrow(_count, _PLAN + ", lines BIGINT"), "counted-ranges")
    earlier = F.sum("lines").over(Window.partitionBy("source").orderBy("start")
                                  .rowsBetween(Window.unboundedPreceding, -1))
    return materialize(counted.withColumn("first", F.coalesce(earlier, F.lit(0))), "ranges")


def spread(ranges: DataFrame) -> DataFrame:
    """The ranges dealt to tasks in turn: the rows are small, what they stand for isn't."""
    return ranges.repartition(min(MOST_TASKS, max(1, ranges.count())))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The lines of numbered ranges as (source, line_number, value).

    A range that has other lines than it had when it was counted is an error: no line goes missing.
    """
    read = spread(ranges).mapInArrow(_read, "source STRING, line_number BIGINT, value BINARY")
    return read.withColumn("value", F.make_valid_utf8(F.col("value").cast("string"))).to(RAW_LINES)
