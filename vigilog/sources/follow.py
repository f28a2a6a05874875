"""Following growing log files from their end or their beginning, as a streaming source.

The offset of the stream is a number of bytes per file, always just behind a line end, so a line
that is still being written waits for the next micro-batch and none is cut. A file that is shorter
than its offset has been rotated and is read from its start; a file that appears later, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vigilog.sources.ranges import RANGE_BYTES, lines_of_range, open_input

FORMAT = "log_follow"
#: Bytes that the search for a file's last line end reads at once.
BACK_BYTES = 1 << 16


def last_line_end(uri: str, size: int) -> int:
    """The first byte behind the last line feed of a file's first `size` bytes."""
    stop = size
    while stop > 0:
        start = max(0, stop - BACK_BYTES)
        with open_input(uri, start) as f:
            found = f.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def files_of(path: str) -> dict[str, int]:
    """Size by name of a file, or of the files in a folder; hidden ones don't count."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        local = path.startswith("file:")
        store, inside = fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if local else path)
        prefix = "file://" if local else path.partition("://")[0] + "://"
    else:
        store, inside, prefix = fs.LocalFileSystem(), path, ""
    (info,) = store.get_file_info([inside])
    found = [info]
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(inside))
    return {prefix + i.path: i.size for i in found
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}


@dataclass
class Stretch(InputPartition):
    """Bytes of one file that a task reads; the file counts as ended at `size`."""

    source: str
    start: int
    stop: int
    size: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.from_start = options.get("start", "end") == "beginning"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {} if self.from_start else self.latestOffset()

    def latestOffset(self) -> dict:
        return {uri: last_line_end(uri, size) for uri, size in sorted(files_of(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for uri, stop in end.items():
            begin = start.get(uri, 0)
            if stop < begin:                    # rotated: another file of that name
                begin = 0
            out += [Stretch(uri, a, min(a + self.range_bytes, stop), stop)
                    for a in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        for lines in lines_of_range(p.source, p.start, p.stop, p.size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.source] * len(lines)), pa.array([p.start] * len(lines), pa.int64()),
                 pa.array(lines, pa.binary())], names=["source", "split", "value"])


class FollowSource(DataSource):
    """Options: path (a file or a folder of them), start (`end` or `beginning`), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source STRING, split BIGINT, value BINARY"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)


def follow_lines(spark: SparkSession, path: str, start: str = "end",
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """New lines of the growing files under `path`, as (source, split, value).

    `start` tells where files begin that are there when the stream first starts: at their `end`
    or their `beginning`. Afterwards the checkpoint tells, so a restarted stream misses no line.
    Rows have the form that `number_lines` numbers; `split` is the byte where a task's range starts.
    """
    if start not in ("end", "beginning"):
        raise ValueError("a stream starts at the end or at the beginning of its files")
    spark.dataSource.register(FollowSource)
    return (spark.readStream.format(FORMAT).option("path", path).option("start", start)
            .option("rangeBytes", range_bytes).load()
            .withColumn("value", F.make_valid_utf8(F.col("value").cast("string"))))
