"""Tables written by micro-batches: replays overwrite, and the number of folders stays bounded.

A micro-batch writes its rows to a folder named by its number. Every `FAN` micro-batches these
folders are merged into one of the next level, `FAN` of those into one of the level after it, and so
on; what has been merged is deleted one micro-batch later. Which folders count follows from the
number of the micro-batch alone, so nothing is recorded and a lost attempt leaves nothing behind
that counts: its merge and its rows are written again under the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.session import folders, remove

#: Folders of a level that are merged into one of the next.
FAN = 32


class EpochTable:
    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType | str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, f"{root}/{name}", fan
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _folder(self, level: int, epoch: int) -> str:
        return f"{self.path}/level={level}/epoch={epoch}"

    def _merged(self, level: int, epoch: int) -> int:
        """Micro-batches before this one are in folders of `level` or above, once `epoch` has begun."""
        size = self.fan ** level
        return epoch // size * size

    def begin(self, epoch: int) -> None:
        """Merges what is due at the start of a micro-batch and deletes what an earlier one merged."""
        level = 0
        while epoch > 0 and epoch % self.fan ** (level + 1) == 0:
            size = self.fan ** level
            parts = [self._folder(level, epoch - 1 - i * size) for i in reversed(range(self.fan))]
            (self.spark.read.schema(self.schema).parquet(*parts)
             .write.mode("overwrite").parquet(self._folder(level + 1, epoch - 1)))
            level += 1
        for name in folders(self.spark, self.path):
            level = int(name.partition("=")[2])
            self._drop(level, self._merged(level + 1, epoch - 1) if epoch else 0)

    def _drop(self, level: int, before: int) -> None:
        for name in folders(self.spark, f"{self.path}/level={level}"):
            if int(name.partition("=")[2]) < before:
                remove(self.spark, f"{self.path}/level={level}/{name}")

    def keep_last(self, epoch: int) -> None:
        """For rows that only the next micro-batch reads: deletes all before the one before `epoch`."""
        self._drop(0, epoch - 1)

    def put(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Writes a micro-batch's rows, in place of what a lost attempt wrote, and reads them back."""
        rows.to(self.schema).write.mode("overwrite").parquet(self._folder(0, epoch))
        return self.of(epoch)

    def of(self, epoch: int) -> DataFrame:
        """The rows of one micro-batch that hasn't been merged; none before the first."""
        if epoch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(0, epoch))

    def upto(self, epoch: int, stop: int | None = None) -> DataFrame:
        """All rows of the micro-batches before `stop` (default: with `epoch`), as they lie in `epoch`."""
        stop = epoch + 1 if stop is None else stop
        parts, level, end = [], 0, stop
        while end > 0:
            begin, size = min(end, self._merged(level + 1, epoch)), self.fan ** level
            parts += [self._folder(level, e) for e in range(begin + size - 1, end, size)]
            level, end = level + 1, begin
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*parts)

    def last(self) -> int:
        """The newest micro-batch that has written, or -1."""
        found = folders(self.spark, f"{self.path}/level=0")
        return max((int(name.partition("=")[2]) for name in found), default=-1)

    def all(self) -> DataFrame:
        return self.upto(self.last())
