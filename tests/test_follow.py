"""Following growing files: what is appended arrives once and whole, over restarts and rotations."""

import pytest
from pyspark.sql import functions as F

from vigilog.sources import follow, logs


class Follower:
    """A stream that appends what it reads to a folder, as micro-batches on demand."""

    def __init__(self, spark, tmp_path, path, **options):
        self.spark, self.tmp, self.path, self.options = spark, tmp_path, path, options
        self.query = None

    def start(self):
        def write(rows, epoch):
            rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{self.tmp}/out/{epoch}")

        self.query = (follow.follow_lines(self.spark, str(self.path), **self.options).writeStream
                      .foreachBatch(write).option("checkpointLocation", f"{self.tmp}/check").start())
        self.query.processAllAvailable()
        return self

    def read(self):
        self.query.processAllAvailable()
        if not (self.tmp / "out").exists():
            return []
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.tmp}/out").collect()
        return sorted((r.source.rpartition("/")[2], r.value) for r in rows)

    def stop(self):
        self.query.stop()


@pytest.fixture
def follower(spark, tmp_path):
    made = []

    def make(path, **options):
        made.append(Follower(spark, tmp_path, path, **options))
        return made[-1].start()

    yield make
    for f in made:
        f.stop()


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_starts_at_the_end_and_reads_no_half_line(follower, tmp_path):
    log = tmp_path / "a.log"
    append(log, b"old 1\nold 2\nbegun ")
    f = follower(log)
    assert f.read() == []
    append(log, b"before\nnew 1\r\nnew \xff 2\nhalf")
    assert f.read() == [("a.log", "begun before"), ("a.log", "new 1"), ("a.log", "new � 2")]
    append(log, b" line\n")
    assert f.read()[1] == ("a.log", "half line")
    assert len(f.read()) == 4


def test_a_folder_from_its_beginning_new_files_and_rotation(follower, tmp_path):
    logs_ = tmp_path / "logs"
    logs_.mkdir()
    append(logs_ / "a.log", b"a1\na2\n")
    f = follower(logs_, start="beginning", range_bytes=2)
    assert f.read() == [("a.log", "a1"), ("a.log", "a2")]
    append(logs_ / "b.log", b"b1\n")
    append(logs_ / "a.log", b"a3 is a longer line\n")
    assert f.read() == [("a.log", "a1"), ("a.log", "a2"), ("a.log", "a3 is a longer line"), ("b.log", "b1")]
    (logs_ / "a.log").unlink()
    append(logs_ / "a.log", b"rotated\n")
    assert ("a.log", "rotated") in f.read() and len(f.read()) == 5


def test_a_restart_goes_on_where_the_checkpoint_ends(follower, tmp_path):
    log = tmp_path / "a.log"
    append(log, b"x\n")
    f = follower(log)
    append(log, b"one\n")
    assert f.read() == [("a.log", "one")]
    f.stop()
    append(log, b"two\nthr")
    f.start()
    append(log, b"ee\n")
    assert f.read() == [("a.log", "one"), ("a.log", "three"), ("a.log", "two")]


def test_followed_lines_can_be_numbered(spark, tmp_path, follower):
    log = tmp_path / "a.log"
    append(log, b"".join(b"line %d\n" % i for i in range(500)))
    f = follower(log, start="beginning", range_bytes=300)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    assert f.read() and rows.count() == 500
    reader = follow.FollowReader({"path": str(log), "start": "beginning", "rangebytes": "300"})
    batches = [b for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p)]
    df = spark.createDataFrame(__import__("pyarrow").Table.from_batches(batches)).withColumn(
        "value", F.col("value").cast("string"))
    got = {r.line_number: r.value for r in logs.number_lines(df).collect()}
    assert got == {i + 1: f"line {i}" for i in range(500)}


def test_last_line_end(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "BACK_BYTES", 3)
    for data, end in ((b"", 0), (b"abcdefgh", 0), (b"a\nbcdefghi", 2), (b"abc\n", 4), (b"a\n\nb", 3)):
        (tmp_path / "f").write_bytes(data)
        assert follow.last_line_end(str(tmp_path / "f"), len(data)) == end
