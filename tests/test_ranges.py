"""Byte ranges of text files: no line lost or cut, whatever the ranges and the settings."""

import bz2
import gzip
import random

import pytest

from vigilog.sources import logs, ranges


def split(data: bytes) -> list[bytes]:
    return data.splitlines()


@pytest.mark.parametrize("step", [3, 64, 1 << 20])
def test_ranges_own_lines_by_their_first_byte(tmp_path, monkeypatch, step):
    monkeypatch.setattr(ranges, "STEP_BYTES", step)
    rng = random.Random(step)
    for case in range(60):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", b"\r", b"long line " * 3, b"\xff\x80"])
                        for _ in range(rng.randrange(40)))
        path = tmp_path / f"{case}.log"
        path.write_bytes(data)
        for size in (1, 2, 5, 17, 1000):
            found = [line for a in range(0, len(data), size) for part in ranges.lines_of_range(
                str(path), a, min(a + size, len(data)), len(data)) for line in part]
            assert found == split(data), (data, size)


def write(folder, n=60_000):
    folder.mkdir()
    rows = [f"line {i} " + "x" * (i % 90) for i in range(n)]
    (folder / "a.log").write_text("\n".join(rows) + "\n")
    (folder / "b c.log").write_bytes("last without end ä".encode() + b"\r\nbad \xff byte\rend")
    (folder / "empty.log").write_bytes(b"")
    (folder / "old.log.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    (folder / "older.log.bz2").write_bytes(bz2.compress(b"eins\nzwei"))
    return rows


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source.rpartition("/")[2], {})[r.line_number] = r.value
    return out


@pytest.mark.parametrize("scan", [lambda s, p: logs.scan_lines(s, p, 50_000), logs.scan_lines, logs.scan_text])
def test_scans_give_every_line_its_number(spark, tmp_path, scan):
    rows = write(tmp_path / "logs")
    got = found(scan(spark, str(tmp_path / "logs")))
    assert got.pop("a.log") == {i + 1: r for i, r in enumerate(rows)}
    assert got.pop("b%20c.log") == {1: "last without end ä", 2: "bad � byte", 3: "end"}
    assert got.pop("old.log.gz") == {1: "one", 2: "two"}
    assert got.pop("older.log.bz2") == {1: "eins", 2: "zwei"} and not got


@pytest.mark.parametrize("scan", [logs.scan_lines, logs.scan_text])
def test_no_line_is_lost_when_the_planning_changes_in_between(spark, tmp_path, scan):
    """60,000 lines, counted under one planning of files and read under another."""
    rows = write(tmp_path / "logs")
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        df = scan(spark, str(tmp_path / "logs" / "a.log"))
        spark.conf.set("spark.sql.files.minPartitionNum", "6")
        got = found(df)["a.log"]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        if before:
            spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert got == {i + 1: r for i, r in enumerate(rows)}


def test_a_file_that_changes_between_the_passes_is_an_error(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\nthree\n")
    df = logs.scan_lines(spark, str(path))
    path.write_text("one two\nthree\n")
    with pytest.raises(Exception, match="changed"):
        df.collect()


def test_text_is_neither_shuffled_nor_parsed_twice(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    plan = logs.scan_lines(spark, str(tmp_path / "a.log"))._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("MapInArrow")]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in after and "Join" not in plan


@pytest.mark.parametrize("step", [3, 1 << 20])
def test_tails_are_read_backwards(tmp_path, monkeypatch, step):
    monkeypatch.setattr(ranges, "STEP_BYTES", step)
    rng = random.Random(step)
    for case in range(60):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", b"\r", b"long line"]) for _ in range(rng.randrange(30)))
        (tmp_path / "f").write_bytes(data)
        for n in (1, 2, 5, 50):
            start = ranges.start_of_tail(str(tmp_path / "f"), len(data), n)
            assert split(data[start:]) == split(data)[-n:], (data, n)


def test_the_tail_of_files(spark, tmp_path):
    rows = write(tmp_path / "logs")
    got = {}
    for r in logs.scan_tail(spark, str(tmp_path / "logs"), 3).collect():
        got.setdefault(r.source.rpartition("/")[2], {})[r.from_end] = r.value
    assert got["a.log"] == {3: rows[-3], 2: rows[-2], 1: rows[-1]}
    assert got["old.log.gz"] == {2: "one", 1: "two"} and got["b%20c.log"][1] == "end"
