"""Tables of micro-batches: bounded folders, replays, lost attempts."""

import uuid

import pytest

from vigilog.session import folders, scratch_root
from vigilog.streaming.epochs import EpochTable


@pytest.fixture
def table(spark):
    return EpochTable(spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", "t", "n BIGINT", fan=3)


def rows(spark, epoch):
    return spark.createDataFrame([(epoch,)], "n BIGINT")


def values(df):
    return sorted(r.n for r in df.collect())


def count(spark, table):
    return sum(len(folders(spark, f"{table.path}/{level}")) for level in folders(spark, table.path))


def test_folders_stay_bounded_and_rows_whole(spark, table):
    most = 0
    for epoch in range(60):
        for attempt in range(2 if epoch % 7 in (0, 3) else 1):      # some micro-batches run twice
            table.begin(epoch)
            if attempt == 0 and epoch % 7 == 3:
                table.put(rows(spark, -1), epoch)                   # what a lost attempt wrote
            assert values(table.of(epoch - 1)) == ([epoch - 1] if epoch else [])
            if epoch % 9 == 0:
                assert values(table.upto(epoch, epoch)) == list(range(epoch))
            table.put(rows(spark, epoch), epoch)
        if epoch % 5 == 0:
            assert values(table.all()) == list(range(epoch + 1))
        most = max(most, count(spark, table))
    assert values(table.all()) == list(range(60))
    assert most <= 4 * 2 * 3                                        # levels x two x fan


def test_a_lost_merge_is_made_again(spark, table):
    for epoch in range(9):
        table.begin(epoch)
        table.put(rows(spark, epoch), epoch)
    table.begin(9)
    assert values(table.upto(9, 9)) == list(range(9))
    table.begin(9)                                                  # the attempt was lost
    table.put(rows(spark, 9), 9)
    assert values(table.all()) == list(range(10))


def test_hand_over_keeps_two_folders(spark, table):
    for epoch in range(6):
        table.keep_last(epoch)
        table.put(rows(spark, epoch), epoch)
        assert count(spark, table) <= 2
    assert values(table.of(5)) == [5] and values(table.of(-1)) == []


def test_an_empty_table_has_no_rows(table):
    assert table.last() == -1 and values(table.all()) == []
