"""The physical plans keep the promises the operators make."""

import re

import pytest
from pyspark.sql import functions as F

from test_operators import make_log
from vigilog.operators import batching, chunking, filtering, parsing, profiles, rules
from vigilog.schema import RAW_LINES
from vigilog.sources import numbering


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, 50)[0]


def test_parse_runs_one_regex_before_the_filters(spark):
    raw = spark.createDataFrame([], RAW_LINES)
    text = plan(filtering.keep_entries(parsing.parse_log(raw)))
    assert text.index("Filter") < text.index("Generate inline")
    assert "Python" not in text and "Exchange" not in text


@pytest.mark.parametrize("build", [
    lambda d: numbering.rank_lines(d), lambda d: chunking.intelligent(d),
    lambda d: batching.summarize_groups(batching.group_entries(batching.assign_batches(d))),
    lambda d: rules.find_threats(d), lambda d: chunking.window_profile(chunking.time_window(d))])
def test_no_single_partition_windows_or_cross_joins(log, build):
    text = plan(build(log))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_native_operators_stay_in_the_jvm(log):
    for df in (batching.summarize_groups(batching.group_entries(batching.assign_batches(log))),
               rules.find_threats(log), chunking.intelligent(log)):
        assert not re.search("InPandas|ArrowEvalPython|BatchEvalPython", plan(df))


def test_top_values_prune_before_the_shuffle(log):
    text = plan(profiles.top_values(log, ["source"], F.col("path"), 3))
    assert "WindowGroupLimit" in text


def test_summaries_shuffle_rows_once_after_batching(log):
    batched = batching.assign_batches(log)
    extra = plan(batching.summarize_groups(batching.group_entries(batched))).count("Exchange hash")
    assert extra == plan(batched).count("Exchange hash")


def test_entries_are_parsed_once_for_batches(spark):
    raw = spark.createDataFrame([("s", 1, "x")], RAW_LINES)
    entries = filtering.keep_entries(parsing.parse_log(raw))
    for df in (batching.assign_batches(entries), chunking.fixed_size(entries), chunking.intelligent(entries)):
        text = plan(df)
        assert "regexp" not in text and "Generate inline" not in text     # it reads what was parsed
        assert text.count("FileScan parquet") == 2                        # rows, and starts of blocks


def test_profiles_sort_no_entries(spark):
    """Entries are counted by hashing; the least or greatest of structs would have them sorted."""
    df, _ = make_log(spark, 300)
    found = plan(batching.batch_profile(batching.assign_batches(df)))
    assert "SortAggregate" not in found and found.count("HashAggregate") >= 2
