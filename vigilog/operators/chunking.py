"""Chunking strategies and chunk profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import text
from vigilog.session import materialize
from vigilog.sources.numbering import rank_by_time, rank_lines

CHUNK = ["source", "chunk_id"]


def fixed_size(entries: DataFrame, chunk_size: int = 10, stored: bool = False) -> DataFrame:
    """Every `chunk_size` entries of a source, in line order, form a chunk.

    Here and below, `stored` says that the entries can be read more than once at little cost.
    """
    ranked = rank_lines(entries, "pos", "_rows", stored)
    start = F.floor(F.col("pos") / chunk_size) * chunk_size
    end = F.least(start + chunk_size, F.col("_rows"))
    return ranked.withColumn("chunk_id", F.concat_ws(
        "_", F.lit("fixed"), start.cast("string"), end.cast("string"))).drop("_rows")


def intelligent(entries: DataFrame, chunk_size: int = 20, stored: bool = False) -> DataFrame:
    """4xx, 5xx, successes by /24 and the rest, each cut into runs of `chunk_size` by time.

    A category can hold most of a log, so positions come from per-second counts rather than
    one window per category.
    """
    sorted_in = rank_by_time(
        entries.withColumn("category", text.chunk_category(F.col("status_code"), F.col("client_ip"))),
        ["source", "category"], "pos", stored)
    return sorted_in.withColumn("chunk_id", F.concat_ws(
        "_", "category", F.floor(F.col("pos") / chunk_size).cast("string")))


SECONDS_PER_BLOCK = 86_400
#: Transition tables that are composed at once.
FAN = 16


def _hop(seconds: np.ndarray, window: int) -> np.ndarray:
    """For each second of a sorted array, the index of the first one outside its window."""
    return np.searchsorted(seconds, seconds + window, side="right")


def _block_exits(window: int, span: int):
    """How windows leave a block, for every delay with which it may be entered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = np.sort(pdf["sec"].to_numpy())
        n = len(seconds)
        nxt = _hop(seconds, window)
        base = int(pdf["block"].iloc[0]) * span
        count = np.zeros(n + 1, dtype=np.int64)
        last = np.zeros(n + 1, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            count[i] = count[nxt[i]] + 1
            last[i] = seconds[i] if nxt[i] == n else last[nxt[i]]
        # Entering with delay d: the first window may start no earlier than base + d.
        first = np.searchsorted(seconds, base + np.arange(window + 1))
        reach = np.where(first < n, last[first] + window + 1 - (base + span), 0)
        out = np.maximum(0, reach - int(pdf["gap"].iloc[0]))
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "i": [pdf["i"].iloc[0]],
                             "block": [pdf["block"].iloc[0]], "windows": [count[first]], "out": [out]})

    return run


def _then(f: Column, g: Column) -> Column:
    """The transition table of two neighbours from theirs: windows so far, delay at the exit."""
    return F.struct(
        F.zip_with(f["windows"], F.transform(f["out"], lambda d: F.get(g["windows"], d)),
                   lambda x, y: x + y).alias("windows"),
        F.transform(f["out"], lambda d: F.get(g["out"], d)).alias("out"))


def _entry_delays(tables: DataFrame, window: int) -> DataFrame:
    """(source, block, delay, number): with what delay, and after how many windows, each block is entered.

    The tables of `FAN` neighbours are composed into one, those into one again, up to one per
    source; then the delays go down the same tree. No task holds more than `FAN` tables of a group.
    """
    zero = F.lit(0).cast("bigint")
    same = F.struct(F.transform(F.sequence(F.lit(0), F.lit(window)), lambda _: zero).alias("windows"),
                    F.transform(F.sequence(F.lit(0), F.lit(window)), lambda d: d.cast("bigint")).alias("out"))
    level = tables.select("source", "i", "block", F.struct("windows", "out").alias("f"))
    levels = []
    while True:
        level = materialize(level.groupBy("source", F.floor(F.col("i") / FAN).alias("i")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("i").alias("i"), "block", "f"))).alias("parts")),
            "window-tree")
        levels.append(level)
        if not level.where("i > 0").limit(1).count():
            break
        level = level.select("source", "i", zero.alias("block"), F.aggregate(
            "parts", same, lambda f, part: _then(f, part["f"])).alias("f"))
    entered = levels[-1].select("source", "i", zero.alias("delay"), zero.alias("number"))
    for level in reversed(levels):
        start = F.struct(F.col("delay").alias("delay"), F.col("number").alias("number"),
                         F.array().cast("array<struct<i:bigint,block:bigint,delay:bigint,number:bigint>>").alias("into"))
        walked = F.aggregate("parts", start, lambda at, part: F.struct(
            F.get(part["f"]["out"], at["delay"]).alias("delay"),
            (at["number"] + F.get(part["f"]["windows"], at["delay"])).alias("number"),
            F.array_append(at["into"], F.struct(part["i"].alias("i"), part["block"].alias("block"),
                                                at["delay"].alias("delay"), at["number"].alias("number"))).alias("into")))
        entered = level.join(entered, ["source", "i"]).select("source", F.inline(walked["into"]))
    return entered.drop("i")


def _block_windows(window: int, span: int):
    """The window of every second of one block, given the block's entry delay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec")
        seconds = pdf["sec"].to_numpy()
        nxt = _hop(seconds, window)
        i = int(np.searchsorted(seconds, int(pdf["block"].iloc[0]) * span + pdf["delay"].iloc[0]))
        number = int(pdf["number"].iloc[0])
        start = np.full(len(seconds), -1, dtype=np.int64)
        index = np.full(len(seconds), number - 1, dtype=np.int64)
        while i < len(seconds):
            start[i:nxt[i]] = seconds[i]
            index[i:nxt[i]] = number
            number, i = number + 1, int(nxt[i])
        return pd.DataFrame({"source": pdf["source"], "sec": seconds,
                             "window_start": start, "window_index": index})

    return run


def window_starts(entries: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Greedy time windows: `(source, sec, window_start, window_index)`, one row per second.

    A window starts at its first entry and takes every entry up to `window_seconds` later;
    the next entry starts the next window. That is sequential, but only over the distinct
    seconds of a source, and only through one number: how far into a block of time (one
    day, or longer for long windows) the previous window still reaches. So every block is
    reduced in parallel to a table "delay at entry -> windows, delay at the next entry", the
    tables are composed up a tree and the delays handed down it, and every block is then
    cut in parallel. No task ever sees more than one block of distinct seconds.
    """
    window = int(window_seconds)
    span = max(SECONDS_PER_BLOCK, 4 * window)
    seconds = materialize(
        entries.select("source", F.unix_seconds("ts").alias("sec")).distinct()
        .withColumn("block", F.floor(F.col("sec") / span)), "seconds")
    # One row per day: its number among the source's days, and the seconds to the next one.
    days = Window.partitionBy("source").orderBy("block")
    index = seconds.select("source", "block").distinct().withColumns({
        "i": F.row_number().over(days).cast("bigint") - 1,
        "gap": F.coalesce((F.lead("block").over(days) - F.col("block") - 1) * span, F.lit(0))})
    exits = seconds.join(index, ["source", "block"]).groupBy("source", "block").applyInPandas(
        _block_exits(window, span),
        "source STRING, i BIGINT, block BIGINT, windows ARRAY<BIGINT>, out ARRAY<BIGINT>")
    delays = _entry_delays(exits, window)
    cut = seconds.join(delays, ["source", "block"]).groupBy("source", "block").applyInPandas(
        _block_windows(window, span),
        "source STRING, sec BIGINT, window_start BIGINT, window_index BIGINT")
    # Seconds still covered by a window that began in an earlier block take over its start.
    start = F.max("window_start").over(Window.partitionBy("source", "window_index"))
    return cut.select("source", "sec", start.alias("window_start"), "window_index")


def time_window(entries: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Entries of a source that fall into one greedy time window form a chunk."""
    windows = window_starts(entries, window_seconds)
    keyed = entries.withColumn("sec", F.unix_seconds("ts"))
    iso = text.iso_time(F.timestamp_seconds("window_start"), F.lit("+00:00"))
    return keyed.join(windows, ["source", "sec"]).withColumn("chunk_id", F.concat_ws(
        "_", F.lit("time"), F.col("window_index").cast("string"), iso)).drop("sec")


Chunker = Callable[..., DataFrame]
CHUNKERS: dict[str, Chunker] = {
    "fixed_size": fixed_size, "intelligent": intelligent, "time_window": time_window}


def register_chunker(name: str, chunker: Chunker) -> None:
    CHUNKERS[name] = chunker


def chunk(entries: DataFrame, strategy: str, **options) -> DataFrame:
    """Adds `chunk_id` by the named strategy."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return CHUNKERS[strategy](entries, **options)


def chunk_profile(chunked: DataFrame) -> DataFrame:
    """Everything stored about a chunk of bounded size (`fixed_size`, `intelligent`).

    `pos` orders the entries; start and end are the times of the first and last entry.
    The maps list their keys in order of first occurrence. Each row gathers at most the
    chunk size, so one shuffle by chunk is all this needs.
    """
    entry = F.struct(
        "pos", text.entry_text().alias("text"), text.entry_json().alias("json"),
        F.col("status_code"), F.col("method"), "client_ip", "ts", "tz_offset")
    gathered = (chunked.groupBy(*CHUNK)
                .agg(F.array_sort(F.collect_list(entry)).alias("e")))
    e = F.col("e")

    def counts(name: str, keep):
        values = F.filter(F.transform(e, lambda x: x[name]), keep)
        return F.map_from_entries(F.transform(
            F.array_distinct(values), lambda v: F.struct(
                v, (F.size(values) - F.size(F.array_remove(values, v))).cast("bigint"))))

    first, last = F.get(e, F.lit(0)), F.element_at(e, -1)
    return gathered.select(
        *CHUNK,
        first["ts"].alias("start_time"), last["ts"].alias("end_time"),
        text.iso_time(first["ts"], first["tz_offset"]).alias("start_time_iso"),
        text.iso_time(last["ts"], last["tz_offset"]).alias("end_time_iso"),
        F.size(e).cast("bigint").alias("log_count"),
        F.array_sort(F.array_distinct(F.filter(
            F.transform(e, lambda x: x["client_ip"]), lambda ip: ip != ""))).alias("unique_ips"),
        counts("status_code", lambda s: s != 0).alias("status_codes"),
        counts("method", lambda m: m != "").alias("methods"),
        F.array_join(F.transform(e, lambda x: x["text"]), "\n").alias("document"),
        F.concat(F.lit("["), F.array_join(F.transform(e, lambda x: x["json"]), ", "), F.lit("]"))
        .alias("raw_logs"))


def window_profile(chunked: DataFrame) -> DataFrame:
    """Profile of time-window chunks, whose size has no bound.

    Everything is counted in partial aggregates; a busy window is never gathered in one
    task. Its text comes in ordered parts from `window_documents`.
    """
    facts = chunked.select(*CHUNK, "ts", F.inline(F.array(
        F.struct(F.lit("").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("status").alias("kind"), F.when(
            F.col("status_code") != 0, F.col("status_code").cast("string")).alias("value")),
        F.struct(F.lit("method").alias("kind"), text.filled(F.col("method")).alias("value")),
        F.struct(F.lit("ip").alias("kind"), text.filled(F.col("client_ip")).alias("value")))))
    counted = (facts.filter(F.col("value").isNotNull()).groupBy(*CHUNK, "kind", "value")
               .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")))

    def entries(kind: str):
        return F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("kind") == kind, F.struct("value", "n")))))

    return counted.groupBy(*CHUNK).agg(
        F.min("lo").alias("start_time"), F.max("hi").alias("end_time"),
        F.max(F.when(F.col("kind") == "", F.col("n"))).alias("log_count"),
        F.count_if(F.col("kind") == "ip").alias("unique_ip_count"),
        entries("status").alias("status_codes"), entries("method").alias("methods"))


def window_documents(chunked: DataFrame, lines_per_part: int = 10_000) -> DataFrame:
    """The text of time-window chunks as `(chunk_id, part, document)`, whole and in order."""
    ranked = rank_by_time(chunked, CHUNK, "pos")
    part = F.floor(F.col("pos") / lines_per_part).alias("part")
    lines = F.array_sort(F.collect_list(F.struct("pos", text.entry_text().alias("text"))))
    return (ranked.groupBy(*CHUNK, part).agg(lines.alias("l"))
            .select(*CHUNK, "part", F.array_join(
                F.transform("l", lambda x: x["text"]), "\n").alias("document")))
