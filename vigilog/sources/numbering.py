"""Consecutive numbering without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import materialize

LINES_PER_BLOCK = 1 << 16
BLOCKS_PER_SPAN = 4096
#: Blocks whose offsets may be broadcast: 33 billion rows in full blocks, about 50 MB.
BROADCAST_BLOCKS = 500_000


def rank_in_order(df: DataFrame, keys: list[str], order: list, blocks: list[Column],
                  name: str = "rn", total: str | None = None, stored: bool = False) -> DataFrame:
    """0-based position of every row inside its `keys`, following `order`.

    `blocks` must not decrease along `order`, compared from the first to the last; they cut a
    key's rows into slices small enough for one task. Rows are ranked inside their block, and a
    table with one row per block supplies the number of rows before it; the running sum over
    blocks has two levels, so no window holds all blocks of a hot key. The rows are evaluated
    once: they are written, unless they are `stored` already, and only keys and order are read to
    count the blocks. `total` names an optional column for the number of rows of the key.
    """
    rows = df if stored else materialize(df, "unranked")
    cuts = [f"_block{i}" for i in range(len(blocks))]
    cut = rows.withColumns({c: b.cast("bigint") for c, b in zip(cuts, blocks, strict=True)})
    starts = materialize(_starts(cut.groupBy(*keys, *cuts).agg(F.count(F.lit(1)).alias("_n")), keys, cuts),
                         "block-starts")
    if starts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    ranked = cut.withColumn("_pos", F.row_number().over(
        Window.partitionBy(*keys, *cuts).orderBy(*order)) - 1)
    extra = [F.col("_total").alias(total)] if total else []
    return ranked.join(starts, [*keys, *cuts]).select(
        *df.columns, (F.col("_start") + F.col("_pos")).alias(name), *extra)


def _starts(counts: DataFrame, keys: list[str], cuts: list[str]) -> DataFrame:
    """Rows of the key before each block, and in all."""
    counts = materialize(counts.withColumn("_span", F.floor(F.col(cuts[0]) / BLOCKS_PER_SPAN)), "blocks")
    before = (Window.unboundedPreceding, -1)
    spans = (counts.groupBy(*keys, "_span").agg(F.sum("_n").alias("_n"))
             .select(*keys, "_span",
                     F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span")
                                      .rowsBetween(*before)).alias("_earlier"),
                     F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_span").orderBy(*cuts).rowsBetween(*before))
    return (counts.select(*keys, "_span", *cuts, inside.alias("_inside")).join(spans, [*keys, "_span"])
            .select(*keys, *cuts, "_total",
                    (F.coalesce("_earlier", F.lit(0)) + F.coalesce("_inside", F.lit(0))).alias("_start")))


def rank_lines(df: DataFrame, name: str = "rn", total: str | None = None, stored: bool = False) -> DataFrame:
    """0-based position of every row of a source in line order."""
    return rank_in_order(df, ["source"], ["line_number"],
                         [F.floor(F.col("line_number") / LINES_PER_BLOCK)], name, total, stored)


def rank_by_time(df: DataFrame, keys: list[str], name: str = "rn", stored: bool = False) -> DataFrame:
    """0-based position inside `keys` by time, then line.

    A block is a second; one that holds very many lines, as in a flood, is cut by line number. Logs
    give whole seconds, in which the lines follow their numbers. Where times have fractions, a
    64th of a second is the smallest block.
    """
    micros = F.unix_micros("ts")
    rest = F.pmod(micros, F.lit(1_000_000))
    line = F.when(rest == 0, F.floor(F.col("line_number") / LINES_PER_BLOCK)).otherwise(F.lit(1 << 50))
    return rank_in_order(df, keys, ["ts", "line_number"],
                         [F.unix_seconds("ts"), F.floor(rest / 15_625), line], name, stored=stored)
