"""Counted values per group: the two-level aggregation behind every top-k list.

Values are counted map-side first, then ranked. Equal counts are ordered by first
occurrence (time, then line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import text


def top_values(df: DataFrame, keys: list[str], value: Column, k: int | None) -> DataFrame:
    """`(keys, rank, value, n)` for the `k` most frequent non-NULL values of every group."""
    counted = (df.select(*keys, value.cast("string").alias("value"), "ts", "line_number")
               .filter(F.col("value").isNotNull())
               .groupBy(*keys, "value")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.min(F.struct("ts", "line_number")).alias("_first")))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    ranked = counted.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.select(*keys, F.col("rank").cast("bigint").alias("rank"), "value", "n")


def render_top(items: Column, pattern: str = "%s (%s)") -> Column:
    """`value (n), value (n)` from an array of `(value, n)`."""
    head, middle, tail = pattern.split("%s")
    return F.array_join(F.transform(items, lambda i: F.concat(
        F.lit(head), i["value"], F.lit(middle), i["n"].cast("string"), F.lit(tail))), ", ")


def group_profile(df: DataFrame, keys: list[str], lists: dict[str, tuple[Column, int | None]]
                  ) -> DataFrame:
    """Basic statistics and several top lists of every group in one pass over the input.

    For groups inside a batch: `position` is an entry's place in its batch by time. Each entry
    is spread into one row per list plus one for the group itself; the input is read and
    shuffled once instead of once per list, and not again when it is already partitioned by
    a subset of `keys`. What is gathered per group is bounded by the batch size. Columns:
    `n`, `first`, `last` (earliest entry at the latest time), `last_entry` (each a struct of
    `ts` and `tz_offset`), `suspicious_query`, `auth_failures`, `distinct_<list>`, and one
    array of `(value, n)` per list, most frequent first.
    """
    attributes = [F.struct(F.lit(0).alias("list"), F.lit("").alias("value"))] + [
        F.struct(F.lit(i).alias("list"), value.cast("string").alias("value"))
        for i, (value, _) in enumerate(lists.values(), 1)]
    # The group's own rows are counted per moment: plain numbers alone are aggregated by hashing,
    # while the least or greatest of structs would have every row sorted.
    is_own = F.col("list") == 0
    counted = (df.select(
        *keys, F.col("position").alias("_position"), F.col("ts").alias("_ts"), F.col("tz_offset").alias("_tz"),
        text.group_suspicious_query(F.col("query_string")).cast("int").alias("_suspicious"),
        F.coalesce(F.col("status_code").isin(401, 403), F.lit(False)).cast("int").alias("_auth"),
        F.inline(F.array(*attributes)))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "list", "value", F.when(is_own, F.col("_ts")).alias("ts"),
                 F.when(is_own, F.col("_tz")).alias("tz_offset"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_position").alias("first"),
             F.max("_position").alias("last"), F.max("_suspicious").alias("suspicious"),
             F.sum("_auth").alias("auth")))
    item = F.struct("list", (-F.col("n")).alias("order"), "first", "value", "n", "last", "ts",
                    "tz_offset", "suspicious", "auth")
    gathered = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def own(field) -> Column:
        return F.transform(F.filter("_items", lambda i: i["list"] == 0), field)

    def total(name: str) -> Column:
        return F.aggregate(own(lambda i: i[name]), F.lit(0).cast("bigint"), lambda a, b: a + b)

    def entry(pick, order) -> Column:
        found = pick(own(lambda i: F.struct(i["ts"].alias("ts"), order(i).alias("at"),
                                            i["tz_offset"].alias("tz_offset"))))
        return F.struct(found["ts"].alias("ts"), found["tz_offset"].alias("tz_offset"))

    def listed(index: int) -> Column:
        return F.filter("_items", lambda i: i["list"] == index)

    def shown(index: int, k: int | None) -> Column:
        rows = listed(index) if k is None else F.slice(listed(index), 1, k)
        return F.transform(rows, lambda i: F.struct(i["value"].alias("value"), i["n"].alias("n")))

    return gathered.select(
        *keys, total("n").alias("n"), entry(F.array_min, lambda i: i["first"]).alias("first"),
        entry(F.array_max, lambda i: -i["first"]).alias("last"),
        entry(F.array_max, lambda i: i["last"]).alias("last_entry"),
        (F.array_max(own(lambda i: i["suspicious"])) > 0).alias("suspicious_query"),
        total("auth").alias("auth_failures"),
        *[F.size(listed(i)).cast("bigint").alias(f"distinct_{name}")
          for i, name in enumerate(lists, 1)],
        *[shown(i, k).alias(name) for i, (name, (_, k)) in enumerate(lists.items(), 1)])
