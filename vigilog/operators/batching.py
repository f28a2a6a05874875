"""Count-based batches of accepted entries, their groups and the group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import text
from vigilog.operators.profiles import group_profile, render_top
from vigilog.session import materialize
from vigilog.sources.numbering import rank_lines

BATCH = ["source", "batch_id"]
GROUP = ["source", "batch_id", "group_id"]
#: Entries of the batches that one task gets. Their number sets the number of tasks, as every list of a
#: batch is sorted where the batch lies: with a fixed number, a task's memory would grow with the log.
ENTRIES_PER_TASK = 1 << 14


def assign_batches(entries: DataFrame, size: int = 50, include_partial: bool = False,
                   stored: bool = False) -> DataFrame:
    """Adds `batch_id` and `position`: every `size` entries of a source form a batch.

    `position` is the entry's place in its batch by time, then line.

    The last, incomplete batch of a source is dropped unless `include_partial`. The result
    is partitioned by batch, so all later per-batch work runs without another shuffle. `stored`
    says that the entries can be read more than once at little cost; others are written first.
    """
    if size < 1:
        raise ValueError("a batch has one entry at least")
    rows = entries if stored else materialize(entries, "unranked")
    tasks = max(2, -(-rows.count() // ENTRIES_PER_TASK))
    ranked = rank_lines(rows, "_rn", "_rows", stored=True).withColumn(
        "batch_id", F.floor(F.col("_rn") / size))
    if not include_partial:
        ranked = ranked.filter((F.col("batch_id") + 1) * size <= F.col("_rows"))
    in_time = Window.partitionBy(*BATCH).orderBy("ts", "line_number")
    return (ranked.drop("_rn", "_rows").repartition(tasks, *BATCH)
            .withColumn("position", F.row_number().over(in_time) - 1))


def group_entries(batched: DataFrame) -> DataFrame:
    """Adds `group_id` (4xx, 5xx, /24 network of successes, other) inside the batch."""
    return batched.withColumn(
        "group_id", text.batch_group(F.col("status_code"), F.col("client_ip")))


def is_network_group(group_id: Column) -> Column:
    return group_id.startswith("cidr_")


def summary_lists() -> dict[str, tuple[Column, int | None]]:
    """Top lists of a group summary. A missing address counts as the value `None`."""
    c = F.col
    return {
        "top_ips": (F.when(~is_network_group(c("group_id")),
                           F.coalesce(c("client_ip"), F.lit("None"))), 3),
        "top_paths": (text.filled(c("path")), 5),
        "methods": (text.filled(c("method")), None),
        "status_codes": (F.when(c("status_code") != 0, c("status_code")), 5),
        "user_agents": (text.simple_agent(text.filled(c("user_agent"))), 3),
    }


def with_rate(stats: DataFrame) -> DataFrame:
    """Adds `duration_s` and `rate` (requests per second, only beyond one second)."""
    seconds = F.unix_seconds("last.ts") - F.unix_seconds("first.ts")
    return stats.withColumn("duration_s", seconds).withColumn(
        "rate", F.when(F.col("duration_s") > 1, F.col("n") / F.nullif("duration_s", F.lit(0))))


def group_stats(grouped: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, time range, duration and rate of every group."""
    stats = grouped.groupBy(*(keys or GROUP)).agg(
        F.count(F.lit(1)).alias("n"),
        F.struct(F.min("ts").alias("ts")).alias("first"),
        F.struct(F.max("ts").alias("ts")).alias("last"))
    return with_rate(stats)


def summarize_groups(grouped: DataFrame) -> DataFrame:
    """Typed statistics and the rendered key-value summary of every group."""
    profile = with_rate(group_profile(grouped, GROUP, summary_lists()))
    return profile.withColumn("summary_text", summary_text())


# The labels of summary texts, here and in `summary_text` and `analysis_summary`.
def _title(group_id: Column) -> Column:
    return (F.when(group_id.startswith("4xx_errors"), F.lit("Group: 4xx Client Errors"))
            .when(group_id.startswith("5xx_errors"), F.lit("Group: 5xx Server Errors"))
            .when(group_id.startswith("cidr_"), F.concat(
                F.lit("Group: Requests from CIDR "), F.replace(group_id, F.lit("cidr_"), F.lit(""))))
            .otherwise(F.concat(F.lit("Group: "), group_id)))


def summary_text() -> Column:
    c = F.col
    flags = F.concat_ws(
        ", ",
        F.when(c("suspicious_query"), F.lit("suspicious query strings detected")),
        F.when(c("auth_failures") > 0,
               F.concat(c("auth_failures").cast("string"), F.lit(" authentication failures"))))
    return F.concat_ws(
        "\n",
        _title(c("group_id")),
        F.concat(F.lit("Count: "), c("n").cast("string"), F.lit(" requests")),
        F.concat(F.lit("Time Range: "), text.iso_time(c("first.ts"), c("first.tz_offset")),
                 F.lit(" to "), text.iso_time(c("last.ts"), c("last.tz_offset"))),
        F.when(c("duration_s") > 1, F.concat(
            F.lit("Request Rate: "), text.two_decimals(c("n"), c("duration_s")),
            F.lit(" requests/second"))),
        F.when(~is_network_group(c("group_id")),
               F.concat(F.lit("Top IPs: "), render_top(c("top_ips"), "%s (%s requests)"))),
        F.concat(F.lit("Top Paths: "), render_top(c("top_paths"))),
        F.concat(F.lit("Methods: "), render_top(c("methods"))),
        F.concat(F.lit("Status Codes: "), render_top(c("status_codes"))),
        F.when(F.size("user_agents") > 0,
               F.concat(F.lit("User-Agents: "), render_top(c("user_agents")))),
        F.concat(F.lit("Suspicious Patterns: "), text.filled(flags)))


def batch_profile(batched: DataFrame) -> DataFrame:
    """Per batch: size, time range, distinct addresses and the top lists of its summary.

    `top_ips` counts a missing address as `None`; `known_ips` and `known_paths` are the
    longer lists used when a threat's own indicators match nothing.
    """
    c = F.col
    lists = {
        "top_ips": (F.coalesce(c("client_ip"), F.lit("None")), 5),
        "top_status": (F.when(c("status_code") != 0, c("status_code")), 5),
        "top_paths": (text.filled(c("path")), 5),
        "known_ips": (text.filled(c("client_ip")), 10),
        "known_paths": (text.filled(c("path")), 20),
    }
    return group_profile(batched, BATCH, lists)


def analysis_summary(profile: DataFrame, threats: DataFrame,
                     errors: DataFrame | None = None) -> DataFrame:
    """One summary text per batch from its profile and the threats found in it.

    `threats` has one row per threat: batch keys, `threat_no` (its order in the reply),
    `type`, `description`, `source_ips`. Addresses are listed in sorted order. `errors` (batch
    keys, `error`) names the batches whose analysis failed; their summary says so.
    """
    by_type = (threats.groupBy(*BATCH, F.coalesce("type", F.lit("unknown")).alias("type"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("threat_no").alias("_first"))
               .groupBy(*BATCH)
               .agg(F.sum("n").alias("threats_found"),
                    F.array_sort(F.collect_list(F.struct("_first", F.col("type").alias("value"),
                                                         "n"))).alias("threat_types")))
    addresses = (threats.select(*BATCH, F.explode("source_ips").alias("ip")).distinct()
                 .groupBy(*BATCH)
                 .agg(F.slice(F.array_sort(F.collect_list("ip")), 1, 10).alias("threat_ips")))
    described = (threats.filter(F.col("threat_no") <= 3).groupBy(*BATCH)
                 .agg(F.array_sort(F.collect_list(F.struct("threat_no", F.concat(
                     F.lit("Threat "), F.col("threat_no").cast("string"), F.lit(": "),
                     F.coalesce("type", F.lit("unknown")), F.lit(" - "),
                     F.substring(F.coalesce("description", F.lit("")), 1, 100)).alias("line"))))
                      .alias("threat_lines")))
    joined = (profile.join(by_type, BATCH, "left").join(addresses, BATCH, "left")
              .join(described, BATCH, "left")
              .withColumn("threats_found", F.coalesce("threats_found", F.lit(0))))
    joined = (joined.withColumn("error", F.lit(None).cast("string")) if errors is None else
              joined.join(errors.select(*BATCH, "error"), BATCH, "left"))
    c = F.col
    found = F.concat_ws(
        "\n",
        F.concat(F.lit("\nThreats Detected: "), c("threats_found").cast("string")),
        F.concat(F.lit("Threat Types: "), render_top(c("threat_types"))),
        F.concat(F.lit("Suspicious IPs: "), F.array_join("threat_ips", ", ")),
        F.array_join(F.transform("threat_lines", lambda t: t["line"]), "\n"))
    calm = F.lit("\nThreats Detected: 0\n"
                 "Assessment: Normal traffic patterns, no suspicious activity")
    document = F.concat_ws(
        "\n",
        F.lit("Analysis Summary"),
        F.concat(F.lit("Batch Size: "), c("n").cast("string"), F.lit(" logs")),
        F.concat(F.lit("Time Range: "), text.iso_time(c("first.ts"), c("first.tz_offset")),
                 F.lit(" to "), text.iso_time(c("last_entry.ts"), c("last_entry.tz_offset"))),
        F.concat(F.lit("Unique IPs: "), c("distinct_top_ips").cast("string")),
        F.concat(F.lit("Top IPs: "), render_top(c("top_ips"))),
        F.concat(F.lit("Status Codes: "), render_top(c("top_status"))),
        F.concat(F.lit("Top Paths: "), render_top(c("top_paths"))),
        F.when(c("error").isNotNull(), F.concat(F.lit("\nAnalysis failed: "), c("error")))
        .when(c("threats_found") > 0, found).otherwise(calm))
    return joined.withColumn("document", F.when(c("n") > 0, document).otherwise(
        F.lit("Empty analysis batch")))
