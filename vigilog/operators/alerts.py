"""Queries over stored alerts and analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_COLUMNS = ("status", "model_used", "logs_analyzed", "threats_found", "duration_seconds")


def newest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc(key))


def with_run(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts with the columns of their run; the side to broadcast is chosen by size."""
    side = runs.select("run_id", F.col("ts").alias("run_ts"), *[
        F.col(c).alias(f"run_{c}") for c in RUN_COLUMNS])
    return alerts.join(side, "run_id")


def select_alerts(alerts: DataFrame, severity: str | None = None, threat_type: str | None = None,
                  acknowledged: str | None = None, since: Column | None = None) -> DataFrame:
    """Alerts that pass all given filters; `acknowledged` is `yes`, `no` or nothing."""
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    if threat_type:
        alerts = alerts.filter(F.col("threat_type") == threat_type)
    if acknowledged in ("yes", "no"):
        alerts = alerts.filter(F.col("acknowledged") == (acknowledged == "yes"))
    if since is not None:
        alerts = alerts.filter(F.col("ts") >= since)
    return alerts


def alert_detail(alerts: DataFrame, runs: DataFrame, alert_id) -> DataFrame:
    return with_run(alerts.filter(F.col("alert_id") == alert_id), runs)


def latest_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The newest alerts, each with the total number of alerts."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return newest_first(alerts, "alert_id").limit(n).withColumn("total", total)


def run_stats(runs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "success")
    total = F.count(F.lit(1))
    return runs.agg(
        total.alias("total_runs"), done.alias("successful_runs"),
        F.count_if(F.col("status") == "error").alias("failed_runs"),
        F.round(F.when(total > 0, done * 100.0 / F.nullif(total, F.lit(0))).otherwise(0.0), 6)
        .alias("success_percent"))


def overview(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Total, of the last 24 hours, and not acknowledged."""
    day_ago = F.unix_seconds(as_of) - 86_400
    recent = F.coalesce(F.unix_seconds("ts") >= day_ago, F.lit(False))
    return alerts.select("acknowledged", recent.alias("_recent")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_recent").alias("last_24h"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"))


def counts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def type_label(threat_type: Column) -> Column:
    return F.initcap(F.translate(threat_type, "_", " "))


def counts_by_type(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy("threat_type").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", type_label(F.col("threat_type"))))


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return (newest_first(runs, "run_id").limit(n)
            .withColumn("duration_seconds", F.round("duration_seconds", 2)))


def _mentions(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def search_alerts(alerts: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring over description, recommendation, addresses and paths."""
    return alerts.filter(
        _mentions(F.col("description"), needle) | _mentions(F.col("recommendation"), needle)
        | F.exists("source_ips", lambda ip: _mentions(ip, needle))
        | F.exists("target_paths", lambda p: _mentions(p, needle)))


GRAM = 3
#: Grams of a needle whose postings are read: the rarest ones.
GRAMS_READ = 4


def _grams(value: Column) -> Column:
    value = F.lower(value)
    last = F.length(value) - GRAM + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(value, i, F.lit(GRAM)))
                  ).otherwise(F.array().cast("array<string>"))


def postings(alerts: DataFrame) -> DataFrame:
    """(gram, alert_id): which alerts have three characters in a row in one of their searched texts."""
    texts = F.filter(F.concat(F.array("description", "recommendation"), F.coalesce(
        "source_ips", F.array()), F.coalesce("target_paths", F.array())), lambda t: t.isNotNull())
    return alerts.select("alert_id", F.explode(F.array_distinct(F.flatten(
        F.transform(texts, _grams)))).alias("gram")).select("gram", "alert_id")


def write_postings(alerts: DataFrame, path: str) -> None:
    """Stores the postings in the order of grams, so that a search opens few row groups."""
    (postings(alerts).repartitionByRange("gram", "alert_id").sortWithinPartitions("gram", "alert_id")
     .write.option("parquet.bloom.filter.enabled#gram", "true").mode("append").parquet(path))


def search_indexed(alerts: DataFrame, index: DataFrame, needle: str) -> DataFrame:
    """`search_alerts` by stored postings: only alerts that have the needle's rarest grams are read
    in full and compared. A needle of fewer than three characters has no gram, so all are."""
    low = needle.lower()
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return search_alerts(alerts, needle)
    # At most one row per gram of the needle; grams that no alert has end the search at once.
    found = index.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    if len(found) < len(grams):
        return alerts.limit(0)
    rare = [r.gram for r in sorted(found, key=lambda r: (r.n, r.gram))[:GRAMS_READ]]
    hits = (index.filter(F.col("gram").isin(rare)).groupBy("alert_id").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == len(rare)).select("alert_id"))
    return search_alerts(alerts.join(hits, "alert_id", "left_semi"), needle)


def search_runs(runs: DataFrame, needle: str, status: str | None = None,
                since: Column | None = None) -> DataFrame:
    found = runs.filter(_mentions(F.col("error_message"), needle))
    if status:
        found = found.filter(F.col("status") == status)
    return found if since is None else found.filter(F.col("ts") >= since)


def acknowledge(alerts: DataFrame, selected: DataFrame, by: str, at: Column) -> DataFrame:
    """All alerts, with those listed in `selected` (`alert_id`) marked as acknowledged."""
    marks = selected.select("alert_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return (alerts.join(marks, "alert_id", "left")
            .withColumn("acknowledged", hit | F.col("acknowledged"))
            .withColumn("acknowledged_at", F.when(hit, at).otherwise(F.col("acknowledged_at")))
            .withColumn("acknowledged_by", F.when(hit, F.lit(by)).otherwise(
                F.col("acknowledged_by")))
            .drop("_hit").select(*alerts.columns))


def is_generic(item: Column) -> Column:
    """Evidence that only restates a request count."""
    return (F.contains(item, F.lit("Request ")) & F.contains(item, F.lit(" from "))
            & (F.contains(item, F.lit("total from same IP")) | F.contains(item, F.lit("..."))))


def substantive_evidence(items: Column) -> Column:
    """The items, or an empty array when every one of them is generic."""
    return F.when(F.exists(items, lambda i: ~is_generic(i)), items).otherwise(
        F.array().cast("array<string>"))


def _shown(items: Column, n: int) -> Column:
    return F.concat(F.array_join(F.slice(items, 1, n), ", "),
                    F.when(F.size(items) > n, F.lit(" ...")).otherwise(F.lit("")))


def report_rows(alerts: DataFrame, evidence_json: str = "evidence") -> DataFrame:
    """Short report of every alert: a few addresses, paths, references and samples.

    `evidence` is JSON text in either form: an object with references and sample logs, or a
    plain list of texts.
    """
    raw = F.trim(F.col(evidence_json))
    is_list = F.startswith(raw, F.lit("["))
    new = F.from_json(raw, "STRUCT<llm_evidence: ARRAY<STRING>, "
                           "sample_logs: ARRAY<STRUCT<raw_line: STRING, timestamp: STRING, "
                           "ip: STRING, method: STRING, path: STRING, status: STRING>>>")
    old = F.from_json(raw, "ARRAY<STRING>")
    none = F.array().cast("array<string>")
    missing = F.lit("N/A")
    samples = F.when(is_list, old).otherwise(F.transform(new["sample_logs"], lambda s: F.coalesce(
        s["raw_line"], F.concat_ws(
            " | ", F.coalesce(s["timestamp"], missing), F.coalesce(s["ip"], missing),
            F.concat_ws(" ", F.coalesce(s["method"], missing), F.coalesce(s["path"], missing)),
            F.concat(F.lit("Status: "), F.coalesce(s["status"], missing))))))
    refs = F.when(~is_list, new["llm_evidence"])
    refs = F.when(refs == F.array(F.lit("No evidence provided")), none).otherwise(refs)
    read = alerts.withColumn("_refs", F.coalesce(refs, none)).withColumn(
        "_samples", F.coalesce(samples, none))
    lines = F.transform(F.slice("_samples", 1, 5), lambda s: F.substring(s, 1, 150))
    return read.select(
        "alert_id", type_label(F.col("threat_type")).alias("label"),
        F.initcap("severity").alias("severity"),
        F.round(F.col("confidence") * 100, 2).alias("confidence_percent"), "acknowledged",
        _shown(F.col("source_ips"), 5).alias("source_ips"),
        _shown(F.col("target_paths"), 3).alias("target_paths"),
        F.coalesce("description", missing).alias("description"),
        F.coalesce("recommendation", missing).alias("recommendation"),
        F.array_join(F.slice("_refs", 1, 3), "\n").alias("evidence_refs"),
        F.array_join(lines, "\n").alias("sample_lines"),
        F.size("_samples").cast("bigint").alias("samples"),
        F.greatest(F.size("_samples") - 5, F.lit(0)).cast("bigint").alias("more_samples"), "notes")
