"""Rule-based detection of the threat classes, counted in one pass over the entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.config import CRAWLER_AGENTS, split_option
from vigilog.functions import text

RULES = ("brute_force", "ddos", "sql_injection", "path_traversal", "reconnaissance", "bot")

# What the content rules look for in the lower-cased request or agent.
SQL_INJECTION = r"union.*select|' or 1=1|%27|drop|insert|delete|update"
PATH_TRAVERSAL = r"\.\./|\.\.\\|/etc/|/passwd|/shadow|%2e%2e"
SCRIPTED_AGENT = "curl|wget|python|sqlmap|nikto|bot|crawler|spider"


@dataclass(frozen=True)
class Thresholds:
    """Least number of requests (or paths) that makes a finding."""

    brute_force: int = 5
    ddos: int = 100
    sql_injection: int = 1
    path_traversal: int = 1
    missing_pages: int = 10
    failing_paths: int = 10
    bot: int = 1
    window_seconds: int = 300
    scan_window_seconds: int = 600
    allowed_agents: tuple[str, ...] = split_option(CRAWLER_AGENTS)


def severity(n: Column, threshold: Column) -> Column:
    return (F.when(n >= threshold * 10, F.lit("critical")).when(n >= threshold * 5, F.lit("high"))
            .when(n >= threshold * 2, F.lit("medium")).otherwise(F.lit("low")))


def confidence(n: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + n * F.lit(0.05)), 6)


def _facts(limits: Thresholds, rules: tuple[str, ...]) -> Column:
    """What one entry contributes: `(threat_type, subject, detail, sec)` per rule it touches.

    A request counts for its own second and the next one, so the sum per second is the
    number of requests in the two seconds up to it.
    """
    c = F.col
    none = F.lit(None).cast("bigint")
    request = F.lower(F.concat_ws("?", "path", "query_string"))
    agent = F.lower("user_agent")
    error = c("status_code").between(400, 499)
    network = text.cidr_block(c("client_ip"))
    second = F.unix_seconds("ts")
    tests = [
        ("brute_force", c("status_code").isin(401, 403), c("client_ip"), c("path"), none),
        ("ddos", F.lit(True), network, F.lit("now"), second),
        ("ddos", F.lit(True), network, F.lit("before"), second + 1),
        ("sql_injection", request.rlike(SQL_INJECTION), c("client_ip"), F.lit(""), none),
        ("path_traversal", request.rlike(PATH_TRAVERSAL), c("client_ip"), F.lit(""), none),
        ("reconnaissance", error, c("client_ip"), c("path"), none),
        ("bot", agent.rlike(SCRIPTED_AGENT)
         & ~text.contains_any(agent, limits.allowed_agents), c("client_ip"), c("user_agent"), none),
    ]
    facts = [F.when(hit & subject.isNotNull(), F.struct(
        F.lit(rule).alias("threat_type"), subject.alias("subject"),
        detail.alias("detail"), sec.alias("sec")))
        for rule, hit, subject, detail, sec in tests if rule in rules]
    return F.array_compact(F.array(*facts))


def find_threats(entries: DataFrame, limits: Thresholds | None = None,
                 rules: tuple[str, ...] = RULES, scope: list[str] | None = None) -> DataFrame:
    """Findings of every rule per time window, or per `scope` (such as a batch).

    Each entry yields a few facts; they are counted per `(subject, detail, second)` with
    map-side partial sums and folded once more per subject. A single hot address or network
    is spread over its paths, agents and seconds before it meets in one row. Columns: the
    scope (`source`, `window_start` by default), `threat_type`, `client_ip` (the /24 network
    for floods), `severity`, `confidence`, `n`, `sample_path`.
    """
    limits = limits or Thresholds()
    c = F.col
    facts = entries.select(
        *(scope or ["source"]), "ts", "path", c("client_ip").alias("_ip"),
        (c("status_code") == 404).alias("_missing"), F.inline(_facts(limits, rules)))
    keys = scope or ["source", "window_start"]
    if scope is None:
        width = F.when(c("threat_type") == "reconnaissance",
                       F.lit(limits.scan_window_seconds)).otherwise(limits.window_seconds)
        second = F.coalesce("sec", F.unix_seconds("ts"))
        facts = facts.withColumn("window_start", (F.floor(second / width) * width).cast("bigint"))
    is_flood, is_scan = c("threat_type") == "ddos", c("threat_type") == "reconnaissance"
    subject = [*keys, "threat_type", "subject"]
    detail = F.when(is_flood, F.lit("now")).otherwise(c("detail"))
    # Inside a batch the addresses behind a finding are few; a time window has no such bound.
    addresses = [F.collect_set("_ip").alias("_ips")] if scope else []
    counted = (facts.groupBy(*subject, detail.alias("_detail"), "sec")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.count_if("_missing").alias("_missing"),
                    F.count_if(c("detail") == "before").alias("_before"),
                    F.min("path").alias("sample_path"), *addresses)
               .filter(~is_flood | (c("n") > c("_before"))))
    if scope:
        addresses = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ips"))))
                     .alias("source_ips")]
    kept = F.when(c("threat_type").isin("brute_force", "bot"), c("_detail"))
    folded = (counted.groupBy(*subject, kept.alias("detail"))
              .agg(F.sum("n").alias("_sum"), F.max("n").alias("_peak"),
                   F.sum("_missing").alias("_missing"), F.count("_detail").alias("_paths"),
                   F.min("sample_path").alias("sample_path"), *addresses))
    scan_by_pages = c("_missing") >= limits.missing_pages
    n = (F.when(is_flood, c("_peak"))
         .when(is_scan, F.when(scan_by_pages, c("_missing")).otherwise(c("_paths")))
         .otherwise(c("_sum")))
    limit = F.when(is_scan, F.when(scan_by_pages, F.lit(limits.missing_pages))
                   .otherwise(limits.failing_paths))
    for rule in ("brute_force", "ddos", "sql_injection", "path_traversal", "bot"):
        limit = limit.when(c("threat_type") == rule, F.lit(getattr(limits, rule)))
    return (folded.withColumn("n", n).withColumn("_limit", limit)
            .filter(c("n") >= c("_limit"))
            .select(*keys, "threat_type", c("subject").alias("client_ip"),
                    severity(c("n"), c("_limit")).alias("severity"),
                    confidence(c("n")).alias("confidence"), "n",
                    F.when(~is_flood, c("sample_path")).alias("sample_path"), "detail",
                    *(["source_ips"] if scope else [])))
