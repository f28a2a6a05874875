"""Raw lines to access-log entries, and the parser registry."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions import clf
from vigilog.schema import ACCESS_LOG


class LogParser(Protocol):
    """What a log format supplies; all methods map DataFrames to DataFrames."""

    format_name: str

    def parse(self, lines: DataFrame) -> DataFrame: ...

    def rejects(self, lines: DataFrame) -> DataFrame: ...

    def detect(self, lines: DataFrame) -> DataFrame: ...


class ClfParser:
    """Common Log Format and its Combined extension."""

    format_name = "Common Log Format (CLF/Combined)"

    def parse(self, lines: DataFrame) -> DataFrame:
        """One row per parsable line; lines that do not parse are left out."""
        return self._entries(lines).to(ACCESS_LOG)

    def _split(self, lines: DataFrame) -> DataFrame:
        raw = lines.withColumn("raw_line", clf.strip(F.col("value")))
        return raw.withColumn("_f", clf.fields(F.col("raw_line")))

    def _entries(self, lines: DataFrame) -> DataFrame:
        f = F.col("_f")
        # Parts used several times become columns of their own step, computed once per line.
        split = self._split(lines).select(
            "source", "line_number", "raw_line", "_f",
            F.split(clf.field(f, "request"), " ", 3).alias("_request"),
            clf.instant(clf.field(f, "date")).alias("_ts"),
            clf.zone(clf.field(f, "date")).alias("_zone"))
        method, target = F.get("_request", F.lit(0)), F.get("_request", F.lit(1))
        entry = F.struct(
            F.col("_ts").alias("ts"),
            clf.offset(F.col("_zone")).alias("tz_offset"),
            clf.field(f, "host").alias("client_ip"),
            F.when(clf.field(f, "request") != "", method).alias("method"),
            F.substring_index(target, "?", 1).alias("path"),
            F.when(F.contains(target, F.lit("?")),
                   F.substr(target, F.instr(target, "?") + 1)).alias("query_string"),
            F.get("_request", F.lit(2)).alias("protocol"),
            clf.field(f, "status").cast("int").alias("status_code"),
            F.when(clf.field(f, "bytes") != "-", clf.field(f, "bytes").try_cast("bigint"))
            .alias("bytes_sent"),
            clf.dash_to_null(clf.field(f, "referer")).alias("referer"),
            clf.dash_to_null(clf.field(f, "agent")).alias("user_agent"),
            F.when(clf.field(f, "user") != "-", clf.field(f, "user")).alias("remote_user"),
        )
        # A generator keeps later filters above this point: pushed below it they would
        # repeat the regex once per parsed column they mention.
        parsed = F.when((F.size(f) == len(clf.FIELDS)) & F.col("_ts").isNotNull(), F.array(entry))
        return split.select("source", "line_number", "raw_line", F.inline(parsed))

    def rejects(self, lines: DataFrame) -> DataFrame:
        """Lines `parse` leaves out, with the reason."""
        f = F.col("_f")
        reason = (F.when(F.col("raw_line") == "", F.lit("blank"))
                  .when(F.coalesce(F.size(f) != len(clf.FIELDS), F.lit(True)), F.lit("format"))
                  .when(clf.instant(clf.field(f, "date")).isNull(), F.lit("timestamp")))
        return (self._split(lines).withColumn("reason", reason)
                .filter(F.col("reason").isNotNull())
                .select("source", "line_number", "value", "reason"))

    def detect(self, lines: DataFrame) -> DataFrame:
        """Per source: do at least 80 % of the non-blank lines among the first ten match?"""
        line = clf.strip(F.col("value"))
        head = lines.filter(F.col("line_number") <= 10)
        return (head.groupBy("source")
                .agg(F.count_if(clf.matches(line)).alias("matching"),
                     F.count_if(line != "").alias("sampled"))
                .withColumn("is_clf", F.col("matching") * 10 >= F.col("sampled") * 8))


PARSERS: dict[str, LogParser] = {"clf": ClfParser(), "combined": ClfParser()}


def register_parser(name: str, parser: LogParser) -> None:
    PARSERS[name] = parser


def parse_log(lines: DataFrame, log_format: str = "clf") -> DataFrame:
    if log_format not in PARSERS:
        raise ValueError(f"unknown log format: {log_format}")
    return PARSERS[log_format].parse(lines)


def parse_errors(lines: DataFrame, log_format: str = "clf") -> DataFrame:
    return PARSERS[log_format].rejects(lines)
