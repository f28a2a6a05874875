"""Model replies to typed threats, normalisation, and evidence from the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions import text
from vigilog.operators.batching import BATCH
from vigilog.schema import EVIDENCE, THREAT, THREAT_TYPES

MAX_SAMPLES = 15


def read_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Adds `status`, `summary` and `threats` (array of JSON texts) to every reply.

    An object with `threats` is taken as it is; a list keeps its objects with a type; other
    JSON is `unexpected`, anything else `invalid`. Each threat stays JSON text until it is
    exploded, so one malformed item does not void its neighbours.
    """
    body = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", ""))
    valid = F.try_parse_json(body).isNotNull()
    is_list = F.startswith(body, F.lit("["))
    has_threats = F.coalesce(F.array_contains(F.json_object_keys(body), "threats"), F.lit(False))
    reply = F.from_json(body, "STRUCT<threats: ARRAY<STRING>, summary: STRING>")
    none = F.array().cast("array<string>")
    typed = F.filter(F.from_json(body, "ARRAY<STRING>"), lambda item: (
        F.startswith(item, F.lit("{"))
        & (F.coalesce(F.get_json_object(item, "$.type"), F.lit("")) != "")))
    status = (F.when(~valid, F.lit("invalid")).when(is_list, F.lit("ok"))
              .when(has_threats, F.lit("ok")).otherwise(F.lit("unexpected")))
    done = F.lit("Analysis complete.")
    return (replies.withColumn("status", status)
            .withColumn("summary", F.when(F.col("status") == "invalid",
                                          F.lit("Parse failed (invalid JSON)."))
                        .when(F.col("status") == "unexpected",
                              F.lit("Parse failed (unexpected format)."))
                        .when(is_list, done).otherwise(F.coalesce(reply["summary"], done)))
            .withColumn("threats", F.when(F.col("status") != "ok", none)
                        .otherwise(F.coalesce(F.when(is_list, typed).otherwise(reply["threats"]),
                                              none))))


def reply_threats(read: DataFrame, keys: list[str]) -> DataFrame:
    """One row per threat of every reply, numbered from 1 in reply order."""
    items = read.select(*keys, F.posexplode("threats").alias("_at", "_item"))
    lists = [f.name for f in THREAT if isinstance(f.dataType, T.ArrayType)]
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.name in lists else f.dataType)
                          for f in THREAT])

    def listed(value: Column) -> Column:
        """A list, or a list of the one text that stands in its place."""
        return F.when(F.startswith(value, F.lit("[")), F.coalesce(
            F.from_json(value, "ARRAY<STRING>"), F.array(value))).when(
            value.isNotNull(), F.array(value))

    return (items.withColumn("t", F.from_json("_item", loose))
            .select(*keys, (F.col("_at") + 1).alias("threat_no"), *[
                (listed(F.col("t")[f.name]) if f.name in lists else F.col("t")[f.name])
                .alias(f.name) for f in THREAT]))


def normalize(threats: DataFrame, alias_bot: bool = False) -> DataFrame:
    """Adds `threat_type` (one of the known types) and fills in the defaults.

    An unknown type becomes `other` and is kept as a prefix of the description.
    """
    raw = F.lower(F.coalesce(text.filled(F.col("type")), F.lit("other")))
    raw = F.translate(raw, " -", "__")
    if alias_bot:
        raw = F.when(raw == "bot_activity", F.lit("bot")).otherwise(raw)
    known = raw.isin(*THREAT_TYPES)
    described = F.coalesce("description", F.lit(""))
    return (threats
            .withColumn("threat_type", F.when(known, raw).otherwise(F.lit("other")))
            .withColumn("description", F.when(known, described).otherwise(
                F.concat(F.lit("["), raw, F.lit("] "), described)))
            .withColumn("severity", F.coalesce("severity", F.lit("medium")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
            .withColumn("recommendation", F.coalesce("recommendation", F.lit(""))))


def is_evidence(source_ips: Column, target_paths: Column) -> Column:
    """Does an entry support a threat: by address, else by path, else if it names neither."""
    ips = F.coalesce(F.size(source_ips), F.lit(0)) > 0
    paths = F.coalesce(F.size(target_paths), F.lit(0)) > 0
    ip_hit = F.coalesce(F.array_contains(source_ips, F.col("client_ip")), F.lit(False))
    path_hit = F.exists(target_paths, lambda p: F.contains(F.col("path"), p))
    return (F.when(ips & ip_hit, F.lit(True))
            .when(paths, F.coalesce((F.col("path") != "") & path_hit, F.lit(False)))
            .otherwise(~ips))


def evidence_entries(threats: DataFrame, batched: DataFrame) -> DataFrame:
    """`(batch, threat_no, sample_no, entry…)`: the first 15 supporting entries by time.

    An equi-join on the batch with the match as its residual condition: a threat meets only
    the entries of its own batch (50 by default).
    """
    wanted = threats.select(*BATCH, "threat_no", F.col("source_ips").alias("_ips"),
                            F.col("target_paths").alias("_paths"))
    hits = batched.join(wanted, BATCH).filter(is_evidence(F.col("_ips"), F.col("_paths")))
    order = Window.partitionBy(*BATCH, "threat_no").orderBy("ts", "line_number")
    return (hits.withColumn("sample_no", F.row_number().over(order))
            .filter(F.col("sample_no") <= MAX_SAMPLES).drop("_ips", "_paths"))


def with_evidence(threats: DataFrame, batched: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds the `evidence` struct; addresses and paths always come from the log.

    If nothing matched, the most frequent addresses and paths of the batch stand in.
    """
    sample = F.struct(
        text.iso_time(F.col("ts"), F.col("tz_offset")).alias("timestamp"),
        F.col("client_ip").alias("ip"), "method", "path", F.col("status_code").alias("status"),
        F.coalesce(F.substring("user_agent", 1, 100), F.lit("")).alias("user_agent"),
        F.coalesce("referer", F.lit("")).alias("referer"), "raw_line")
    samples = (evidence_entries(threats, batched)
               .groupBy(*BATCH, "threat_no")
               .agg(F.array_sort(F.collect_list(F.struct("sample_no", sample.alias("s"))))
                    .alias("_samples"),
                    F.array_sort(F.collect_set(text.filled(F.col("client_ip")))).alias("_ips"),
                    F.array_sort(F.collect_set(text.filled(F.trim("path")))).alias("_paths")))
    fallback = profile.select(
        *BATCH, F.transform("known_ips", lambda i: i["value"]).alias("_batch_ips"),
        F.transform("known_paths", lambda i: i["value"]).alias("_batch_paths"))
    empty = F.array().cast("array<string>")

    def first_filled(found: str, instead: str) -> Column:
        return F.when(F.size(found) > 0, F.col(found)).otherwise(F.coalesce(instead, empty))

    joined = (threats.join(samples, [*BATCH, "threat_no"], "left")
              .join(fallback, BATCH, "left"))
    evidence = F.struct(
        F.coalesce("evidence", empty).alias("llm_evidence"),
        F.coalesce(F.transform("_samples", lambda s: s["s"]), F.array()).alias("sample_logs"),
        first_filled("_ips", "_batch_ips").alias("derived_source_ips"),
        first_filled("_paths", "_batch_paths").alias("derived_target_paths"))
    return (joined.withColumn("evidence", evidence.cast(EVIDENCE))
            .drop("_samples", "_ips", "_paths", "_batch_ips", "_batch_paths"))
