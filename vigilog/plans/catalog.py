"""One registered query per operator: `(spark, sf_dir) -> DataFrame`.

All of them read the given tables; the log is the synthetic one derived from `events`.
Times are returned as epoch seconds and arrays as joined text, so that results compare
across engines.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.config import EngineConfig
from vigilog.functions import text
from vigilog.functions.embedding import with_embedding
from vigilog.operators import (alerts, batching, chunking, filtering, parsing, profiles, prompts,
                               retrieval, rules, sketches, threats, vectors)
from vigilog.operators.batching import BATCH, GROUP
from vigilog.plans import analysis
from vigilog.plans.oracle import BATCH_LOW, LOW
from vigilog.session import configure, materialize, scratch_root
from vigilog.sources import follow, logs, numbering, tables
from vigilog.streaming import analyzer, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BATCH_LIMITS = rules.Thresholds(**BATCH_LOW)
ONCE = {"availableNow": True}


def query(run: Query) -> Query:
    """Register a query under its function's name."""
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    QUERIES[run.__name__] = configured
    return configured


# --- inputs shared by the queries -----------------------------------------------------------------

_STAGES: dict[tuple, object] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """An intermediate several queries read, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def lines(spark, d):
    return logs.synthetic_lines(spark, d)


def entries(spark, d):
    return parsing.parse_log(logs.synthetic_lines(spark, d, 2 * spark.sparkContext.defaultParallelism))


def kept(spark, d):
    return filtering.keep_entries(entries(spark, d))


def batched(spark, d):
    return batching.assign_batches(kept(spark, d))


def grouped(spark, d):
    return batching.group_entries(batched(spark, d))


def summaries(spark, d):
    return batching.summarize_groups(grouped(spark, d))


def chunks(spark, d):
    """The stored chunk table: traffic-kind chunks of 20 entries with vectors."""
    return stage(spark, d, "chunks", lambda: materialize(tables.chunk_rows(
        chunking.chunk_profile(chunking.intelligent(entries(spark, d)))), "chunks"))


def analysed(spark, d) -> analysis.Analysis:
    return stage(spark, d, "analysis", lambda: analysis.analyze_batches(
        kept(spark, d), limits=BATCH_LIMITS))


def secs(name: str) -> Column:
    return F.unix_seconds(name).alias(name.split(".")[-1])


def joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


def pairs(name: str) -> Column:
    """`key:count` text of a map, ordered by key."""
    items = F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat(
        e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))))
    return F.array_join(items, ",").alias(name)


def newest(entry_table: DataFrame, name: str = "ts") -> Column:
    return entry_table.agg(F.max(name)).scalar()


# --- sources and stored tables ------------------------------------------------------------------------

LINES_PER_SEGMENT = 2000


def segments(spark, d) -> str:
    """The log as rotated text files of 2,000 lines each; returns their folder."""
    def write() -> str:
        path = f"{scratch_root(spark)}/segments-{uuid.uuid4().hex}"
        number = F.floor(F.col("line_number") / LINES_PER_SEGMENT)
        (lines(spark, d).withColumn("segment", number).repartition("segment")
         .sortWithinPartitions("segment", "line_number").select("segment", "value")
         .write.partitionBy("segment").text(path))
        return path

    return stage(spark, d, "segments", write)


def segment_of(source: Column) -> Column:
    return F.regexp_extract(source, r"segment=(\d+)", 1).cast("bigint").alias("segment")


def store(spark) -> tables.TableStore:
    return tables.TableStore(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")


@query
def scan_log_lines(spark, d):
    found = logs.scan_lines(spark, segments(spark, d))
    return found.select(segment_of(F.col("source")), "line_number", "value")


@query
def scan_tail_n(spark, d):
    return logs.tail(lines(spark, d), 100).select("line_number", "value")


@query
def scan_tail_files(spark, d):
    """The last 100 lines of every file, read from the files' ends."""
    found = logs.scan_tail(spark, segments(spark, d), 100)
    return found.select(segment_of(F.col("source")), "from_end", "value")


@query
def stream_log_lines(spark, d):
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    found = logs.stream_lines(spark, segments(spark, d))
    jobs.write_parquet(found, f"{root}/out", f"{root}/state", ONCE).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out").select(
        segment_of(F.col("source")), "value")


GROWING = 8


def _grow(rows: DataFrame, folder: str) -> None:
    """Appends (file, at, n, piece) to growing files, each file by one task: its pieces in the order of
    `n` go behind its first `at` bytes, whatever a lost attempt has left there."""
    def write(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with open(f"{folder}/{r['file']}.log", "r+b" if r["at"] else "wb") as f:
                    f.seek(r["at"])
                    f.truncate()
                    f.write("".join(x["piece"] for x in r["pieces"]).encode())
            yield batch.select(["file"])

    pieces = rows.groupBy("file").agg(F.max("at").alias("at"), F.array_sort(F.collect_list(
        F.struct("n", "piece"))).alias("pieces"))
    pieces.mapInArrow(write, "file BIGINT").count()


@query
def stream_follow(spark, d):
    """Growing files followed from their end: half of the log and half of the next line are there when
    the stream starts, the rest is appended while it runs. Every later line arrives once, and whole."""
    root = f"{scratch_root(spark)}/follow-{uuid.uuid4().hex}"
    folder = f"{root}/in".removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    numbered = lines(spark, d)
    # Files of about 2,000 lines: what is gathered for one is bounded, and their number grows.
    last = numbered.agg(F.max("line_number")).first()[0]
    files, half = last // LINES_PER_SEGMENT + GROWING, last // 2
    n = F.col("line_number")
    rows = numbered.select((n % files).alias("file"), n.alias("n"), F.concat("value", F.lit("\n")).alias("line"))
    begun = F.col("n").between(half + 1, half + files)             # each file's first new line
    cut = F.floor(F.length("line") / 2).cast("int")
    old = rows.where(F.col("n") <= half + files).select("file", "n", F.lit(0).cast("bigint").alias("at"), F.when(
        begun, F.left("line", cut)).otherwise(F.col("line")).alias("piece"))
    _grow(old, folder)
    query = jobs.write_parquet(follow.follow_lines(spark, folder, range_bytes=100_000), f"{root}/out",
                               f"{root}/state")
    try:
        query.processAllAvailable()
        at = old.groupBy("file").agg(F.sum(F.octet_length("piece")).cast("bigint").alias("at"))
        _grow(rows.where(F.col("n") > half).join(at, "file").select("file", "n", "at", F.when(
            begun, F.substr("line", cut + 1)).otherwise(F.col("line")).alias("piece")), folder)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("source STRING, value STRING").parquet(f"{root}/out").select(
        F.regexp_extract("source", r"(\d+)\.log$", 1).cast("bigint").alias("file"), "value")


@query
def sink_individual_logs(spark, d):
    target = store(spark)
    target.append("individual_logs", tables.individual_rows(kept(spark, d)))
    return target.read("individual_logs").select(
        "id", secs("ts"), "line_number", "client_ip", "status_code", "path", "method", "document",
        F.size("embedding").alias("dim"))


@query
def sink_group_summaries(spark, d):
    target = store(spark)
    target.append("group_summaries", analysed(spark, d).group_summaries)
    return target.read("group_summaries").select(
        "id", secs("ts"), "batch_id", "group_id", "log_count", "document")


@query
def sink_analysis_summaries(spark, d):
    target = store(spark)
    target.append("analysis_summaries", analysed(spark, d).analysis_summaries)
    return target.read("analysis_summaries").select(
        "id", secs("ts"), "batch_id", "threats_found", "document")


@query
def sink_chunks(spark, d):
    target = store(spark)
    target.append("chunks", chunks(spark, d))
    target.append_new("chunks", chunks(spark, d))
    return target.read("chunks").select(
        "chunk_id", secs("start_time"), secs("end_time"), "log_count", joined("unique_ips"),
        pairs("status_codes"), pairs("methods"), "document")


@query
def lookup_chunk_by_id(spark, d):
    target = stage(spark, d, "chunk_store", lambda: _chunk_store(spark, d))
    return target.get("chunks", "4xx_3").select("chunk_id", "log_count", "document")


def _chunk_store(spark, d):
    target = store(spark)
    target.append("chunks", chunks(spark, d))
    return target


def collections(spark, d) -> dict[str, DataFrame]:
    done = analysed(spark, d)
    return {"individual_logs": done.individual_logs, "group_summaries": done.group_summaries,
            "analysis_summaries": done.analysis_summaries, "chunks": chunks(spark, d)}


@query
def collection_counts(spark, d):
    return tables.collection_counts(collections(spark, d))


@query
def ttl_expire(spark, d):
    target = store(spark)
    target.append("individual_logs", analysed(spark, d).individual_logs)
    since = tables.cutoff(newest(target.read("individual_logs")), timedelta(minutes=30))
    target.expire("individual_logs", since)
    return target.read("individual_logs", since).select("id", secs("ts"))


@query
def expire_chunks_before(spark, d):
    target = _chunk_store(spark, d)
    since = tables.cutoff(retrieval.latest(target.read("chunks")), timedelta(minutes=30))
    target.expire("chunks", since)
    return target.read("chunks", since).select("chunk_id", secs("end_time"))


@query
def truncate_collections(spark, d):
    target = _chunk_store(spark, d)
    target.truncate("chunks")
    return target.read("chunks").select("chunk_id", "log_count")


@query
def inspect_samples(spark, d):
    return tables.inspect_samples(collections(spark, d)).withColumn("hints", joined("hints"))


@query
def sink_alerts_and_runs(spark, d):
    target, done = store(spark), analysed(spark, d)
    target.append_new("analysis_runs", done.runs)
    target.append_new("threat_alerts", done.alerts)
    counts = target.read("threat_alerts").groupBy("run_id").agg(F.count(F.lit(1)).alias("alerts"))
    return target.read("analysis_runs").join(counts, "run_id").select(
        "run_id", secs("ts"), "logs_analyzed", "threats_found", secs("time_window_start"),
        secs("time_window_end"), "status", "error_message", "model_used", "alerts")


# --- parsing and text ---------------------------------------------------------------------------------

@query
def parse_clf(spark, d):
    return entries(spark, d).withColumn("ts", F.unix_seconds("ts")).drop("source")


@query
def parse_errors(spark, d):
    return parsing.parse_errors(lines(spark, d)).drop("source")


@query
def detect_format(spark, d):
    part = lines(spark, d).select(
        F.concat(F.lit("part-"), F.floor(F.col("line_number") / 1000)).alias("source"),
        (F.col("line_number") % 1000 + 1).alias("line_number"), "value")
    return parsing.PARSERS["clf"].detect(part)


@query
def entry_to_text(spark, d):
    return entries(spark, d).select("line_number", text.entry_text().alias("text"))


@query
def entry_to_json(spark, d):
    return entries(spark, d).select("line_number", text.entry_json().alias("json"))


@query
def sentencify(spark, d):
    return entries(spark, d).select("line_number", text.sentence().alias("document"))


@query
def simplify_user_agent(spark, d):
    return entries(spark, d).select(
        "line_number", text.simple_agent(F.col("user_agent")).alias("agent"))


@query
def referrer_path(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", text.referrer_path(F.col("url")).alias("path"))


@query
def suspicious_query(spark, d):
    return entries(spark, d).select(
        "line_number", text.suspicious_query(F.col("query_string")).alias("suspicious"))


@query
def cidr_block(spark, d):
    ip = F.col("client_ip")
    return entries(spark, d).select("line_number", text.cidr_block(ip).alias("cidr"),
                                    text.cidr_prefix(ip).alias("prefix"))


@query
def status_class(spark, d):
    status, ip = F.col("status_code"), F.col("client_ip")
    return entries(spark, d).select("line_number", text.batch_group(status, ip).alias("group_id"),
                                    text.chunk_category(status, ip).alias("category"))


# --- filters ---------------------------------------------------------------------------------------------

_METHODS_OUT = replace(EngineConfig(), excluded_methods="head, options, post")


def _passing(spark, d, dropped: Column) -> DataFrame:
    return entries(spark, d).filter(~dropped).select("line_number")


@query
def filter_static_assets(spark, d):
    return _passing(spark, d, filtering.is_static(EngineConfig()))


@query
def filter_paths(spark, d):
    return _passing(spark, d, filtering.is_excluded_path(EngineConfig()))


@query
def filter_methods(spark, d):
    return _passing(spark, d, filtering.is_excluded_method(_METHODS_OUT))


@query
def filter_method_override(spark, d):
    return entries(spark, d).select(
        "line_number", filtering.is_override_method(EngineConfig()).alias("is_override"))


@query
def filter_status(spark, d):
    return _passing(spark, d, filtering.is_excluded_status(EngineConfig.recommended()))


@query
def filter_user_agents(spark, d):
    return _passing(spark, d, filtering.is_excluded_agent(EngineConfig()))


@query
def filter_combined(spark, d):
    return kept(spark, d).select("line_number")


@query
def filter_reasons(spark, d):
    return filtering.reason_counts(entries(spark, d), EngineConfig.recommended())


@query
def filter_recommended_preset(spark, d):
    return filtering.keep_entries(entries(spark, d), EngineConfig.recommended()).select(
        "line_number", "status_code", "method")


# --- numbering, chunks, batches -----------------------------------------------------------------------------

@query
def number_rows(spark, d):
    return numbering.rank_lines(kept(spark, d), "rn").select("line_number", "rn")


@query
def chunk_membership_join(spark, d):
    return chunking.time_window(entries(spark, d)).select(
        "line_number", "window_start", "window_index")


@query
def chunk_fixed_size(spark, d):
    return chunking.chunk_profile(chunking.fixed_size(entries(spark, d))).select(
        "chunk_id", secs("start_time"), secs("end_time"), "log_count", "document")


@query
def chunk_time_window(spark, d):
    return chunking.window_profile(chunking.time_window(entries(spark, d))).select(
        "chunk_id", secs("start_time"), secs("end_time"), "log_count", "unique_ip_count",
        pairs("status_codes"), pairs("methods"))


@query
def chunk_time_window_documents(spark, d):
    return chunking.window_documents(chunking.time_window(entries(spark, d)), 100).drop("source")


@query
def chunk_intelligent(spark, d):
    return chunking.intelligent(entries(spark, d)).select("line_number", "category", "chunk_id")


@query
def chunk_profile(spark, d):
    return chunking.chunk_profile(chunking.intelligent(entries(spark, d))).select(
        "chunk_id", secs("start_time"), secs("end_time"), "start_time_iso", "end_time_iso",
        "log_count", joined("unique_ips"), pairs("status_codes"), pairs("methods"), "document",
        F.length("raw_logs").cast("bigint").alias("raw_chars"))


@query
def batch_by_count(spark, d):
    return batched(spark, d).select("line_number", "batch_id")


@query
def group_batch(spark, d):
    return grouped(spark, d).groupBy("batch_id", "group_id").agg(F.count(F.lit(1)).alias("n"))


# --- aggregations ---------------------------------------------------------------------------------------------

@query
def group_basic_stats(spark, d):
    return batching.group_stats(grouped(spark, d)).select(
        "batch_id", "group_id", "n", F.unix_seconds("first.ts").alias("min_ts"),
        F.unix_seconds("last.ts").alias("max_ts"), "duration_s", F.round("rate", 6).alias("rate"))


def _group_top(name: str) -> Query:
    def run(spark, d):
        value, k = batching.summary_lists()[name]
        return profiles.top_values(grouped(spark, d), GROUP, value, k).drop("source")

    run.__name__ = f"group_{name}"
    return query(run)


for _name in ("top_ips", "top_paths", "methods", "status_codes", "user_agents"):
    _group_top(_name)


@query
def group_suspicious_flags(spark, d):
    return grouped(spark, d).groupBy("batch_id", "group_id").agg(
        F.bool_or(text.group_suspicious_query(F.col("query_string"))).alias("suspicious_query"),
        F.count_if(F.col("status_code").isin(401, 403)).alias("auth_failures"))


@query
def group_summary_text(spark, d):
    return summaries(spark, d).select("batch_id", "group_id", "summary_text")


@query
def analysis_summary_stats(spark, d):
    found = batching.batch_profile(batched(spark, d))
    return found.select(
        "batch_id", "n", F.unix_seconds("first.ts").alias("min_ts"),
        F.unix_seconds("last_entry.ts").alias("max_ts"),
        F.col("distinct_top_ips").alias("unique_ips"),
        *[profiles.render_top(F.col(c)).alias(c) for c in ("top_ips", "top_status", "top_paths")])


@query
def analysis_summary_text(spark, d):
    rows = batched(spark, d)
    found = batching.analysis_summary(
        batching.batch_profile(rows), analysis.rule_findings(rows, BATCH_LIMITS))
    return found.select("batch_id", "threats_found", "document")


@query
def threat_type_counts(spark, d):
    return analysis.rule_findings(batched(spark, d), BATCH_LIMITS).groupBy("batch_id", "type").agg(
        F.count(F.lit(1)).alias("n"))


@query
def chunk_set_time_window(spark, d):
    found = chunking.chunk_profile(chunking.intelligent(entries(spark, d)))
    times = F.explode(F.array("start_time_iso", "end_time_iso"))
    moment = F.try_to_timestamp("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss[XXX]"))
    return (found.select(times.alias("iso"))
            .agg(F.unix_seconds(F.min(moment)).alias("window_start"),
                 F.unix_seconds(F.max(moment)).alias("window_end")))


@query
def token_estimate(spark, d):
    documents = spark.read.parquet(f"{d}/documents.parquet")
    return documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def batch_top_ips_paths(spark, d):
    found = batching.batch_profile(batched(spark, d))
    return found.select("batch_id", *[F.array_join(F.transform(c, lambda i: i["value"]), ",")
                                      .alias(c) for c in ("known_ips", "known_paths")])


# --- ordering, duplicates ------------------------------------------------------------------------------------------

@query
def sort_by_time(spark, d):
    return numbering.rank_by_time(entries(spark, d), ["source"], "position").select(
        "line_number", "position")


def alert_table(spark, d) -> DataFrame:
    """One alert per error event."""
    return spark.sql(f"""
      SELECT event_id AS alert_id, event_id div 50 AS run_id, user_id,
        timestamp_seconds(1704067200 + (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000)
                          div 600000000) AS ts,
        element_at(array('brute_force', 'ddos', 'sql_injection', 'path_traversal',
          'reconnaissance', 'bot', 'other'), CAST(event_id % 7 AS INT) + 1) AS threat_type,
        element_at(array('critical', 'high', 'medium', 'low', 'info'),
          CAST(event_id % 5 AS INT) + 1) AS severity,
        CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
        concat('Finding ', event_id, ' by user ', user_id) AS description,
        concat('Block user ', user_id % 10) AS recommendation,
        slice(transform(sequence(0, 7), i -> concat('10.0.', i, '.', user_id % 250)),
          1, CAST(event_id % 8 AS INT)) AS source_ips,
        slice(transform(sequence(0, 4), i -> concat('/p', i, '/', user_id % 20)),
          1, CAST(event_id % 5 AS INT)) AS target_paths,
        slice(transform(sequence(0, 3), i -> CASE WHEN (event_id + i) % 3 = 0
          THEN concat('Request ', i, ' from ', user_id, ' ...') ELSE concat('Odd path ', i) END),
          1, CAST(event_id % 4 AS INT)) AS refs,
        event_id % 3 = 0 AS acknowledged, '' AS acknowledged_by,
        CAST(NULL AS TIMESTAMP) AS acknowledged_at, '' AS notes
      FROM {{events}} WHERE event_type = 'error'""",
                     events=spark.read.parquet(f"{d}/events.parquet"))


def run_table(spark, d) -> DataFrame:
    failed = F.col("run_id") % 10 == 0
    return alert_table(spark, d).groupBy("run_id").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("threats_found")).select(
        "run_id", "ts", "threats_found", F.lit("rules").alias("model_used"),
        F.lit(50).alias("logs_analyzed"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.concat(F.lit("Timeout in run "), F.col("run_id").cast("string")))
        .otherwise(F.lit("")).alias("error_message"),
        ((F.col("run_id") % 977).cast("double") / 7).alias("duration_seconds"))


@query
def latest_alerts(spark, d):
    return alerts.latest_alerts(alert_table(spark, d)).select(
        "alert_id", secs("ts"), "threat_type", "severity", "total")


@query
def dedup_first_by_id(spark, d):
    stored = chunks(spark, d)
    hits = retrieval.by_meaning(stored, threat_queries(), 20).withColumn(
        "strategy", F.substring("query_id", 2, 9).cast("int"))
    return retrieval.first_by_id(hits).select("chunk_id", "strategy", "rank")


@query
def dedup_text(spark, d):
    done = analysed(spark, d)
    found = vectors.nearest(done.group_summaries, context_queries(), 50).join(
        done.group_summaries.select("id", "document"), "id").withColumn("all", F.lit(1))
    digest = F.sha2("document", 256)
    return retrieval.distinct_texts(found.withColumn("_text", digest), ["all"], 100).select("rank", "id", "document", "distance")


# --- vectors and retrieval --------------------------------------------------------------------------------------------

def context_queries():
    return retrieval.embed_queries(retrieval.CONTEXT_QUERIES)


def threat_queries():
    return retrieval.embed_queries(retrieval.THREAT_QUERIES)


def _weights(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("embedding").alias("bucket", "w")).filter("w > 0").select(
        key, "bucket", F.round(F.col("w").cast("double"), 6).alias("w"))


@query
def embed_texts(spark, d):
    documents = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return _weights(with_embedding(documents, "text"), "doc_id")


@query
def embed_chunks(spark, d):
    return _weights(chunks(spark, d), "chunk_id")


def corpus(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "id")


def centroids(spark, d):
    """Mean vector of every label, six decimals."""
    found = (corpus(spark, d).select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
             .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                               lambda p: p["x"]).alias("centroid")))
    return found.select(F.col("label").cast("string").alias("query_id"),
                        F.col("centroid").alias("vector"))


@query
def cosine_topk(spark, d):
    return vectors.nearest(corpus(spark, d), centroids(spark, d), 10)


@query
def topk_vectors(spark, d):
    return vectors.nearest(corpus(spark, d), centroids(spark, d), 3)


@query
def cosine_topk_lsh(spark, d):
    indexed = vectors.with_buckets(corpus(spark, d), dim=64)
    return vectors.nearest_hashed(indexed, centroids(spark, d), 10)


@query
def semantic_query_join(spark, d):
    return vectors.nearest(analysed(spark, d).individual_logs, context_queries(), 20)


@query
def vector_time_filter(spark, d):
    rows = analysed(spark, d).individual_logs
    cutoff = F.timestamp_seconds(F.unix_seconds(newest(rows)) - 1800)
    return vectors.nearest(rows.filter(F.col("ts") >= cutoff), context_queries(), 20)


@query
def retrieve_recent_context(spark, d):
    return analysed(spark, d).context.drop("source")


@query
def retrieve_time_window(spark, d):
    stored = chunks(spark, d)
    end = retrieval.latest(stored)
    start = F.timestamp_seconds(F.unix_seconds(end) - 3600)
    return retrieval.in_time_window(stored, start, end, 100).select(
        "chunk_id", secs("start_time"), secs("end_time"))


@query
def retrieve_semantic(spark, d):
    return retrieval.by_meaning(chunks(spark, d), threat_queries(), 50, 1)


@query
def retrieve_anomalies(spark, d):
    return retrieval.anomalies(chunks(spark, d), 50, 1).select("chunk_id", "strategy", "rank")


def _combined(spark, d, hours, n):
    found = retrieval.combined(chunks(spark, d), threat_queries(), hours, n)
    return found.select("chunk_id", "strategy", "rank", secs("start_time"))


@query
def retrieve_combined(spark, d):
    return _combined(spark, d, 1, 100)


@query
def retrieve_combined_all_time(spark, d):
    return _combined(spark, d, None, 100)


@query
def union_strategies(spark, d):
    stored = chunks(spark, d)
    alike = retrieval.by_meaning(stored, threat_queries(), 5, 1).select(
        "chunk_id", F.substring("query_id", 2, 9).cast("int").alias("strategy"), "rank")
    odd = retrieval.anomalies(stored, 33, 1).select(
        "chunk_id", (F.col("strategy") + 1000).alias("strategy"), "rank")
    return alike.unionByName(odd)


@query
def threat_queries_match(spark, d):
    documents = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text")
    return vectors.nearest(with_embedding(documents, "text"), threat_queries(), 5)


@query
def scan_presets(spark, d):
    found = []
    for name, (hours, n) in retrieval.SCAN_PRESETS.items():
        found.append(_combined(spark, d, hours, n).withColumn("preset", F.lit(name)))
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- detection ------------------------------------------------------------------------------------------------------------

@query
def chunk_prompt(spark, d):
    found = analysis.ranked_chunks(retrieval.combined(chunks(spark, d), threat_queries(), 1, 30))
    return prompts.chunk_prompt(found).select("chunks", "sections")


@query
def context_prompt(spark, d):
    return analysed(spark, d).prompts.select("batch_id", "sections")


def rule_scorer():
    """A stand-in model: reports traversal attempts it reads in the prompt."""
    def score(texts: list[str]) -> list[str]:
        hit = '{"threats": [{"type": "path_traversal", "severity": "high"}], "summary": "found"}'
        return [hit if "../" in t else '{"threats": []}' for t in texts]

    return score


@query
def score_batches(spark, d):
    scored = prompts.score_prompts(analysed(spark, d).prompts, rule_scorer, BATCH)
    return threats.read_replies(scored).select(
        "batch_id", "status", "summary", F.size("threats").alias("threats"))


def _rule(name: str, which: tuple[str, ...]) -> Query:
    def run(spark, d):
        found = rules.find_threats(entries(spark, d), rules.Thresholds(**LOW), which)
        return found.drop("source", "detail")

    run.__name__ = name
    return query(run)


_rule("rule_threats", rules.RULES)
for _name, _kind in (("brute_force", "brute_force"), ("ddos", "ddos"),
                     ("sql_injection", "sql_injection"), ("path_traversal", "path_traversal"),
                     ("recon", "reconnaissance"), ("bot", "bot")):
    _rule(f"threat_{_name}", (_kind,))


def replies(spark, d) -> DataFrame:
    """Model replies of every kind, one per event."""
    return spark.sql("""
      SELECT event_id, CASE event_id % 8
        WHEN 0 THEN concat('{{"threats": [{{"type": "ddos", "confidence": 0.9, "source_ips": ["10.0.0.', user_id % 250, '"]}}], "summary": "s', event_id, '"}}')
        WHEN 1 THEN '{{"threats": []}}'
        WHEN 2 THEN concat('[{{"type": "Bot-Activity", "description": "d', user_id, '"}}, {{"x": 1}}, 3]')
        WHEN 3 THEN '{{"a": 1}}'
        WHEN 4 THEN '```json {{"threats": []}} ```'
        WHEN 5 THEN '{{"threats": [{{"type": "brute_force", "severity": "high"'
        WHEN 6 THEN concat('  {{"threats": [{{"type": "SQL Injection", "severity": "low"}}, {{"type": "scan ', event_id % 3, '"}}], "summary": null}}  ')
        ELSE '{{"threats": null, "summary": "none"}}' END AS reply
      FROM {events}""", events=spark.read.parquet(f"{d}/events.parquet"))


@query
def parse_threat_json(spark, d):
    return threats.read_replies(replies(spark, d)).select(
        "event_id", "status", "summary", F.size("threats").cast("bigint").alias("threats"))


@query
def normalize_threat(spark, d):
    read = threats.read_replies(replies(spark, d))
    found = threats.normalize(threats.reply_threats(read, ["event_id"]))
    return found.select("event_id", F.col("threat_no").cast("bigint").alias("threat_no"),
                        "threat_type", "severity", "confidence", "description", "recommendation")


@query
def threat_evidence_join(spark, d):
    rows = batched(spark, d)
    return threats.evidence_entries(analysis.rule_findings(rows, BATCH_LIMITS), rows).select(
        "batch_id", F.col("threat_no").cast("bigint").alias("threat_no"),
        F.col("sample_no").cast("bigint").alias("sample_no"), "line_number")


def _alert_columns(found: DataFrame) -> DataFrame:
    parts = F.split("alert_id", "#")
    return found.select(
        F.get(parts, F.lit(1)).cast("bigint").alias("batch_id"),
        F.get(parts, F.lit(2)).cast("bigint").alias("threat_no"), "threat_type", "severity",
        "confidence", "description", "recommendation", joined("source_ips"),
        joined("target_paths"), F.size("evidence.sample_logs").cast("bigint").alias("samples"),
        F.get("evidence.sample_logs", F.lit(0))["raw_line"].alias("first_line"))


@query
def build_evidence(spark, d):
    rows = batched(spark, d)
    found = analysis.rule_findings(rows, BATCH_LIMITS)
    return _alert_columns(analysis.alert_rows(found, rows, batching.batch_profile(rows)))


@query
def analyze_batches(spark, d):
    done = analysed(spark, d)
    return run_facts(done.alerts, done.runs)


def run_facts(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    by_run = alerts.groupBy("run_id").agg(
        F.max("confidence").alias("top_confidence"),
        F.count_if(F.col("severity") == "critical").alias("critical"))
    return runs.join(by_run, "run_id").select(
        "run_id", secs("ts"), "logs_analyzed", "threats_found", "status", "model_used",
        "top_confidence", "critical")


FILES_PER_HALF = 4


@query
def stream_analyze(spark, d):
    """The continuous analyzer over two text segments, one after the other."""
    root = f"{scratch_root(spark)}/analyzer-{uuid.uuid4().hex}"
    numbered = lines(spark, d)
    half = numbered.agg(F.max("line_number")).first()[0] // 2
    for part, rows in (("a", F.col("line_number") <= half), ("b", F.col("line_number") > half)):
        # Files by range of line number, named in order; a half of the log is one micro-batch.
        (numbered.filter(rows).repartitionByRange(FILES_PER_HALF, "line_number")
         .sortWithinPartitions("line_number").select("value").write.text(f"{root}/in/part={part}"))
    analyzer.run_stream(spark, f"{root}/in/*", f"{root}/out", f"{root}/state", max_files=FILES_PER_HALF,
                        limits=BATCH_LIMITS, trigger=ONCE).awaitTermination()
    return run_facts(analyzer.stored(spark, f"{root}/out", "threat_alerts"),
                     analyzer.stored(spark, f"{root}/out", "analysis_runs"))


@query
def analyze_window(spark, d):
    members = chunking.intelligent(entries(spark, d))
    return analysis.analyze_window(chunks(spark, d), 1, 100, members=members, limits=BATCH_LIMITS).select(
        "chunks_analyzed", secs("window_start"), secs("window_end"), "summary", "status", "model_used",
        F.size("threats").cast("bigint").alias("threats"),
        F.size(F.filter("threats", lambda t: F.get_json_object(t, "$.severity") == "critical"))
        .cast("bigint").alias("critical"),
        F.length("sections").cast("bigint").alias("prompt_chars"))


def panes(spark, d) -> DataFrame:
    """The sketches of every five minutes, as they would be stored."""
    return stage(spark, d, "panes", lambda: materialize(sketches.pane_sketches(kept(spark, d)), "panes"))


@query
def sketch_top_paths(spark, d):
    """Paths with a thousandth of an hour's requests or more, from the merged sketches of its panes."""
    hour = (F.floor(F.col("pane_start") / 3600) * 3600).alias("hour")
    merged = sketches.merge_panes(panes(spark, d).withColumn("hour", hour), ["hour"])
    found = sketches.top_of(merged.withColumnRenamed("n", "all"), ["hour", "all"], "top_paths", 1000)
    return found.filter(F.col("n") * 1000 >= F.col("all")).select("hour", "value", "n")


@query
def sketch_addresses(spark, d):
    """Distinct addresses of an hour from merged sketches: whether they are within five percent (three
    standard errors) of the exact number beside them."""
    hour = (F.floor(F.col("pane_start") / 3600) * 3600).alias("hour")
    found = sketches.addresses_of(sketches.merge_panes(
        panes(spark, d).withColumn("hour", hour), ["hour"]), ["hour"])
    exact = kept(spark, d).groupBy((F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("hour")).agg(
        F.countDistinct(text.filled(F.col("client_ip"))).alias("exact"))
    return found.join(exact, "hour").select("hour", "n", "exact", (
        F.abs(F.col("addresses") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


# --- alert analytics -----------------------------------------------------------------------------------------------------

@query
def alerts_with_run(spark, d):
    return alerts.with_run(alert_table(spark, d), run_table(spark, d)).select(
        "alert_id", "run_id", secs("run_ts"), "run_status", "run_threats_found")


@query
def alerts_filtered(spark, d):
    picked = alerts.select_alerts(alert_table(spark, d), "high", "bot", "no")
    return alerts.newest_first(alerts.with_run(picked, run_table(spark, d)), "alert_id").select(
        "alert_id", secs("ts"), "severity", "threat_type", "run_id", "run_status")


@query
def alert_detail(spark, d):
    table = alert_table(spark, d)
    wanted = table.agg(F.max("alert_id")).scalar()
    return alerts.alert_detail(table, run_table(spark, d), wanted).select(
        "alert_id", secs("ts"), "severity", "description", "run_id", "run_status", secs("run_ts"))


@query
def run_stats(spark, d):
    return alerts.run_stats(run_table(spark, d))


@query
def alert_overview(spark, d):
    table = alert_table(spark, d)
    as_of = F.timestamp_seconds(F.unix_seconds(newest(table)) + 86_400 - 1800)
    return alerts.overview(table, as_of)


@query
def alerts_by_severity(spark, d):
    return alerts.counts_by_severity(alert_table(spark, d))


@query
def alerts_by_type(spark, d):
    return alerts.counts_by_type(alert_table(spark, d))


@query
def recent_runs(spark, d):
    return alerts.recent_runs(run_table(spark, d)).select(
        "run_id", secs("ts"), "status", "duration_seconds")


@query
def alerts_search(spark, d):
    return alerts.search_alerts(alert_table(spark, d), "User 1").select("alert_id")


@query
def alerts_search_indexed(spark, d):
    """The rows of `alerts_search` by stored trigrams."""
    path = f"{scratch_root(spark)}/postings-{uuid.uuid4().hex}"
    table = alert_table(spark, d)
    alerts.write_postings(table, path)
    index = spark.read.schema("gram STRING, alert_id BIGINT").parquet(path)
    return alerts.search_indexed(table, index, "User 1").select("alert_id")


@query
def runs_search(spark, d):
    return alerts.search_runs(run_table(spark, d), "timeout", "error").select(
        "run_id", "error_message")


@query
def acknowledge_alerts(spark, d):
    table = alert_table(spark, d)
    chosen = table.filter(F.col("severity") == "critical").select("alert_id")
    at = F.timestamp_seconds(F.lit(1_704_153_600))
    return alerts.acknowledge(table, chosen, "operator", at).select(
        "alert_id", "acknowledged", secs("acknowledged_at"), "acknowledged_by")


@query
def substantive_evidence(spark, d):
    return alert_table(spark, d).select("alert_id", F.array_join(
        alerts.substantive_evidence(F.col("refs")), ";").alias("shown"))


@query
def alert_report_rows(spark, d):
    samples = F.transform("target_paths", lambda p: F.struct(
        F.concat(F.lit("GET "), p, F.repeat(F.lit("x"), 160)).alias("raw_line")))
    new_form = F.to_json(F.struct(F.col("refs").alias("llm_evidence"), samples.alias("sample_logs")))
    form = F.when(F.col("alert_id") % 2 == 0, new_form).otherwise(F.to_json("source_ips"))
    rows = alert_table(spark, d).withColumn("evidence", form)
    return alerts.report_rows(rows).drop("notes")


# --- streaming ---------------------------------------------------------------------------------------------------------------

#: A segment is one micro-batch however long the log is; its files are read side by side.
FILES_PER_SEGMENT = 8


def raw_segments(spark, d) -> str:
    """The log as four closed Parquet segments, written one after the other in time order."""
    def write() -> str:
        path = f"{scratch_root(spark)}/raw-{uuid.uuid4().hex}"
        numbered = lines(spark, d)
        last = numbered.agg(F.max("line_number")).first()[0]
        step = last // 4 + 1
        for i in range(4):
            (numbered.filter((F.col("line_number") >= i * step)
                             & (F.col("line_number") < (i + 1) * step))
             .repartitionByRange(FILES_PER_SEGMENT, "line_number").write.mode("append").parquet(path))
        return path

    return stage(spark, d, "raw_segments", write)


def live(spark, d) -> DataFrame:
    """Accepted entries arriving segment by segment."""
    source = (spark.readStream.schema(lines(spark, d).schema).option("maxFilesPerTrigger", FILES_PER_SEGMENT)
              .parquet(raw_segments(spark, d)))
    return jobs.accepted(source)


def drain(df: DataFrame, spark) -> DataFrame:
    """Run a stream over everything there is and return what it wrote."""
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    jobs.write_parquet(df, f"{root}/out", f"{root}/state", ONCE).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def ingested(spark, d) -> str:
    root = f"{scratch_root(spark)}/ingest-{uuid.uuid4().hex}"
    jobs.store_individual(live(spark, d), root, f"{root}/state", trigger=ONCE).awaitTermination()
    return root


@query
def stream_ingest(spark, d):
    return jobs.stored_individual(spark, ingested(spark, d)).select("id", "line_number", "document")


@query
def stream_group_stats(spark, d):
    return drain(jobs.recent_stats(live(spark, d)), spark).select(
        secs("window_start"), "group_id", "n", "auth_failures")


@query
def stream_group_stats_all(spark, d):
    """The windows of `stream_group_stats` and those still open when the input ends."""
    root = f"{scratch_root(spark)}/stats-{uuid.uuid4().hex}"
    jobs.keep_stats(jobs.recent_stats(live(spark, d)), f"{root}/out", f"{root}/state",
                    trigger=ONCE).awaitTermination()
    return jobs.all_stats(spark, f"{root}/out").select(
        secs("window_start"), "group_id", "n", "auth_failures", "open")


@query
def stream_count_batches(spark, d):
    root = f"{scratch_root(spark)}/batches-{uuid.uuid4().hex}"
    jobs.flush_batches(live(spark, d), root, f"{root}/state", trigger=ONCE).awaitTermination()
    return jobs.full_batches(spark, root, live(spark, d).schema).select("batch_id", "line_number")


@query
def stream_dedup(spark, d):
    twice = live(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat_ws("#", "source", F.col("line_number").cast("string")).alias("id"), "ts")
    return drain(jobs.unique_rows(twice), spark).select("id", secs("ts"))


@query
def stream_late_data(spark, d):
    root = f"{scratch_root(spark)}/late-{uuid.uuid4().hex}"
    jobs.split_late(live(spark, d), root, f"{root}/state", trigger=ONCE).awaitTermination()
    return jobs.late_split(spark, root, live(spark, d).schema).select("line_number", "late")


@query
def stream_ttl(spark, d):
    root = ingested(spark, d)
    since = tables.cutoff(newest(jobs.stored_individual(spark, root)), timedelta(minutes=30))
    return jobs.stored_individual(spark, root, since).select("id", secs("ts"))
