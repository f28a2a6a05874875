"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _BIG, _INT, _TIME = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
_TEXTS, _VECTOR = T.ArrayType(_TEXT), T.ArrayType(T.FloatType())


def table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_LINES = table(source=_TEXT, line_number=_BIG, value=_TEXT)

ACCESS_LOG = table(
    source=_TEXT, line_number=_BIG, ts=_TIME, tz_offset=_TEXT, client_ip=_TEXT, method=_TEXT,
    path=_TEXT, query_string=_TEXT, protocol=_TEXT, status_code=_INT, bytes_sent=_BIG,
    referer=_TEXT, user_agent=_TEXT, remote_user=_TEXT, raw_line=_TEXT)

# A threat in a model's reply.
THREAT = table(
    type=_TEXT, severity=_TEXT, confidence=T.DoubleType(), description=_TEXT, evidence=_TEXTS,
    recommendation=_TEXT, source_ips=_TEXTS, target_paths=_TEXTS)

INDIVIDUAL_LOGS = table(
    id=_TEXT, ts=_TIME, source=_TEXT, line_number=_BIG, client_ip=_TEXT, status_code=_INT,
    path=_TEXT, method=_TEXT, document=_TEXT, embedding=_VECTOR, ingest_date=T.DateType())
GROUP_SUMMARIES = table(
    id=_TEXT, ts=_TIME, source=_TEXT, batch_id=_BIG, group_id=_TEXT, log_count=_BIG,
    document=_TEXT, embedding=_VECTOR, ingest_date=T.DateType())
ANALYSIS_SUMMARIES = table(
    id=_TEXT, ts=_TIME, source=_TEXT, batch_id=_BIG, threats_found=_BIG, document=_TEXT,
    embedding=_VECTOR, ingest_date=T.DateType())
CHUNKS = table(
    chunk_id=_TEXT, start_time=_TIME, end_time=_TIME, log_count=_BIG, unique_ips=_TEXTS,
    status_codes=T.MapType(_INT, _BIG), methods=T.MapType(_TEXT, _BIG), document=_TEXT,
    embedding=_VECTOR, ingest_date=T.DateType())
SAMPLE_LOG = table(
    timestamp=_TEXT, ip=_TEXT, method=_TEXT, path=_TEXT, status=_INT, user_agent=_TEXT,
    referer=_TEXT, raw_line=_TEXT)
EVIDENCE = table(
    llm_evidence=_TEXTS, sample_logs=T.ArrayType(SAMPLE_LOG), derived_source_ips=_TEXTS,
    derived_target_paths=_TEXTS)
ANALYSIS_RUNS = table(
    run_id=_TEXT, ts=_TIME, logs_analyzed=_INT, time_window_start=_TIME, time_window_end=_TIME,
    threats_found=_INT, duration_seconds=T.DoubleType(), tokens_used=_INT, status=_TEXT,
    error_message=_TEXT, model_used=_TEXT)
THREAT_ALERTS = table(
    alert_id=_TEXT, run_id=_TEXT, ts=_TIME, threat_type=_TEXT, severity=_TEXT,
    confidence=T.DoubleType(), description=_TEXT, evidence=EVIDENCE, recommendation=_TEXT,
    source_ips=_TEXTS, target_paths=_TEXTS, acknowledged=T.BooleanType(), acknowledged_at=_TIME,
    acknowledged_by=_TEXT, notes=_TEXT)

THREAT_TYPES = (
    "brute_force", "ddos", "sql_injection", "path_traversal", "reconnaissance", "bot", "other",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
