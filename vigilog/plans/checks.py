"""The SQL twin of every registered query that SQL can express."""

from __future__ import annotations

from vigilog.functions.text import SUSPICIOUS_QUERY
from vigilog.operators.retrieval import SCAN_PRESETS
from vigilog.plans import oracle as o

ORACLE: dict[str, str] = {}


def check(name: str, body: str) -> None:
    ORACLE[name] = o.sql(body)


# --- sources and stored tables
_SEGMENT = "line_number // 2000"
check("scan_log_lines", f"""SELECT {_SEGMENT} AS segment, row_number() OVER (
  PARTITION BY {_SEGMENT} ORDER BY line_number) AS line_number, value FROM log""")
check("scan_tail_n", "SELECT line_number, value FROM log ORDER BY line_number DESC LIMIT 100")
check("scan_tail_files", f"""SELECT {_SEGMENT} AS segment, row_number() OVER (
  PARTITION BY {_SEGMENT} ORDER BY line_number DESC) AS from_end, value FROM log QUALIFY from_end <= 100""")
check("stream_log_lines", f"SELECT {_SEGMENT} AS segment, value FROM log")
_FILES = "(SELECT max(line_number) // 2000 + 8 FROM log)"
check("stream_follow", f"""SELECT line_number % {_FILES} AS file, value FROM log
  WHERE line_number > (SELECT max(line_number) // 2 FROM log)""")
check("sink_individual_logs", """SELECT id, ts, line_number, client_ip, status_code, path, method,
  document, CAST(64 AS INTEGER) AS dim FROM log_ids""")
check("sink_group_summaries",
      "SELECT id, ts, batch_id, group_id, log_count, document FROM group_docs")
check("sink_analysis_summaries", """SELECT concat('access.log#analysis_batch_', batch_id) AS id, ts,
  batch_id, threats_found, document FROM analysis_docs""")
check("sink_chunks", """SELECT chunk_id, start_time, end_time, log_count, unique_ips, status_codes,
  methods, document FROM chunk_table""")
check("lookup_chunk_by_id",
      "SELECT chunk_id, log_count, document FROM chunk_table WHERE chunk_id = '4xx_3'")
check("collection_counts", """SELECT 'individual_logs' AS collection, count(*) AS n FROM kept
  UNION ALL SELECT 'group_summaries', count(*) FROM group_stats
  UNION ALL SELECT 'analysis_summaries', count(*) FROM batch_stats
  UNION ALL SELECT 'chunks', count(*) FROM chunk_table""")
check("ttl_expire", "SELECT id, ts FROM log_ids WHERE ts >= (SELECT max(ts) FROM kept) - 1800")
check("expire_chunks_before", """SELECT chunk_id, end_time FROM chunk_table
  WHERE end_time >= (SELECT as_of FROM newest_chunk) - 1800""")
check("truncate_collections", "SELECT chunk_id, log_count FROM chunk_table WHERE false")
_HINTS = "['nodeviewcount', 'updateCounter', 'analytics', 'api/tracking', 'api/metrics']"
check("inspect_samples", f"""SELECT collection, total, sample, id,
  concat(left(document, 400), CASE WHEN length(document) > 400 THEN '...' ELSE '' END) AS preview,
  array_to_string(list_filter({_HINTS}, lambda h: contains(lower(document), lower(h))), ',') AS hints
  FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY id) AS sample,
    count(*) OVER (PARTITION BY collection) AS total FROM (
    SELECT 'individual_logs' AS collection, id, document FROM log_ids
    UNION ALL SELECT 'group_summaries', id, document FROM group_docs
    UNION ALL SELECT 'analysis_summaries', concat('access.log#analysis_batch_', batch_id), document FROM analysis_docs
    UNION ALL SELECT 'chunks', chunk_id, document FROM chunk_table)) WHERE sample <= 5""")
_RUNS = """SELECT concat('access.log#', s.batch_id) AS run_id, max_ts AS ts, CAST(s.n AS INTEGER) AS logs_analyzed,
  CAST(threats AS INTEGER) AS threats_found, {} 'success' AS status, {} 'rules' AS model_used, {}
  FROM batch_stats s JOIN (SELECT batch_id, count(*) AS threats, max(confidence) AS top_confidence,
    count(*) FILTER (severity = 'critical') AS critical FROM batch_threats GROUP BY 1) t USING (batch_id)"""
check("sink_alerts_and_runs", _RUNS.format(
    "min_ts AS time_window_start, max_ts AS time_window_end,", "'' AS error_message,",
    "threats AS alerts"))

# --- parsing and text
check("parse_clf", """SELECT line_number, raw_line, ts, tz_offset, client_ip, method, path, query_string,
  protocol, status_code, bytes_sent, referer, user_agent, remote_user FROM parsed""")
check("parse_errors", """SELECT line_number, value, CASE WHEN trim(value) = '' THEN 'blank'
  WHEN line_number NOT IN (SELECT line_number FROM matched) THEN 'format' ELSE 'timestamp' END AS reason
  FROM log WHERE line_number NOT IN (SELECT line_number FROM parsed)""")
check("detect_format", """SELECT source, matching, sampled, matching * 10 >= sampled * 8 AS is_clf FROM (
  SELECT concat('part-', line_number // 1000) AS source,
    count(*) FILTER (line_number IN (SELECT line_number FROM matched)) AS matching,
    count(*) FILTER (trim(value) <> '') AS sampled FROM log WHERE line_number % 1000 < 10 GROUP BY 1)""")
check("entry_to_text", "SELECT line_number, text FROM entry_texts")
check("entry_to_json", """SELECT line_number, CAST(to_json({'timestamp': iso, 'raw_line': raw_line,
  'line_number': line_number, 'client_ip': client_ip, 'method': method, 'path': path,
  'query_string': query_string, 'protocol': protocol, 'status_code': status_code,
  'bytes_sent': bytes_sent, 'referer': referer, 'user_agent': user_agent,
  'remote_user': remote_user}) AS VARCHAR) AS json FROM parsed""")
check("sentencify", "SELECT line_number, document FROM sentences")
check("simplify_user_agent", "SELECT line_number, agent FROM parsed")
check("referrer_path", f"SELECT page_id, {o._REF.format('url')} AS path FROM pages")
check("suspicious_query", f"""SELECT line_number, {o.any_of('query_string', SUSPICIOUS_QUERY)}
  AS suspicious FROM parsed""")
check("cidr_block", """SELECT line_number, cidr, CASE WHEN len(string_split(client_ip, '.')) >= 3
  THEN array_to_string(string_split(client_ip, '.')[1:3], '.') ELSE client_ip END AS prefix FROM parsed""")
check("status_class", f"""SELECT line_number, {o._GROUP} AS group_id, {o._CATEGORY} AS category
  FROM parsed""")

# --- filters
check("filter_static_assets", f"SELECT line_number FROM parsed WHERE NOT {o.STATIC}")
check("filter_paths", f"SELECT line_number FROM parsed WHERE NOT {o.BAD_PATH}")
check("filter_methods", """SELECT line_number FROM parsed
  WHERE coalesce(upper(method), '') NOT IN ('HEAD', 'OPTIONS', 'POST')""")
check("filter_method_override", f"SELECT line_number, {o.OVERRIDE} AS is_override FROM parsed")
check("filter_status", f"SELECT line_number FROM parsed WHERE NOT {o.BAD_STATUS}")
check("filter_user_agents", f"SELECT line_number FROM parsed WHERE NOT {o.BAD_AGENT}")
check("filter_combined", "SELECT line_number FROM kept")
check("filter_reasons", f"""SELECT CASE WHEN {o.STATIC} THEN 'static_asset' WHEN {o.BAD_PATH} THEN 'path'
  WHEN {o.BAD_STATUS} AND NOT {o.OVERRIDE} THEN 'status' WHEN {o.BAD_AGENT} THEN 'user_agent'
  ELSE 'kept' END AS drop_reason, count(*) AS n FROM parsed GROUP BY 1""")
check("filter_recommended_preset", f"""SELECT line_number, status_code, method FROM kept
  WHERE {o.OVERRIDE} OR NOT {o.BAD_STATUS}""")

# --- numbering, chunks, batches
check("number_rows", "SELECT line_number, row_number() OVER (ORDER BY line_number) - 1 AS rn FROM kept")
check("chunk_membership_join", """SELECT line_number, window_start,
  CAST(window_index AS BIGINT) AS window_index FROM windowed""")
check("chunk_fixed_size", f"""SELECT chunk_id, arg_min(ts, pos) AS start_time, arg_max(ts, pos) AS end_time,
  count(*) AS log_count, string_agg(text, {o.NL} ORDER BY pos) AS document FROM fixed GROUP BY chunk_id""")
_TIME_ID = """concat('time_', window_index, '_', strftime(make_timestamp(window_start * 1000000),
  '%Y-%m-%dT%H:%M:%S'), '+00:00')"""
check("chunk_time_window", f"""SELECT w.chunk_id, start_time, end_time, log_count, unique_ip_count, status_codes, methods
  FROM (SELECT {_TIME_ID} AS chunk_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS log_count,
    count(DISTINCT client_ip) AS unique_ip_count FROM windowed GROUP BY 1) w
  LEFT JOIN ({o.counts(f'(SELECT *, {_TIME_ID} AS chunk_id FROM windowed)', 'CAST(status_code AS VARCHAR)', 'status_codes')}) USING (chunk_id)
  LEFT JOIN ({o.counts(f'(SELECT *, {_TIME_ID} AS chunk_id FROM windowed)', "nullif(method, '')", 'methods')}) USING (chunk_id)""")
check("chunk_time_window_documents", f"""SELECT chunk_id, pos // 100 AS part, string_agg(text, {o.NL} ORDER BY pos) AS document
  FROM (SELECT {_TIME_ID} AS chunk_id, text, row_number() OVER (
    PARTITION BY window_index ORDER BY w.ts, w.line_number) - 1 AS pos
  FROM windowed w JOIN (SELECT line_number, text FROM entry_texts) USING (line_number)) GROUP BY ALL""")
check("chunk_intelligent", "SELECT line_number, category, chunk_id FROM intelligent")
check("chunk_profile", """SELECT chunk_id, start_time, end_time, start_time_iso, end_time_iso, log_count,
  unique_ips, status_codes, methods, document, CAST(raw_chars AS BIGINT) AS raw_chars FROM chunk_table
  JOIN (SELECT chunk_id, sum(length(CAST(to_json({'timestamp': iso, 'raw_line': raw_line,
  'line_number': line_number, 'client_ip': client_ip, 'method': method, 'path': path,
  'query_string': query_string, 'protocol': protocol, 'status_code': status_code,
  'bytes_sent': bytes_sent, 'referer': referer, 'user_agent': user_agent,
  'remote_user': remote_user}) AS VARCHAR))) + 2 * count(*) AS raw_chars FROM intelligent GROUP BY 1)
  USING (chunk_id)""")
check("batch_by_count", "SELECT line_number, batch_id FROM batched")
check("group_batch", "SELECT batch_id, group_id, n FROM group_stats")

# --- aggregations
check("group_basic_stats", """SELECT batch_id, group_id, n, min_ts, max_ts, duration_s,
  CASE WHEN duration_s > 1 THEN round(n / duration_s, 6) END AS rate FROM group_stats""")
for _name in ("top_ips", "top_paths", "methods", "status_codes", "user_agents"):
    check(f"group_{_name}", f"SELECT batch_id, group_id, rank, value, n FROM g_{_name}")
check("group_suspicious_flags",
      "SELECT batch_id, group_id, suspicious_query, auth_failures FROM group_stats")
check("group_summary_text", "SELECT batch_id, group_id, summary_text FROM group_text")
check("analysis_summary_stats", """SELECT batch_id, n, min_ts, max_ts, unique_ips, top_ips, top_status,
  top_paths FROM batch_stats""")
check("analysis_summary_text", "SELECT batch_id, threats_found, document FROM analysis_docs")
check("threat_type_counts",
      "SELECT batch_id, type, count(*) AS n FROM batch_threats GROUP BY 1, 2")
check("chunk_set_time_window",
      "SELECT min(start_time) AS window_start, max(end_time) AS window_end FROM chunk_table")
check("token_estimate", r"""SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'),
  lambda w: w <> '')) * 1.3) AS INTEGER) AS tokens FROM documents""")
check("batch_top_ips_paths", """SELECT batch_id, i.l AS known_ips, p.l AS known_paths FROM (
  SELECT batch_id, string_agg(value, ',' ORDER BY rank) AS l FROM b_known_ips GROUP BY 1) i
  JOIN (SELECT batch_id, string_agg(value, ',' ORDER BY rank) AS l FROM b_known_paths GROUP BY 1) p
  USING (batch_id)""")

# --- ordering, duplicates
check("sort_by_time", """SELECT line_number, row_number() OVER (ORDER BY ts, line_number) - 1 AS position
  FROM parsed""")
check("latest_alerts", """SELECT alert_id, ts, threat_type, severity,
  (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 5""")
check("dedup_first_by_id", f"""SELECT chunk_id, strategy, rank FROM (
  SELECT chunk_id, CAST(substr(query_id, 2) AS INTEGER) AS strategy, rank FROM ({o.by_meaning(20, None)}))
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY strategy, rank) = 1""")
check("dedup_text", """SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, document, distance FROM (
  SELECT * FROM (SELECT id, document, distance FROM group_distances JOIN group_docs USING (id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 50)
  QUALIFY row_number() OVER (PARTITION BY document ORDER BY distance, id) = 1)
  QUALIFY rank <= 100""")

# --- vectors and retrieval
check("embed_texts", f"""SELECT doc_id, bucket, round(CAST(w AS DOUBLE), 6) AS w
  FROM ({o.embedded('documents', 'doc_id', 'text')})""")
check("embed_chunks", "SELECT chunk_id, bucket, round(CAST(w AS DOUBLE), 6) AS w FROM chunk_vectors")
_CENTROIDS = """SELECT label, list(x ORDER BY i) AS v FROM (
  SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY 1, 2) GROUP BY 1"""


def _nearest(k: int) -> str:
    return f"""SELECT * FROM (SELECT CAST(label AS VARCHAR) AS query_id, row_number() OVER (
      PARTITION BY label ORDER BY distance, id) AS rank, id, distance FROM (
      SELECT c.label, e.vec_id AS id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 6) AS distance
      FROM embeddings e CROSS JOIN ({_CENTROIDS}) c)) WHERE rank <= {k}"""


check("cosine_topk", _nearest(10))
check("topk_vectors", _nearest(3))


def _top(distances: str, docs: str, k: int, where: str = "") -> str:
    return f"""SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id
      ORDER BY distance, id) AS rank, id, distance FROM {distances} {where}) WHERE rank <= {k}"""


check("semantic_query_join", _top("log_distances", "log_ids", 20))
check("vector_time_filter", _top("log_distances", "log_ids", 20, """WHERE id IN (
  SELECT id FROM log_ids WHERE ts >= (SELECT max(ts) FROM kept) - 1800)"""))
check("retrieve_recent_context", "SELECT batch_id, kind, rank, id, document, distance FROM context")
check("retrieve_time_window", f"""SELECT chunk_id, start_time, end_time FROM chunk_table
  WHERE {o.recent(1)} ORDER BY start_time DESC, chunk_id LIMIT 100""")
check("retrieve_semantic", f"SELECT query_id, rank, chunk_id, distance FROM ({o.by_meaning(50, 1)})")
check("retrieve_anomalies", f"SELECT chunk_id, strategy, rank FROM ({o.anomalies(50, 1)})")


def _combined(hours, n: int) -> str:
    return f"""SELECT chunk_id, strategy, hit_rank AS rank, start_time FROM ({o.combined(hours, n)})"""


check("retrieve_combined", _combined(1, 100))
check("retrieve_combined_all_time", _combined(None, 100))
check("union_strategies", f"""SELECT chunk_id, CAST(substr(query_id, 2) AS INTEGER) AS strategy, rank
  FROM ({o.by_meaning(5, 1)}) UNION ALL SELECT chunk_id, strategy + 1000, rank FROM ({o.anomalies(33, 1)})""")
check("threat_queries_match", f"""SELECT query_id, rank, doc_id AS id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM (
  {o.distances('documents', 'doc_id', '(' + o.embedded('documents', 'doc_id', 'text') + ')', 'threat_vectors')}))
  WHERE rank <= 5""")
check("scan_presets", " UNION ALL ".join(
    f"SELECT '{name}' AS preset, * FROM ({_combined(hours, n)})"
    for name, (hours, n) in SCAN_PRESETS.items()))


# --- detection
def _sections(hours, n: int) -> str:
    codes = """concat('{', array_to_string(list_transform(string_split(codes, ','),
      lambda p: concat('"', string_split(p, ':')[1], '": ', string_split(p, ':')[2])), ', '), '}')"""
    return f"""SELECT count(*) AS chunks, min(start_time) AS window_start, max(end_time) AS window_end,
      string_agg(concat({o.NL}, '--- Chunk ', r, ' ---', {o.NL}, 'Time: ', start_time, ' to ', end_time, {o.NL},
      'Log Count: ', log_count, {o.NL}, 'Unique IPs: ', unique_ip_count, {o.NL}, 'Status Codes: ', {codes},
      {o.NL}, {o.NL}, 'Logs:', {o.NL}, document), {o.NL} ORDER BY r) AS sections FROM (
      SELECT *, row_number() OVER (ORDER BY start_time DESC, strategy, hit_rank) AS r FROM ({o.combined(hours, n)}))
      JOIN (SELECT chunk_id, string_agg(v || ':' || n, ',' ORDER BY first) AS codes FROM (
        SELECT chunk_id, status_code AS v, count(*) AS n, min(pos) AS first FROM intelligent GROUP BY 1, 2) GROUP BY 1)
      USING (chunk_id)"""


check("chunk_prompt", f"SELECT chunks, sections FROM ({_sections(1, 30)})")
o.CTES["window_entries"] = f"""SELECT 0 AS batch_id, e.* FROM intelligent e
  WHERE chunk_id IN (SELECT chunk_id FROM ({o.combined(1, 100)}))"""
o.CTES["window_findings"] = " UNION ALL ".join(
    f"SELECT threat_type, n, lim FROM ({o.rule(k, 'batch_id', 'window_entries', o.BATCH_LOW)})" for k in o.KINDS)
check("analyze_window", f"""SELECT chunks AS chunks_analyzed, window_start, window_end,
  'Analysis complete.' AS summary, 'success' AS status, 'rules' AS model_used,
  (SELECT count(*) FROM window_findings) AS threats,
  (SELECT count(*) FROM (SELECT {o._SEVERITY} AS severity FROM window_findings) WHERE severity = 'critical') AS critical,
  length(sections) AS prompt_chars FROM ({_sections(1, 100)})""")


def _part(kind: str, limit: int, title: str) -> str:
    return f"""CASE WHEN count(*) FILTER (kind = '{kind}') > 0 THEN concat('[{title}]', {o.NL},
      string_agg(document, {o.NL} || {o.NL} ORDER BY rank) FILTER (kind = '{kind}' AND rank <= {limit})) END"""


_SECTIONS = f"""SELECT batch_id, concat_ws({o.NL} || {o.NL}, a, g, s,
    concat('[this batch: ', n, ' lines]', {o.NL}, raw)) AS sections FROM (
  SELECT batch_id, count(*) AS n, string_agg(raw_line, {o.NL} ORDER BY ts, line_number) AS raw FROM batched GROUP BY 1)
  LEFT JOIN (SELECT batch_id,
    {_part('individual_logs', 10, 'entries before this batch')} AS a,
    {_part('grouped_summaries', 5, 'groups before this batch')} AS g,
    {_part('analysis_summaries', 3, 'what earlier batches showed')} AS s
    FROM context GROUP BY 1) USING (batch_id)"""
check("context_prompt", _SECTIONS)
check("score_batches", f"""SELECT batch_id, 'ok' AS status,
  CASE WHEN contains(sections, '../') THEN 'found' ELSE 'Analysis complete.' END AS summary,
  CASE WHEN contains(sections, '../') THEN 1 ELSE 0 END AS threats FROM ({_SECTIONS})""")
check("rule_threats", o.findings(o.KINDS, "parsed"))
for _name, _kind in (("brute_force", "brute_force"), ("ddos", "ddos"),
                     ("sql_injection", "sql_injection"), ("path_traversal", "path_traversal"),
                     ("recon", "reconnaissance"), ("bot", "bot")):
    check(f"threat_{_name}", o.findings((_kind,), "parsed"))
check("parse_threat_json", """SELECT event_id, CASE event_id % 8 WHEN 3 THEN 'unexpected' WHEN 4 THEN 'invalid'
    WHEN 5 THEN 'invalid' ELSE 'ok' END AS status,
  CASE event_id % 8 WHEN 0 THEN concat('s', event_id) WHEN 3 THEN 'Parse failed (unexpected format).'
    WHEN 4 THEN 'Parse failed (invalid JSON).' WHEN 5 THEN 'Parse failed (invalid JSON).'
    WHEN 7 THEN 'none' ELSE 'Analysis complete.' END AS summary,
  CAST(CASE event_id % 8 WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS BIGINT) AS threats FROM events""")
check("normalize_threat", """
  SELECT event_id, CAST(1 AS BIGINT) AS threat_no, 'ddos' AS threat_type, 'medium' AS severity, CAST(0.9 AS DOUBLE) AS confidence,
    '' AS description, '' AS recommendation FROM events WHERE event_id % 8 = 0
  UNION ALL SELECT event_id, 1, 'other', 'medium', 0.5, concat('[bot_activity] d', user_id), '' FROM events WHERE event_id % 8 = 2
  UNION ALL SELECT event_id, 1, 'sql_injection', 'low', 0.5, '', '' FROM events WHERE event_id % 8 = 6
  UNION ALL SELECT event_id, 2, 'other', 'medium', 0.5, concat('[scan_', event_id % 3, '] '), '' FROM events WHERE event_id % 8 = 6""")
check("threat_evidence_join", "SELECT batch_id, threat_no, sample_no, line_number FROM samples")
check("build_evidence", """SELECT batch_id, threat_no, type AS threat_type, severity, confidence, description,
  recommendation, derived_ips AS source_ips, derived_paths AS target_paths, samples, first_line FROM evidence""")
check("analyze_batches", _RUNS.format("", "", "top_confidence, critical"))
check("stream_analyze", _RUNS.format("", "", "top_confidence, critical"))

# --- alert analytics
check("alerts_with_run", """SELECT alert_id, run_id, r.ts AS run_ts, status AS run_status,
  threats_found AS run_threats_found FROM alerts a JOIN runs r USING (run_id)""")
check("alerts_filtered", """SELECT alert_id, a.ts, severity, threat_type, run_id, status AS run_status
  FROM alerts a JOIN runs r USING (run_id) WHERE severity = 'high' AND threat_type = 'bot' AND NOT acknowledged""")
check("alert_detail", """SELECT alert_id, a.ts, severity, description, run_id, status AS run_status, r.ts AS run_ts
  FROM alerts a JOIN runs r USING (run_id) WHERE alert_id = (SELECT max(alert_id) FROM alerts)""")
check("run_stats", """SELECT count(*) AS total_runs, count(*) FILTER (status = 'success') AS successful_runs,
  count(*) FILTER (status = 'error') AS failed_runs,
  round(count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*), 6) AS success_percent FROM runs""")
check("alert_overview", """SELECT count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM alerts) - 1800) AS last_24h,
  count(*) FILTER (NOT acknowledged) AS unacknowledged FROM alerts""")
check("alerts_by_severity", "SELECT severity, count(*) AS n FROM alerts GROUP BY 1")
check("alerts_by_type", """SELECT threat_type, count(*) AS n, array_to_string(list_transform(
  string_split(threat_type, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS label FROM alerts GROUP BY 1""")
check("recent_runs", """SELECT run_id, ts, status, round(duration_seconds, 2) AS duration_seconds
  FROM runs ORDER BY ts DESC, run_id DESC LIMIT 10""")
check("alerts_search", """SELECT alert_id FROM alerts WHERE contains(lower(description), 'user 1')
  OR contains(lower(recommendation), 'user 1') OR contains(lower(array_to_string(source_ips, ' ')), 'user 1')
  OR contains(lower(array_to_string(target_paths, ' ')), 'user 1')""")
check("alerts_search_indexed", """SELECT alert_id FROM alerts WHERE contains(lower(description), 'user 1')
  OR contains(lower(recommendation), 'user 1') OR contains(lower(array_to_string(source_ips, ' ')), 'user 1')
  OR contains(lower(array_to_string(target_paths, ' ')), 'user 1')""")
check("sketch_top_paths", """SELECT hour, path AS value, count(*) AS n FROM (SELECT CAST(ts // 3600 * 3600 AS BIGINT) AS hour, path,
    count(*) OVER (PARTITION BY ts // 3600) AS total FROM kept)
  WHERE path <> '' GROUP BY hour, path, total HAVING count(*) * 1000 >= total""")
check("sketch_addresses", """SELECT CAST(ts // 3600 * 3600 AS BIGINT) AS hour, count(*) AS n,
  count(DISTINCT nullif(client_ip, '')) AS exact, true AS within FROM kept GROUP BY 1""")
check("runs_search", """SELECT run_id, error_message FROM runs
  WHERE contains(lower(error_message), 'timeout') AND status = 'error'""")
check("acknowledge_alerts", """SELECT alert_id, acknowledged OR severity = 'critical' AS acknowledged,
  CASE WHEN severity = 'critical' THEN CAST(1704153600 AS BIGINT) END AS acknowledged_at,
  CASE WHEN severity = 'critical' THEN 'operator' ELSE acknowledged_by END AS acknowledged_by FROM alerts""")
check("substantive_evidence", f"""SELECT alert_id, CASE WHEN len(list_filter(refs, lambda i: NOT ({o._GENERIC}))) > 0
  THEN array_to_string(refs, ';') ELSE '' END AS shown FROM refs""")


def _shown(column: str, n: int) -> str:
    return (f"concat(array_to_string({column}[1:{n}], ', '), "
            f"CASE WHEN len({column}) > {n} THEN ' ...' ELSE '' END)")


check("alert_report_rows", f"""SELECT alert_id, label, severity, confidence_percent, acknowledged, source_ips,
  target_paths, description, recommendation, evidence_refs,
  array_to_string(list_transform(items[1:5], lambda s: left(s, 150)), {o.NL}) AS sample_lines,
  CAST(len(items) AS BIGINT) AS samples, CAST(greatest(len(items) - 5, 0) AS BIGINT) AS more_samples FROM (
  SELECT alert_id, array_to_string(list_transform(string_split(threat_type, '_'),
      lambda w: concat(upper(w[1]), w[2:])), ' ') AS label,
    concat(upper(severity[1]), severity[2:]) AS severity, round(confidence * 100, 2) AS confidence_percent,
    acknowledged, {_shown('source_ips', 5)} AS source_ips, {_shown('target_paths', 3)} AS target_paths,
    description, recommendation,
    CASE WHEN alert_id % 2 = 0 THEN array_to_string(refs[1:3], {o.NL}) ELSE '' END AS evidence_refs,
    CASE WHEN alert_id % 2 = 0 THEN list_transform(target_paths, lambda p: concat('GET ', p, repeat('x', 160)))
      ELSE source_ips END AS items FROM alerts JOIN refs USING (alert_id))""")

# --- streaming
check("stream_ingest", "SELECT id, line_number, document FROM log_ids")
check("stream_count_batches", "SELECT batch_id, line_number FROM batched")
check("stream_dedup", "SELECT concat('access.log#', line_number) AS id, ts FROM kept")
check("stream_ttl", "SELECT id, ts FROM log_ids WHERE ts >= (SELECT max(ts) FROM kept) - 1800")
check("stream_group_stats", f"""SELECT CAST(ts // 300 * 300 AS BIGINT) AS window_start, group_id, count(*) AS n,
  count(*) FILTER (status_code IN (401, 403)) AS auth_failures
  FROM (SELECT *, {o._GROUP} AS group_id FROM kept)
  WHERE ts // 300 * 300 + 300 <= (SELECT max(ts) FROM kept) - 600 GROUP BY 1, 2""")
check("stream_group_stats_all", f"""SELECT CAST(ts // 300 * 300 AS BIGINT) AS window_start, group_id, count(*) AS n,
  count(*) FILTER (status_code IN (401, 403)) AS auth_failures,
  ts // 300 * 300 + 300 > (SELECT max(ts) FROM kept) - 600 AS open
  FROM (SELECT *, {o._GROUP} AS group_id FROM kept) GROUP BY ALL""")
check("stream_late_data", """SELECT line_number, coalesce(ts < max(newest) OVER (
    ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600, false) AS late FROM (
  SELECT line_number, ts, part, max(ts) OVER (PARTITION BY part) AS newest FROM (
    SELECT line_number, ts, line_number // ((SELECT max(line_number) FROM log) // 4 + 1) AS part FROM kept))""")
