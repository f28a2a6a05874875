"""The registered queries restated as DuckDB SQL, used to check the Spark results.

A query is a body plus the named subqueries it mentions; `sql` puts the needed ones in
front as common table expressions.
"""

from __future__ import annotations

import re

from vigilog.config import CRAWLER_AGENTS, NOISE_PATHS, STATIC_EXTENSIONS, split_option
from vigilog.functions.clf import CLF
from vigilog.functions.text import GROUP_SUSPICIOUS_QUERY, STATUS_LABELS, SUSPICIOUS_QUERY
from vigilog.operators.retrieval import ANOMALOUS_STATUS, CONTEXT_QUERIES, THREAT_QUERIES
from vigilog.operators.rules import PATH_TRAVERSAL, SCRIPTED_AGENT, SQL_INJECTION
from vigilog.sources.logs import _SYNTHETIC

CTES: dict[str, str] = {}
NL = "chr(10)"
STORED = ("parsed", "kept", "batched", "batch_threats", "log_distances", "group_distances",
          "chunk_table", "chunk_distances", "context")


def sql(body: str) -> str:
    """`body` preceded by every named subquery it needs, directly or through others."""
    order: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in CTES:
            if name not in (*order, inside) and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                need(CTES[name], name)
                order.append(name)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTES[n]})" for n in order) + "\n" + body


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, needles) -> str:
    """Does the lower-cased column contain one of the needles?"""
    tests = " OR ".join(f"contains(lower({column}), {quoted(n)})" for n in needles)
    return f"coalesce({tests}, false)"


# --- the log and its entries ------------------------------------------------------------------

_STAMP = "strftime(make_timestamp(({}) * 1000000), '%d/%b/%Y:%H:%M:%S')"
CTES["log"] = (
    _SYNTHETIC.replace("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)").replace(" div ", " // ")
    .replace("{{events}}", "events").replace("{now}", _STAMP.format("sec"))
    .replace("{west}", _STAMP.format("sec - 25200")).replace("STRING", "VARCHAR"))

CTES["matched"] = f"""
SELECT line_number, value AS raw_line, regexp_extract(value, {quoted(CLF)},
  ['host', 'ident', 'usr', 'dt', 'req', 'status', 'size', 'referer', 'agent']) AS g
FROM log WHERE regexp_matches(value, {quoted(CLF)})"""

_SIMPLE_AGENT = """CASE WHEN user_agent IS NULL THEN NULL ELSE concat(
  CASE WHEN contains(lower(user_agent), 'curl') THEN 'curl'
    WHEN contains(lower(user_agent), 'wget') THEN 'wget'
    WHEN contains(user_agent, 'Python') OR contains(lower(user_agent), 'python-requests') THEN 'Python-requests'
    WHEN regexp_matches(lower(user_agent), 'bot|crawler|spider') THEN 'Bot/Crawler'
    WHEN contains(user_agent, 'Edg') THEN 'Edge'
    WHEN contains(user_agent, 'Chrome') THEN
      CASE WHEN regexp_matches(user_agent, 'Chrome/\\s*\\S') THEN 'Chrome ' || regexp_extract(user_agent, 'Chrome/\\s*([^\\s.]*)', 1) ELSE 'Chrome' END
    WHEN contains(user_agent, 'Firefox') THEN
      CASE WHEN regexp_matches(user_agent, 'Firefox/\\s*\\S') THEN 'Firefox ' || regexp_extract(user_agent, 'Firefox/\\s*([^\\s.]*)', 1) ELSE 'Firefox' END
    WHEN contains(user_agent, 'Safari') THEN 'Safari' ELSE 'Other' END, ' (',
  CASE WHEN contains(user_agent, 'Windows NT 10.0') OR contains(user_agent, 'Windows NT 11.0') THEN 'Windows 10/11'
    WHEN contains(user_agent, 'Windows') THEN 'Windows'
    WHEN contains(user_agent, 'Mac OS X') OR contains(user_agent, 'Macintosh') THEN 'macOS'
    WHEN contains(user_agent, 'Linux') AND NOT contains(user_agent, 'Android') THEN 'Linux'
    WHEN contains(user_agent, 'Android') THEN 'Android'
    WHEN contains(user_agent, 'iPhone') OR contains(user_agent, 'iPad') THEN 'iOS' ELSE 'Unknown' END, ')') END"""

CTES["dated"] = r"""
SELECT *, try_strptime(regexp_extract(g.dt, '^[^ ]+'), '%d/%b/%Y:%H:%M:%S') AS local_ts,
  CASE WHEN regexp_matches(g.dt, ' [+-]\d{4}$')
       THEN concat(substr(right(g.dt, 5), 1, 3), ':', right(g.dt, 2)) END AS tz_offset,
  string_split(g.req, ' ') AS parts
FROM matched"""

CTES["parsed"] = f"""
SELECT *, ts * 1000000000 + line_number AS ord, {_SIMPLE_AGENT} AS agent,
  CASE WHEN len(string_split(client_ip, '.')) = 4
       THEN concat(array_to_string(string_split(client_ip, '.')[1:3], '.'), '.0/24')
       ELSE client_ip END AS cidr
FROM (SELECT line_number, raw_line, CAST(epoch(local_ts) AS BIGINT) - CASE WHEN tz_offset IS NULL THEN 0
    ELSE CAST(concat(left(tz_offset, 1), '1') AS BIGINT)
         * (CAST(tz_offset[2:3] AS BIGINT) * 3600 + CAST(right(tz_offset, 2) AS BIGINT) * 60) END AS ts,
  concat(strftime(local_ts, '%Y-%m-%dT%H:%M:%S'), coalesce(tz_offset, '')) AS iso, tz_offset,
  g.host AS client_ip, CASE WHEN g.req <> '' THEN parts[1] END AS method,
  string_split(parts[2], '?')[1] AS path,
  CASE WHEN contains(parts[2], '?') THEN substr(parts[2], instr(parts[2], '?') + 1) END AS query_string,
  CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:], ' ') END AS protocol,
  CAST(g.status AS INTEGER) AS status_code, TRY_CAST(g.size AS BIGINT) AS bytes_sent,
  CASE WHEN g.referer NOT IN ('', '-') THEN g.referer END AS referer,
  CASE WHEN g.agent NOT IN ('', '-') THEN g.agent END AS user_agent,
  CASE WHEN g.usr <> '-' THEN g.usr END AS remote_user
  FROM dated WHERE local_ts IS NOT NULL)"""

_EXT = "|".join(e[1:] for e in split_option(STATIC_EXTENSIONS))
STATIC = f"coalesce(regexp_matches(lower(path), '\\.({_EXT})$'), false)"
BAD_PATH = any_of("path", split_option(NOISE_PATHS))
BAD_AGENT = any_of("user_agent", split_option(CRAWLER_AGENTS))
OVERRIDE = "coalesce(upper(method) IN ('POST', 'PUT', 'DELETE', 'PATCH'), false)"
BAD_STATUS = "status_code IN (200, 301, 302, 304)"

CTES["kept"] = f"SELECT * FROM parsed WHERE NOT {STATIC} AND NOT {BAD_PATH} AND NOT {BAD_AGENT}"
CTES["batched"] = """
SELECT *, rn // 50 AS batch_id FROM (
  SELECT *, row_number() OVER (ORDER BY line_number) - 1 AS rn, count(*) OVER () AS total FROM kept)
WHERE (rn // 50 + 1) * 50 <= total"""
_GROUP = """CASE WHEN status_code BETWEEN 400 AND 499 THEN '4xx_errors'
  WHEN status_code BETWEEN 500 AND 599 THEN '5xx_errors'
  WHEN status_code = 200 AND client_ip <> '' THEN concat('cidr_', cidr) ELSE 'other_status' END"""
_CATEGORY = """CASE WHEN status_code BETWEEN 400 AND 499 THEN '4xx'
  WHEN status_code BETWEEN 500 AND 599 THEN '5xx'
  WHEN status_code = 200 THEN concat('cidr_', CASE WHEN len(string_split(client_ip, '.')) >= 3
    THEN array_to_string(string_split(client_ip, '.')[1:3], '.') ELSE client_ip END)
  ELSE 'other' END"""
CTES["grouped"] = f"SELECT *, {_GROUP} AS group_id FROM batched"


def top(source: str, keys: str, value: str, k: int | None) -> str:
    """Most frequent values per key; ties by first occurrence."""
    limit = f" WHERE rank <= {k}" if k else ""
    return f"""SELECT * FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys}
      ORDER BY n DESC, o) AS rank, value, n FROM (
      SELECT {keys}, CAST({value} AS VARCHAR) AS value, count(*) AS n, min(ord) AS o
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, CAST({value} AS VARCHAR))){limit}"""


def listed(name: str, pattern: str = "value || ' (' || n || ')'") -> str:
    return f"string_agg({pattern}, ', ' ORDER BY rank) AS {name}"


_IPS = "CASE WHEN group_id NOT LIKE 'cidr\\_%' ESCAPE '\\' THEN coalesce(client_ip, 'None') END"
_GROUP_TOPS = {
    "top_ips": (_IPS, 3), "top_paths": ("nullif(path, '')", 5),
    "methods": ("nullif(method, '')", None), "status_codes": ("nullif(status_code, 0)", 5),
    "user_agents": ("agent", 3)}
for _name, (_value, _k) in _GROUP_TOPS.items():
    CTES[f"g_{_name}"] = top("grouped", "batch_id, group_id", _value, _k)

_SUSPECT = any_of("query_string", GROUP_SUSPICIOUS_QUERY)
CTES["group_stats"] = f"""
SELECT batch_id, group_id, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts,
  max(ts) - min(ts) AS duration_s, arg_min(iso, ord) AS first_iso,
  arg_max(iso, ts * 1000000000 - line_number) AS last_iso, bool_or({_SUSPECT}) AS suspicious_query,
  count(*) FILTER (status_code IN (401, 403)) AS auth_failures
FROM grouped GROUP BY batch_id, group_id"""
CTES["group_text"] = f"""
SELECT s.*, concat_ws({NL},
  CASE group_id WHEN '4xx_errors' THEN 'Group: 4xx Client Errors' WHEN '5xx_errors' THEN 'Group: 5xx Server Errors'
    ELSE CASE WHEN group_id LIKE 'cidr%' THEN 'Group: Requests from CIDR ' || substr(group_id, 6)
         ELSE 'Group: ' || group_id END END,
  concat('Count: ', s.n, ' requests'), concat('Time Range: ', first_iso, ' to ', last_iso),
  CASE WHEN duration_s > 1 THEN concat('Request Rate: ', printf('%.2f', s.n / duration_s), ' requests/second') END,
  CASE WHEN group_id NOT LIKE 'cidr%' THEN concat('Top IPs: ', ips.l) END,
  concat('Top Paths: ', paths.l), concat('Methods: ', methods.l), concat('Status Codes: ', codes.l),
  'User-Agents: ' || agents.l,
  CASE WHEN suspicious_query OR auth_failures > 0 THEN concat('Suspicious Patterns: ', concat_ws(', ',
    CASE WHEN suspicious_query THEN 'suspicious query strings detected' END,
    CASE WHEN auth_failures > 0 THEN auth_failures || ' authentication failures' END)) END) AS summary_text
FROM group_stats s
LEFT JOIN (SELECT batch_id, group_id, {listed('l', "value || ' (' || n || ' requests)'")} FROM g_top_ips GROUP BY 1, 2) ips USING (batch_id, group_id)
LEFT JOIN (SELECT batch_id, group_id, {listed('l')} FROM g_top_paths GROUP BY 1, 2) paths USING (batch_id, group_id)
LEFT JOIN (SELECT batch_id, group_id, {listed('l')} FROM g_methods GROUP BY 1, 2) methods USING (batch_id, group_id)
LEFT JOIN (SELECT batch_id, group_id, {listed('l')} FROM g_status_codes GROUP BY 1, 2) codes USING (batch_id, group_id)
LEFT JOIN (SELECT batch_id, group_id, {listed('l')} FROM g_user_agents GROUP BY 1, 2) agents USING (batch_id, group_id)"""

_BATCH_TOPS = {
    "b_ips": ("coalesce(client_ip, 'None')", 5), "b_status": ("nullif(status_code, 0)", 5),
    "b_paths": ("nullif(path, '')", 5), "b_known_ips": ("nullif(client_ip, '')", 10),
    "b_known_paths": ("nullif(path, '')", 20)}
for _name, (_value, _k) in _BATCH_TOPS.items():
    CTES[_name] = top("batched", "batch_id", _value, _k)
CTES["batch_stats"] = f"""
SELECT * FROM (SELECT batch_id, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts,
  arg_min(iso, ord) AS first_iso, arg_max(iso, ord) AS last_iso,
  count(DISTINCT coalesce(client_ip, 'None')) AS unique_ips FROM batched GROUP BY batch_id)
LEFT JOIN (SELECT batch_id, {listed('top_ips')} FROM b_ips GROUP BY 1) USING (batch_id)
LEFT JOIN (SELECT batch_id, {listed('top_status')} FROM b_status GROUP BY 1) USING (batch_id)
LEFT JOIN (SELECT batch_id, {listed('top_paths')} FROM b_paths GROUP BY 1) USING (batch_id)"""

_REF = (r"coalesce(nullif(regexp_replace(regexp_extract({0}, "
        r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), ''), '/')")
_LABELS = "CASE status_code " + " ".join(
    f"WHEN {code} THEN '{label}'" for code, label in STATUS_LABELS.items()) + " END"
CTES["sentences"] = f"""
SELECT *, concat_ws({NL}, concat(coalesce(nullif(method, ''), 'UNKNOWN'), ' request'),
  'IP: ' || nullif(client_ip, ''), concat('Path: ', coalesce(nullif(path, ''), '/')),
  concat('Status: ', concat_ws(' ', status_code, {_LABELS})),
  'Referrer: ' || CASE WHEN referer IS NOT NULL THEN {_REF.format('referer')} END,
  'User-Agent: ' || agent, concat('Timestamp: ', iso),
  CASE WHEN {any_of('query_string', SUSPICIOUS_QUERY)} THEN concat('Query: ', left(query_string, 200)) END) AS document
FROM parsed"""
CTES["entry_texts"] = """
SELECT *, coalesce(nullif(concat_ws(' | ', CASE WHEN method <> '' AND path <> '' THEN concat(method, ' ', path) END,
  'Query: ' || nullif(query_string, ''), 'Status: ' || nullif(status_code, 0), 'IP: ' || nullif(client_ip, ''),
  'UA: ' || left(nullif(user_agent, ''), 100)), ''), raw_line) AS text FROM parsed"""
CTES["kept_sentences"] = "SELECT s.* FROM sentences s JOIN kept USING (line_number)"


# --- vectors ------------------------------------------------------------------------------------

def embedded(source: str, key: str, text: str, dim: int = 64) -> str:
    """Sparse unit vectors `(key, bucket, w)` of the words of a text column."""
    return f"""
SELECT {key}, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS w FROM (
  SELECT {key}, CAST(('0x' || left(md5(word), 4)) AS INTEGER) % {dim} AS bucket, CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS word FROM {source})
  WHERE word <> '' GROUP BY ALL)"""


def phrases(queries) -> str:
    rows = ", ".join(f"('q{i + 1}', {quoted(q)})" for i, q in enumerate(queries))
    return f"SELECT * FROM (VALUES {rows}) t(query_id, phrase)"


CTES["context_phrases"] = phrases(CONTEXT_QUERIES)
CTES["context_vectors"] = embedded("context_phrases", "query_id", "phrase")
CTES["threat_phrases"] = phrases(THREAT_QUERIES)
CTES["threat_vectors"] = embedded("threat_phrases", "query_id", "phrase")


def distances(rows: str, key: str, vectors: str, queries: str) -> str:
    """Cosine distance of every row to every query phrase, rounded to six decimals."""
    return f"""
SELECT r.{key}, q.query_id, round(1.0 - coalesce(d.s, 0) / r.norm / q.norm, 6) AS distance
FROM (SELECT {key}, coalesce(nullif(max(l), 0), 1) AS norm FROM (
  SELECT {key}, 0 AS l FROM {rows} UNION ALL
  SELECT {key}, sqrt(sum(CAST(w AS DOUBLE) * w)) FROM {vectors} GROUP BY 1) GROUP BY 1) r
CROSS JOIN (SELECT query_id, sqrt(sum(CAST(w AS DOUBLE) * w)) AS norm FROM {queries} GROUP BY 1) q
LEFT JOIN (SELECT v.{key}, q.query_id, sum(CAST(v.w AS DOUBLE) * q.w) AS s
  FROM {vectors} v JOIN {queries} q USING (bucket) GROUP BY 1, 2) d
  ON d.{key} = r.{key} AND d.query_id = q.query_id"""


CTES["log_ids"] = "SELECT *, sha256('access.log#' || line_number) AS id FROM kept_sentences"
CTES["log_vectors"] = embedded("log_ids", "id", "document")
CTES["log_distances"] = distances("log_ids", "id", "log_vectors", "context_vectors")
CTES["group_docs"] = """
SELECT concat('access.log#batch_', batch_id, '_', group_id) AS id, b.max_ts AS ts, batch_id, group_id,
  g.n AS log_count, summary_text AS document
FROM group_text g JOIN (SELECT batch_id, max_ts FROM batch_stats) b USING (batch_id)"""
CTES["group_vectors"] = embedded("group_docs", "id", "document")
CTES["group_distances"] = distances("group_docs", "id", "group_vectors", "context_vectors")


def similar(docs: str, dist: str, kind: str, k: int, limit: int) -> str:
    return f"""
SELECT batch_id, '{kind}' AS kind, rank, id, document, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY distance, id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_id, document ORDER BY distance, id) AS dup FROM (
      SELECT b.batch_id, d.id, d.document, x.distance, row_number() OVER (
        PARTITION BY b.batch_id, x.query_id ORDER BY x.distance, d.id) AS r
      FROM batch_stats b JOIN {docs} d ON d.ts BETWEEN b.max_ts - 1800 AND b.max_ts
      JOIN {dist} x ON x.id = d.id) WHERE r <= {k}) WHERE dup = 1) WHERE rank <= {limit}"""


# --- chunks ---------------------------------------------------------------------------------------

CTES["intelligent"] = f"""
SELECT *, concat(category, '_', pos // 20) AS chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts, line_number) - 1 AS pos
  FROM (SELECT *, {_CATEGORY} AS category FROM entry_texts))"""
CTES["fixed"] = """
SELECT *, concat('fixed_', pos // 10 * 10, '_', least(pos // 10 * 10 + 10, total)) AS chunk_id FROM (
  SELECT *, row_number() OVER (ORDER BY line_number) - 1 AS pos, count(*) OVER () AS total FROM entry_texts)"""
CTES["seconds"] = "SELECT DISTINCT ts FROM parsed"
CTES["starts"] = """
SELECT min(ts) AS ws, 0 AS idx FROM seconds UNION ALL
SELECT (SELECT min(s.ts) FROM seconds s WHERE s.ts > starts.ws + 60), starts.idx + 1 FROM starts
WHERE EXISTS (SELECT 1 FROM seconds s WHERE s.ts > starts.ws + 60)"""
CTES["windowed"] = """
SELECT p.*, s.ws AS window_start, s.idx AS window_index FROM parsed p ASOF JOIN starts s ON p.ts >= s.ws"""


def counts(source: str, value: str, name: str) -> str:
    """`value: n` pairs of every chunk, ordered by value."""
    return f"""SELECT chunk_id, string_agg(v || ':' || n, ',' ORDER BY v) AS {name} FROM (
  SELECT chunk_id, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


CTES["chunk_table"] = f"""
SELECT c.*, status_codes, methods FROM (
  SELECT chunk_id, arg_min(ts, pos) AS start_time, arg_max(ts, pos) AS end_time, count(*) AS log_count,
    arg_min(iso, pos) AS start_time_iso, arg_max(iso, pos) AS end_time_iso,
    array_to_string(list_sort(list_distinct(list(client_ip))), ',') AS unique_ips,
    count(DISTINCT client_ip) AS unique_ip_count,
    string_agg(text, {NL} ORDER BY pos) AS document,
    count(*) FILTER (status_code = 401) AS n401, count(*) FILTER (status_code = 403) AS n403,
    count(*) FILTER (status_code = 404) AS n404, count(*) FILTER (status_code = 500) AS n500
  FROM intelligent GROUP BY chunk_id) c
LEFT JOIN ({counts('intelligent', 'CAST(status_code AS VARCHAR)', 'status_codes')}) USING (chunk_id)
LEFT JOIN ({counts('intelligent', "nullif(method, '')", 'methods')}) USING (chunk_id)"""
CTES["chunk_vectors"] = embedded("chunk_table", "chunk_id", "document")
CTES["chunk_distances"] = distances("chunk_table", "chunk_id", "chunk_vectors", "threat_vectors")
CTES["newest_chunk"] = "SELECT max(end_time) AS as_of FROM chunk_table"


def recent(hours: float) -> str:
    return f"start_time >= (SELECT as_of FROM newest_chunk) - {int(hours * 3600)}"


def by_meaning(k: int, hours: float | None) -> str:
    where = f"WHERE {recent(hours)}" if hours else ""
    return f"""SELECT * FROM (SELECT query_id, chunk_id, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
      FROM chunk_distances JOIN chunk_table USING (chunk_id) {where}) WHERE rank <= {k}"""


_FAILING = " OR ".join(f"n{code} >= {n}" for code, n in ANOMALOUS_STATUS.items())


def anomalies(n: int, hours: float) -> str:
    half = (f"SELECT {{s}} AS strategy, chunk_id, row_number() OVER (ORDER BY start_time DESC, chunk_id) AS rank "
            f"FROM chunk_table WHERE {recent(hours)} AND ({{t}}) QUALIFY rank <= {n // 2}")
    return f"""SELECT * FROM (SELECT * FROM ({half.format(s=1, t=_FAILING)} UNION ALL {half.format(s=2, t='log_count >= 20')})
      QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY strategy, rank) = 1)
      ORDER BY strategy, rank LIMIT {n}"""


def combined(hours: float | None, n: int) -> str:
    q = len(THREAT_QUERIES)
    alike = ("SELECT CAST(substr(query_id, 2) AS INTEGER) AS strategy, chunk_id, rank FROM ({})")
    if hours is None:
        hits = alike.format(by_meaning(n // q, None))
    else:
        hits = f"""SELECT 0 AS strategy, chunk_id, row_number() OVER (ORDER BY start_time DESC, chunk_id) AS rank
          FROM chunk_table WHERE {recent(hours)} QUALIFY rank <= {n // 3}
          UNION ALL {alike.format(by_meaning(n // (3 * q), hours))}
          UNION ALL SELECT strategy + 1000, chunk_id, rank FROM ({anomalies(n // 3, hours)})"""
    return f"""SELECT c.*, strategy, h.rank AS hit_rank FROM chunk_table c JOIN (
      SELECT * FROM ({hits}) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY strategy, rank) = 1) h
      USING (chunk_id) ORDER BY start_time DESC, strategy, h.rank LIMIT {n}"""


# --- rules ------------------------------------------------------------------------------------------

_SEVERITY = """CASE WHEN n >= lim * 10 THEN 'critical' WHEN n >= lim * 5 THEN 'high'
  WHEN n >= lim * 2 THEN 'medium' ELSE 'low' END"""


def rule(kind: str, scope: str, source: str, limits: dict[str, int]) -> str:
    """Findings of one rule as `(scope, threat_type, client_ip, n, lim, sample_path, detail)`."""
    window = "CAST(ts // {} * {} AS BIGINT) AS window_start"
    narrow = "batch_id" if scope == "batch_id" else window.format(300, 300)
    wide = "batch_id" if scope == "batch_id" else window.format(600, 600)
    lim = limits[kind] if kind in limits else 1
    request = "lower(concat_ws('?', path, query_string))"
    allowed = any_of("user_agent", split_option(CRAWLER_AGENTS))
    head = f"SELECT {scope}, '{kind}' AS threat_type, client_ip, "
    if kind == "brute_force":
        return f"""{head} count(*) AS n, {lim} AS lim, min(path) AS sample_path, path AS detail,
          string_agg(DISTINCT client_ip, ',') AS ips
          FROM (SELECT *, {narrow if scope != 'batch_id' else '1 AS one'} FROM {source}) WHERE status_code IN (401, 403)
          GROUP BY {scope}, client_ip, path HAVING count(*) >= {lim}"""
    if kind == "ddos":
        key = "" if scope != "batch_id" else "batch_id, "
        return f"""SELECT {scope}, 'ddos' AS threat_type, cidr AS client_ip, max(two) AS n, {lim} AS lim,
          CAST(NULL AS VARCHAR) AS sample_path, CAST(NULL AS VARCHAR) AS detail,
          array_to_string(list_sort(list_distinct(flatten(list(ips)))), ',') AS ips
          FROM (SELECT *, {'1 AS one' if scope == 'batch_id' else window.format(300, 300)} FROM (
            SELECT {key} cidr, ts, ips, sum(c) OVER (PARTITION BY {key} cidr ORDER BY ts RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS two
            FROM (SELECT {key} cidr, ts, count(*) AS c, list(client_ip) AS ips FROM {source} GROUP BY ALL)))
          GROUP BY {scope}, cidr HAVING max(two) >= {lim}"""
    if kind in ("sql_injection", "path_traversal"):
        pattern = SQL_INJECTION if kind == "sql_injection" else PATH_TRAVERSAL
        return f"""{head} count(*) AS n, {lim} AS lim, min(path) AS sample_path, CAST(NULL AS VARCHAR) AS detail,
          string_agg(DISTINCT client_ip, ',') AS ips
          FROM (SELECT *, {narrow if scope != 'batch_id' else '1 AS one'} FROM {source}) WHERE regexp_matches({request}, {quoted(pattern)})
          GROUP BY {scope}, client_ip HAVING count(*) >= {lim}"""
    if kind == "reconnaissance":
        pages, paths = limits["missing_pages"], limits["failing_paths"]
        return f"""SELECT {scope}, 'reconnaissance' AS threat_type, client_ip,
          CASE WHEN missing >= {pages} THEN missing ELSE paths END AS n,
          CASE WHEN missing >= {pages} THEN {pages} ELSE {paths} END AS lim, sample_path,
          CAST(NULL AS VARCHAR) AS detail, client_ip AS ips FROM (
          SELECT {scope}, client_ip, count(*) FILTER (status_code = 404) AS missing,
            count(DISTINCT path) AS paths, min(path) AS sample_path
          FROM (SELECT *, {wide if scope != 'batch_id' else '1 AS one'} FROM {source}) WHERE status_code BETWEEN 400 AND 499
          GROUP BY {scope}, client_ip) WHERE missing >= {pages} OR paths >= {paths}"""
    return f"""{head} count(*) AS n, {lim} AS lim, min(path) AS sample_path, user_agent AS detail,
      string_agg(DISTINCT client_ip, ',') AS ips
      FROM (SELECT *, {narrow if scope != 'batch_id' else '1 AS one'} FROM {source})
      WHERE regexp_matches(lower(user_agent), '{SCRIPTED_AGENT}') AND NOT {allowed}
      GROUP BY {scope}, client_ip, user_agent HAVING count(*) >= {lim}"""


# Thresholds low enough for every rule to fire on the test log.
LOW = {"brute_force": 2, "ddos": 2, "sql_injection": 1, "path_traversal": 1, "missing_pages": 3,
       "failing_paths": 4, "bot": 1}
BATCH_LOW = {"brute_force": 1, "ddos": 3, "sql_injection": 1, "path_traversal": 1,
             "missing_pages": 2, "failing_paths": 3, "bot": 2}
KINDS = ("brute_force", "ddos", "sql_injection", "path_traversal", "reconnaissance", "bot")


def findings(kinds, source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT window_start, threat_type, client_ip, n, lim, sample_path, detail FROM ({rule(k, 'window_start', source, LOW)})"
                               for k in kinds)
    return f"""SELECT window_start, threat_type, client_ip, {_SEVERITY} AS severity,
      round(least(1.0::DOUBLE, 0.5::DOUBLE + n * 0.05::DOUBLE), 6) AS confidence, CAST(n AS BIGINT) AS n, sample_path FROM ({parts})"""


CTES["batch_findings"] = " UNION ALL ".join(
    f"SELECT batch_id, threat_type, client_ip, n, lim, detail, ips FROM ({rule(k, 'batch_id', 'batched', BATCH_LOW)})"
    for k in KINDS)
CTES["batch_threats"] = f"""
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY threat_type, client_ip, coalesce(detail, '')) AS threat_no,
  threat_type AS type, {_SEVERITY} AS severity, round(least(1.0::DOUBLE, 0.5::DOUBLE + n * 0.05::DOUBLE), 6) AS confidence,
  concat(replace(threat_type, '_', ' '), ' from ', client_ip, ': ', n, ' requests') AS description,
  concat('Review and rate-limit ', client_ip) AS recommendation, string_split(ips, ',') AS source_ips,
  CASE WHEN threat_type = 'brute_force' THEN [detail] ELSE [] END AS target_paths FROM batch_findings"""
CTES["samples"] = """
SELECT * FROM (SELECT t.batch_id, t.threat_no, b.line_number, b.client_ip, b.path, b.iso, b.raw_line,
  row_number() OVER (PARTITION BY t.batch_id, t.threat_no ORDER BY b.ts, b.line_number) AS sample_no
  FROM batch_threats t JOIN batched b ON b.batch_id = t.batch_id AND (
    (len(t.source_ips) > 0 AND list_contains(t.source_ips, b.client_ip))
    OR (len(t.target_paths) > 0 AND coalesce(b.path, '') <> ''
        AND len(list_filter(t.target_paths, lambda p: contains(b.path, p))) > 0)
    OR (len(t.source_ips) = 0 AND len(t.target_paths) = 0))) WHERE sample_no <= 15"""
CTES["analysis_docs"] = f"""
SELECT s.batch_id, max_ts AS ts, coalesce(t.threats, 0) AS threats_found, concat_ws({NL}, 'Analysis Summary',
  concat('Batch Size: ', s.n, ' logs'), concat('Time Range: ', first_iso, ' to ', last_iso),
  concat('Unique IPs: ', unique_ips), concat('Top IPs: ', top_ips), concat('Status Codes: ', top_status),
  concat('Top Paths: ', top_paths),
  CASE WHEN t.threats IS NULL THEN concat({NL}, 'Threats Detected: 0', {NL}, 'Assessment: Normal traffic patterns, no suspicious activity')
  ELSE concat_ws({NL}, concat({NL}, 'Threats Detected: ', t.threats), concat('Threat Types: ', y.l), concat('Suspicious IPs: ', i.l), d.l) END) AS document
FROM batch_stats s
LEFT JOIN (SELECT batch_id, count(*) AS threats FROM batch_threats GROUP BY 1) t USING (batch_id)
LEFT JOIN (SELECT batch_id, string_agg(type || ' (' || n || ')', ', ' ORDER BY o) AS l FROM (
  SELECT batch_id, type, count(*) AS n, min(threat_no) AS o FROM batch_threats GROUP BY 1, 2) GROUP BY 1) y USING (batch_id)
LEFT JOIN (SELECT batch_id, array_to_string(list_sort(list_distinct(list(ip)))[1:10], ', ') AS l FROM (
  SELECT batch_id, unnest(source_ips) AS ip FROM batch_threats) GROUP BY 1) i USING (batch_id)
LEFT JOIN (SELECT batch_id, string_agg('Threat ' || threat_no || ': ' || type || ' - ' || left(description, 100), {NL} ORDER BY threat_no) AS l
  FROM batch_threats WHERE threat_no <= 3 GROUP BY 1) d USING (batch_id)"""
CTES["prior"] = """
SELECT b.batch_id, 'analysis_summaries' AS kind, b.batch_id - a.batch_id AS rank,
  concat('access.log#analysis_batch_', a.batch_id) AS id, a.document, CAST(NULL AS DOUBLE) AS distance
FROM batch_stats b JOIN analysis_docs a ON a.batch_id BETWEEN b.batch_id - 5 AND b.batch_id - 1
WHERE a.ts >= b.max_ts - 1800"""
CTES["context"] = (
    similar("log_ids", "log_distances", "individual_logs", 5, 20) + " UNION ALL "
    + similar("group_docs", "group_distances", "grouped_summaries", 2, 10)
    + " UNION ALL SELECT * FROM prior")
CTES["evidence"] = """
SELECT t.*, coalesce(x.samples, 0) AS samples,
  CASE WHEN coalesce(x.ips, '') <> '' THEN x.ips ELSE ki.l END AS derived_ips,
  CASE WHEN coalesce(x.paths, '') <> '' THEN x.paths ELSE kp.l END AS derived_paths, x.first_line
FROM batch_threats t
LEFT JOIN (SELECT batch_id, threat_no, count(*) AS samples,
    array_to_string(list_sort(list_distinct(list(nullif(client_ip, '')))), ',') AS ips,
    array_to_string(list_sort(list_distinct(list(nullif(trim(path), '')))), ',') AS paths,
    arg_min(raw_line, sample_no) AS first_line FROM samples GROUP BY 1, 2) x USING (batch_id, threat_no)
LEFT JOIN (SELECT batch_id, string_agg(value, ',' ORDER BY rank) AS l FROM b_known_ips GROUP BY 1) ki USING (batch_id)
LEFT JOIN (SELECT batch_id, string_agg(value, ',' ORDER BY rank) AS l FROM b_known_paths GROUP BY 1) kp USING (batch_id)"""


# --- alerts -------------------------------------------------------------------------------------------

_SEC = "1704067200 + (epoch_us(ts) - 1704067200000000) // 600000000"
CTES["alerts"] = f"""
SELECT event_id AS alert_id, event_id // 50 AS run_id, {_SEC} AS ts,
  list_extract(['brute_force', 'ddos', 'sql_injection', 'path_traversal', 'reconnaissance', 'bot', 'other'],
    CAST(event_id % 7 AS INTEGER) + 1) AS threat_type,
  list_extract(['critical', 'high', 'medium', 'low', 'info'], CAST(event_id % 5 AS INTEGER) + 1) AS severity,
  CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
  concat('Finding ', event_id, ' by user ', user_id) AS description,
  concat('Block user ', user_id % 10) AS recommendation,
  list_transform(range(0, event_id % 8), lambda i: concat('10.0.', i, '.', user_id % 250)) AS source_ips,
  list_transform(range(0, event_id % 5), lambda i: concat('/p', i, '/', user_id % 20)) AS target_paths,
  event_id % 3 = 0 AS acknowledged, '' AS acknowledged_by, CAST(NULL AS BIGINT) AS acknowledged_at
FROM events WHERE event_type = 'error'"""
CTES["runs"] = """
SELECT run_id, max(ts) AS ts, CASE WHEN run_id % 10 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN run_id % 10 = 0 THEN concat('Timeout in run ', run_id) ELSE '' END AS error_message,
  count(*) AS threats_found, CAST(run_id % 977 AS DOUBLE) / 7 AS duration_seconds FROM alerts GROUP BY run_id"""
_GENERIC = "contains(i, 'Request ') AND contains(i, ' from ') AND (contains(i, 'total from same IP') OR contains(i, '...'))"
_REFS = ("list_transform(range(0, event_id % 4), lambda i: CASE WHEN (event_id + i) % 3 = 0 "
         "THEN concat('Request ', i, ' from ', user_id, ' ...') ELSE concat('Odd path ', i) END)")
CTES["refs"] = f"SELECT event_id AS alert_id, {_REFS} AS refs FROM events WHERE event_type = 'error'"
