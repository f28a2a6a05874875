"""Per-entry text and classification expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readable names of status codes.
STATUS_LABELS = {
    200: "success", 201: "created", 204: "no content",
    301: "redirect", 302: "redirect", 304: "not modified",
    400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found",
    500: "server error", 502: "bad gateway", 503: "service unavailable",
}
# Query substrings that mark an entry as suspicious.
SUSPICIOUS_QUERY = (
    "union", "select", "drop", "insert", "delete", "update",
    "../", "..\\", "/etc/", "/passwd", "/shadow",
    "<script", "javascript:", "onerror=", "onload=",
    "exec", "eval", "system", "cmd",
    "0x", "%27", "%22", "%3c", "%3e",
)
# The shorter list used when a group is summarised.
GROUP_SUSPICIOUS_QUERY = ("union", "select", "../", "script", "exec")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """True if `text` holds any needle; never NULL."""
    if not needles:
        return F.lit(False)
    return F.coalesce(text.rlike("|".join(_quote(n) for n in needles)), F.lit(False))


def _quote(needle: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ %<=:-])", r"\\\1", needle)


def filled(text: Column) -> Column:
    """`text`, or NULL when it is empty."""
    return F.when(text != "", text)


def iso_time(ts: Column, tz_offset: Column) -> Column:
    """ISO text in the offset the log line carried; no suffix when it carried none."""
    local = F.when(tz_offset.isNull() | (tz_offset == "+00:00"), ts).otherwise(
        F.from_utc_timestamp(ts, tz_offset))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(tz_offset, F.lit("")))


def entry_text() -> Column:
    """`METHOD path | Query: … | Status: … | IP: … | UA: …`, else the raw line."""
    c = F.col
    return F.coalesce(filled(F.concat_ws(
        " | ",
        F.when((c("method") != "") & (c("path") != ""), F.concat_ws(" ", "method", "path")),
        F.concat(F.lit("Query: "), filled(c("query_string"))),
        F.when(c("status_code") != 0, F.concat(F.lit("Status: "), c("status_code"))),
        F.concat(F.lit("IP: "), filled(c("client_ip"))),
        F.concat(F.lit("UA: "), F.substring(filled(c("user_agent")), 1, 100)),
    )), c("raw_line"))


JSON_FIELDS = ("raw_line", "line_number", "client_ip", "method", "path", "query_string",
               "protocol", "status_code", "bytes_sent", "referer", "user_agent", "remote_user")


def entry_json() -> Column:
    return F.to_json(
        F.struct(iso_time(F.col("ts"), F.col("tz_offset")).alias("timestamp"), *JSON_FIELDS),
        {"ignoreNullFields": "false"})


def sentence() -> Column:
    """Key-value description of one entry, one fact per line."""
    c = F.col
    labels = F.create_map(*[F.lit(v) for pair in STATUS_LABELS.items() for v in pair])
    return F.concat_ws(
        "\n",
        F.concat(F.coalesce(filled(c("method")), F.lit("UNKNOWN")), F.lit(" request")),
        F.concat(F.lit("IP: "), filled(c("client_ip"))),
        F.concat(F.lit("Path: "), F.coalesce(filled(c("path")), F.lit("/"))),
        F.concat(F.lit("Status: "), F.concat_ws(
            " ", F.coalesce(c("status_code").cast("string"), F.lit("None")),
            F.try_element_at(labels, c("status_code")))),
        F.concat(F.lit("Referrer: "), referrer_path(c("referer"))),
        F.concat(F.lit("User-Agent: "), simple_agent(filled(c("user_agent")))),
        F.concat(F.lit("Timestamp: "), iso_time(c("ts"), c("tz_offset"))),
        F.when(suspicious_query(c("query_string")),
               F.concat(F.lit("Query: "), F.substring(c("query_string"), 1, 200))),
    )


def _versioned(agent: Column, name: str) -> Column:
    """`name` plus its major version when `name/` is followed by a token."""
    token = F.regexp_extract(agent, name + r"/\s*([^\s]*)", 1)
    after = F.contains(agent, F.lit(name + "/")) & (token != "")
    return F.when(after, F.concat(F.lit(name + " "), F.substring_index(token, ".", 1))).otherwise(
        F.lit(name))


def simple_agent(agent: Column) -> Column:
    """`Browser version (OS)`; the first rule that fits wins."""
    low = F.lower(agent)

    def has(*words: str) -> Column:
        found = [F.contains(agent, F.lit(w)) for w in words]
        return found[0] if len(found) == 1 else found[0] | found[1]

    browser = (
        F.when(F.contains(low, F.lit("curl")), F.lit("curl"))
        .when(F.contains(low, F.lit("wget")), F.lit("wget"))
        .when(has("Python") | F.contains(low, F.lit("python-requests")), F.lit("Python-requests"))
        .when(low.rlike("bot|crawler|spider"), F.lit("Bot/Crawler"))
        .when(has("Edg"), F.lit("Edge"))
        .when(has("Chrome"), _versioned(agent, "Chrome"))
        .when(has("Firefox"), _versioned(agent, "Firefox"))
        .when(has("Safari"), F.lit("Safari"))
        .otherwise(F.lit("Other")))
    system = (
        F.when(has("Windows NT 10.0", "Windows NT 11.0"), F.lit("Windows 10/11"))
        .when(has("Windows"), F.lit("Windows"))
        .when(has("Mac OS X", "Macintosh"), F.lit("macOS"))
        .when(has("Linux") & ~has("Android"), F.lit("Linux"))
        .when(has("Android"), F.lit("Android"))
        .when(has("iPhone", "iPad"), F.lit("iOS"))
        .otherwise(F.lit("Unknown")))
    return F.when(agent.isNotNull(), F.concat(browser, F.lit(" ("), system, F.lit(")")))


def referrer_path(url: Column) -> Column:
    """Path part of a URL, `/` when it has none; NULL only for a NULL URL.

    The URL reader rejects strings that are no URLs; for those the path is what remains
    after an optional `scheme:` and `//host`, before `?` or `#`.
    """
    loose = F.regexp_replace(
        F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"[?#].*$", "")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), loose)
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.when(url.isNull(), F.lit(None)).when(url == "-", F.lit("/")).otherwise(
        F.coalesce(filled(path), F.lit("/")))


def suspicious_query(query: Column) -> Column:
    return contains_any(F.lower(query), SUSPICIOUS_QUERY)


def group_suspicious_query(query: Column) -> Column:
    return contains_any(F.lower(query), GROUP_SUSPICIOUS_QUERY)


def cidr_block(ip: Column) -> Column:
    """`a.b.c.0/24` of a dotted quad, any other address unchanged."""
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4,
                  F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(ip)


def cidr_prefix(ip: Column) -> Column:
    """First three dotted parts, `unknown` without an address."""
    return F.coalesce(F.substring_index(filled(ip), ".", 3), F.lit("unknown"))


def batch_group(status: Column, ip: Column) -> Column:
    """Group of an entry inside a batch."""
    return (F.when(status.between(400, 499), F.lit("4xx_errors"))
            .when(status.between(500, 599), F.lit("5xx_errors"))
            .when((status == 200) & (ip != ""), F.concat(F.lit("cidr_"), cidr_block(ip)))
            .otherwise(F.lit("other_status")))


def chunk_category(status: Column, ip: Column) -> Column:
    """Category of an entry when chunking by kind of traffic."""
    return (F.when(status.between(400, 499), F.lit("4xx"))
            .when(status.between(500, 599), F.lit("5xx"))
            .when(status == 200, F.concat(F.lit("cidr_"), cidr_prefix(ip)))
            .otherwise(F.lit("other")))


def two_decimals(count: Column, seconds: Column) -> Column:
    """`count / seconds` printed with two decimals, rounded like C's `%.2f`.

    A quotient that lies exactly between two hundredths is rounded by where its nearest
    double lies: the remainder `count - double * seconds` is computed without rounding by
    splitting the double in two halves; a zero remainder rounds to the even hundredth.
    """
    seconds = F.nullif(seconds, F.lit(0))
    cents = F.floor(count * 100 / seconds).cast("bigint")
    cents = F.when(cents * seconds > count * 100, cents - 1).when(
        (cents + 1) * seconds <= count * 100, cents + 1).otherwise(cents)
    twice = 2 * (count * 100 - cents * seconds)
    quotient = count.cast("double") / seconds
    scaled = quotient * 134217729.0
    high = scaled - (scaled - quotient)
    left = (count - high * seconds) - (quotient - high) * seconds
    up = (twice > seconds) | ((twice == seconds) & (
        (left < 0) | ((left == 0) & (cents % 2 == 1))))
    rounded = cents + up.cast("bigint")
    return F.concat(F.floor(rounded / 100).cast("string"), F.lit("."),
                    F.lpad((rounded % 100).cast("string"), 2, "0"))


def words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    return F.floor(words(text) * 1.3).cast("int")
