import pytest
from pyspark.sql import functions as F

from vigilog.functions import text
from vigilog.operators.parsing import PARSERS, parse_errors, parse_log, register_parser
from vigilog.schema import RAW_LINES

BASE = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /index.html HTTP/1.0" 200 2326'


def line(request="GET / HTTP/1.1", date="10/Oct/2000:13:55:36 +0000", size="1", rest="", host="1.2.3.4"):
    return f'{host} - - [{date}] "{request}" 200 {size}{rest}'


@pytest.fixture(scope="module")
def parse(spark):
    def run(*values):
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], RAW_LINES)
        rows = {r.line_number: r for r in parse_log(df).withColumn(
            "sec", F.unix_seconds("ts")).collect()}
        return [rows.get(i) for i in range(len(values))]

    return run


def test_common_and_combined(parse):
    plain, combined = parse(BASE, BASE + ' "http://example.com" "Mozilla/5.0"')
    assert plain.sec == 971211336 and plain.tz_offset == "-07:00"
    assert plain.referer is None and plain.user_agent is None
    assert (combined.referer, combined.user_agent) == ("http://example.com", "Mozilla/5.0")
    assert plain.bytes_sent == 2326 and plain.remote_user is None and plain.client_ip == "127.0.0.1"


@pytest.mark.parametrize("request_line, expected", [
    ("-", ("-", None, None, None)),
    ("", (None, None, None, None)),
    ("GET /a b HTTP/1.1", ("GET", "/a", None, "b HTTP/1.1")),
    ("GET ?x=1 HTTP/1.1", ("GET", "", "x=1", "HTTP/1.1")),
    ("GET /a?b?c HTTP/1.1", ("GET", "/a", "b?c", "HTTP/1.1")),
    ("GET /a? HTTP/1.1", ("GET", "/a", "", "HTTP/1.1")),
])
def test_request_line(parse, request_line, expected):
    (row,) = parse(line(request_line))
    assert (row.method, row.path, row.query_string, row.protocol) == expected


def test_quotes(parse):
    inside_request, in_agent, in_referer = parse(
        line('GET /\\"x HTTP/1.1'), line(rest=' "r" "Mo\\"z"'), line(rest=' "r\\"x" "UA"'))
    assert inside_request is None
    assert in_agent.user_agent == "Mo\\"
    assert in_referer.referer == "r\\" and in_referer.user_agent is None


def test_bytes_dates_blanks(parse):
    dash, word, naive, zulu, colon, bad, blank, junk = parse(
        line(size="-"), line(size="abc"), line(date="1/Oct/2000:13:55:36"),
        line(date="10/oct/2000:13:55:36 Z"), line(date="10/Oct/2000:13:55:36 +02:00"),
        line(date="99/Oct/2000:13:55:36 +0000"), "   ", line(rest=' "r" "ua" more stuff'))
    assert dash.bytes_sent is None and word.bytes_sent is None
    assert naive.sec == 970408536 and naive.tz_offset is None
    assert zulu.tz_offset == "+00:00" and zulu.sec == 971186136
    assert colon.sec == zulu.sec - 7200 and colon.tz_offset == "+02:00"
    assert bad is None and blank is None
    assert junk.user_agent == "ua"


def test_surrounding_blanks_and_separator_character(parse):
    spaced, odd, broken = parse("　 " + line() + "\xa0\t", line("GET /a\u0001b?c HTTP/1.1"),
                                "no \u0001 log line")
    assert spaced.raw_line == line()
    assert (odd.path, odd.query_string, odd.client_ip) == ("/a\u0001b", "c", "1.2.3.4")
    assert broken is None


def test_rejects_and_detection(spark):
    lines = [line(), "garbage", "", line(date="99/Oct/2000:00:00:00 +0000")]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(lines)], RAW_LINES)
    assert {r.line_number: r.reason for r in parse_errors(df).collect()} == {
        2: "format", 3: "blank", 4: "timestamp"}
    (row,) = PARSERS["clf"].detect(df).collect()
    assert (row.matching, row.sampled, row.is_clf) == (2, 3, False)
    blanks = spark.createDataFrame([("s", i + 1, " ") for i in range(10)], RAW_LINES)
    assert PARSERS["clf"].detect(blanks).first().is_clf is True


def test_parser_plug_in(spark):
    class Upper:
        format_name = "upper"

        def parse(self, lines):
            return lines.withColumn("value", F.upper("value"))

    register_parser("upper", Upper())
    df = spark.createDataFrame([("s", 1, "a")], RAW_LINES)
    assert parse_log(df, "upper").first().value == "A"
    with pytest.raises(ValueError):
        parse_log(df, "unheard-of")


AGENTS = {
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1": "Safari (macOS)",
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0.0.0 Safari/537.36": "Chrome 120 (Windows 10/11)",
    "Mozilla/5.0 (Windows NT 6.1) Chrome/ ": "Chrome (Windows)",
    "Mozilla/5.0 (X11; Linux) Chrome/99 Edg/99.1": "Edge (Linux)",
    "Mozilla/5.0 (Linux; Android 9) Firefox/68.0": "Firefox 68 (Android)",
    "Python/3.9 aiohttp": "Python-requests (Unknown)",
    "curl/8 bot": "curl (Unknown)",
    "YandexBot/3.0": "Bot/Crawler (Unknown)",
    "nothing": "Other (Unknown)",
}


def test_agents(spark):
    df = spark.createDataFrame([(a,) for a in AGENTS], "a STRING")
    found = {r.a: r.s for r in df.select("a", text.simple_agent(F.col("a")).alias("s")).collect()}
    assert found == AGENTS


URLS = {
    "https://example.com/path": "/path", "https://example.com": "/", "https://example.com?x=1": "/",
    "http://h/a;b/c;p?q#f": "/a;b/c", "example.com/x?y": "example.com/x", "-": "/", "/only": "/only",
    "http://h/a b": "/a b", "//host/p": "/p", "mailto:me": "me",
}


def test_referrer_path(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u STRING")
    found = {r.u: r.p for r in df.select("u", text.referrer_path(F.col("u")).alias("p")).collect()}
    assert found == URLS


def test_two_decimals_like_printf(spark):
    pairs = [(n, d) for n in range(1, 60) for d in range(2, 90)] + [(10**9, 7), (29, 200), (27, 200)]
    df = spark.createDataFrame(pairs, "n BIGINT, d BIGINT")
    rows = df.select("n", "d", text.two_decimals(F.col("n"), F.col("d")).alias("t")).collect()
    assert [r for r in rows if r.t != f"{r.n / r.d:.2f}"] == []


def test_cidr(spark):
    ips = {"1.2.3.4": ("1.2.3.0/24", "1.2.3"), "2001:db8::1": ("2001:db8::1", "2001:db8::1"),
           "1.2.3": ("1.2.3", "1.2.3"), "1.2.3.4.5": ("1.2.3.4.5", "1.2.3"), None: (None, "unknown")}
    df = spark.createDataFrame([(i,) for i in ips], "i STRING")
    found = {r.i: (r.c, r.p) for r in df.select(
        "i", text.cidr_block(F.col("i")).alias("c"), text.cidr_prefix(F.col("i")).alias("p")).collect()}
    assert found == ips
    groups = df.limit(1).select(
        text.batch_group(F.lit(200), F.lit(None).cast("string")).alias("b"),
        text.chunk_category(F.lit(200), F.lit(None).cast("string")).alias("c")).first()
    assert (groups.b, groups.c) == ("other_status", "cidr_unknown")
