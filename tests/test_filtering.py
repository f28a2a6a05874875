import pytest

from vigilog.config import EngineConfig
from vigilog.operators.filtering import keep_entries, reason_counts

FIELDS = "path STRING, method STRING, status_code INT, user_agent STRING"


def kept(spark, row, **options):
    df = spark.createDataFrame([row], FIELDS)
    return keep_entries(df, EngineConfig(**options)).count() == 1


@pytest.mark.parametrize("row, options, expected", [
    (("/x", "POST", 200, None), {"excluded_status_codes": "200"}, True),
    (("/x", "GET", 200, None), {"excluded_status_codes": "200, x"}, False),
    (("/nodeviewcount", "POST", 200, None), {}, False),
    (("/app.CSS", "GET", 200, None), {}, False),
    (("/app.css/x", "GET", 200, None), {}, True),
    ((None, "GET", 200, None), {}, True),
    (("/x", "GET", 200, "Mozilla GoogleBot"), {}, False),
    (("/x", "POST", 200, "bingbot"), {"excluded_status_codes": "200"}, False),
    (("/x", "head", 200, None), {"excluded_methods": "HEAD"}, False),
    (("/x", None, None, None), {"excluded_methods": "HEAD", "excluded_status_codes": "200"}, True),
    (("/a.tar.gz", "GET", 200, None), {"excluded_extensions": "tar.gz"}, False),
    (("/css", "GET", 200, None), {}, True),
    (("/x.css", "GET", 200, None), {"filter_static": False}, True),
    (("/x.foo", "GET", 200, None), {"excluded_extensions": " .FOO , ,bar"}, False),
])
def test_rules(spark, row, options, expected):
    assert kept(spark, row, **options) is expected


def test_reasons_follow_rule_order(spark):
    df = spark.createDataFrame([("/health/a.css", "GET", 200, "googlebot"), ("/health", "GET", 200, None)], FIELDS)
    assert {r.drop_reason: r.n for r in reason_counts(df).collect()} == {"static_asset": 1, "path": 1}
