"""Sketches against exact counts, trigram search against a scan, windows scored by rules, two tiers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import make_log
from vigilog.config import EngineConfig
from vigilog.operators import alerts, chunking, prompts, rules, sketches
from vigilog.plans import analysis
from vigilog.sources import tables

LOW = rules.Thresholds(brute_force=1, ddos=3, sql_injection=1, path_traversal=1, missing_pages=2, failing_paths=3, bot=2)


@pytest.fixture(scope="module")
def skewed(spark):
    """200,000 entries over a day; path p_i falls off as 1 / i, addresses are many."""
    df = spark.range(200_000).select(
        F.lit("a").alias("source"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 86_400).alias("ts"),
        F.concat(F.lit("/p"), F.floor(F.pow(F.lit(20_000.0), (F.xxhash64("id") % 1_000_003 + 1_000_003) / 2_000_006))
                 .cast("string")).alias("path"),
        F.concat(F.lit("10."), (F.xxhash64("id", F.lit(1)) % 30_000).cast("string")).alias("client_ip"))
    return df.cache()


def test_merged_sketches_keep_their_bounds(spark, skewed):
    items = 1024
    panes = sketches.pane_sketches(skewed, items=items).cache()
    assert panes.count() == 86_400 // 300 + (1 if 1_700_000_000 % 300 else 0)
    total = skewed.count()
    exact = {r.path: r["count"] for r in skewed.groupBy("path").count().collect()}
    assert len(exact) > 10 * items                                  # far more values than are tracked
    merged = sketches.merge_panes(panes, ["source"], items)
    got = {r.value: r.n for r in sketches.top_of(merged, ["source"], "top_paths", 50).collect()}
    error = 3.5 / items * total
    assert max(abs(n - exact[v]) for v, n in got.items()) <= error
    assert {v for v, n in exact.items() if n > min(got.values()) + error} <= set(got)
    row = sketches.addresses_of(merged, ["source"]).first()
    true = skewed.agg(F.countDistinct("client_ip")).first()[0]
    assert row.n == total and abs(row.addresses - true) <= 0.05 * true


def test_merging_in_steps_is_merging_at_once(spark, skewed):
    panes = sketches.pane_sketches(skewed.where(F.unix_seconds("ts") % 10 == 0))
    halves = panes.withColumn("half", F.col("pane_start") % 600)
    steps = sketches.merge_panes(sketches.merge_panes(halves, ["source", "half"]), ["source"])
    once = sketches.merge_panes(panes, ["source"])
    one, two = (sketches.addresses_of(d, ["source"]).first() for d in (once, steps))
    assert one.n == two.n and abs(one.addresses - two.addresses) <= 0.05 * one.addresses
    top = [{r.value: r.n for r in sketches.top_of(d, ["source"], k=5).collect()} for d in (once, steps)]
    assert top[0] == top[1]
    with pytest.raises(ValueError):
        sketches.top_of(once, ["source"], "n")


def test_empty_and_missing_values(spark):
    df = spark.createDataFrame([("a", 0, None, None), ("a", 1, "", ""), ("a", 2, "/x", "1.1.1.1")],
                               "source string, s bigint, path string, client_ip string").withColumn(
        "ts", F.timestamp_seconds("s"))
    merged = sketches.merge_panes(sketches.pane_sketches(df), ["source"])
    assert [(r.value, r.n) for r in sketches.top_of(merged, ["source"]).collect()] == [("/x", 1)]
    assert sketches.addresses_of(merged, ["source"]).first()[:] == ("a", 3, 1)
    assert sketches.pane_sketches(df.limit(0)).count() == 0


def alert_rows(spark):
    rng = random.Random(4)
    words = ["Login", "failure", "İstanbul", "user", "admin", "10.0.0.1", "ä", "%_", "a", ""]
    text = lambda: rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))])
    return spark.createDataFrame(
        [(i, text(), text(), rng.choice([None, [], ["10.0.0.1", None]]), [f"/p/{i % 7}"]) for i in range(300)],
        "alert_id bigint, description string, recommendation string, source_ips array<string>, target_paths array<string>")


@pytest.mark.parametrize("needle", ["login", "LOGIN f", "10.0", "%_", "a", "", "user admin", "/p/3", "nowhere", "ä a", "zzz login"])
def test_search_by_postings_equals_the_scan(spark, tmp_path, needle):
    df = alert_rows(spark)
    path = str(tmp_path / "postings")
    alerts.write_postings(df, path)
    found = alerts.search_indexed(df, spark.read.parquet(path), needle)
    assert sorted(r.alert_id for r in found.collect()) == sorted(
        r.alert_id for r in alerts.search_alerts(df, needle).collect())


def test_search_compares_candidates_only(spark, tmp_path):
    df = alert_rows(spark)
    path = str(tmp_path / "postings")
    alerts.write_postings(df, path)
    plan = alerts.search_indexed(df, spark.read.parquet(path), "login f")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "In(gram" in plan                 # grams are pushed to the postings' scan


def test_a_window_is_scored_by_rules_or_by_a_model(spark):
    df, _ = make_log(spark, 200)
    members = chunking.intelligent(df)
    stored = tables.chunk_rows(chunking.chunk_profile(members)).cache()
    by_rules = analysis.analyze_window(stored, None, 100, members=members, limits=LOW).first()
    assert len(by_rules.threats) > 0 and by_rules.status == "success" and by_rules.model_used == "rules"
    kept = stored.count()
    assert by_rules.chunks_analyzed <= min(100, kept)

    def failing():
        def score(texts):
            raise RuntimeError("no model")
        return score

    failed = analysis.analyze_window(stored, None, 100, scorer=failing, model="m").first()
    assert failed.status == "error" and failed.summary == "Analysis failed: no model" and failed.error == "no model"
    assert failed.model_used == "m" and failed.seconds >= 0 and list(failed.threats) == []
    none = analysis.analyze_window(stored.limit(0), 1, 10, members=members).first()
    assert none.chunks_analyzed == 0 and none.summary == analysis.NO_LOGS


def test_two_embedding_tiers(spark):
    df, _ = make_log(spark, 120)

    def fast():
        return lambda texts: np.tile([1.0, 0.0], (len(texts), 1)).astype(np.float32)

    def slow():
        return lambda texts: np.array([[len(t or ""), 1.0, 2.0] for t in texts], np.float32)

    done = analysis.analyze_batches(df, limits=LOW, embedder=fast, summary_embedder=slow)
    sizes = lambda d: {r.n for r in d.select(F.size("embedding").alias("n")).collect()}
    assert sizes(done.individual_logs) == {2}
    assert sizes(done.group_summaries) == {3} and sizes(done.analysis_summaries) == {3}
    assert done.context.groupBy("kind").count().count() == 3


def test_call_settings_reach_the_scorer(spark):
    def scorer(call):
        return lambda texts: [f"{call.system}|{call.temperature}|{call.max_tokens}" for _ in texts]

    asked = spark.createDataFrame([(1, "p")], "k int, prompt string")
    call = prompts.ModelCall("be brief", 0.7, 99)
    assert prompts.score_prompts(asked, scorer, ["k"], settings=call).first().reply == "be brief|0.7|99"
    assert EngineConfig(temperature=0.3, max_tokens=7).model_call == prompts.ModelCall(temperature=0.3, max_tokens=7)
