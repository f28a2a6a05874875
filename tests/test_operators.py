"""Operators against small plain-Python restatements on random input."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators import batching, chunking, profiles, rules, threats, vectors
from vigilog.operators.batching import BATCH, GROUP
from vigilog.plans import analysis, catalog
from vigilog.schema import ACCESS_LOG
from vigilog.sources import numbering

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_log(spark, n=400, seed=1, sources=("a", "b"), spread=900, ips=6):
    rng = random.Random(seed)
    rows = []
    for source in sources:
        for i in range(n):
            ts = START + timedelta(seconds=rng.randrange(spread))
            ip = rng.choice([None] + [f"10.0.{k % 3}.{k}" for k in range(ips)])
            path = rng.choice([None, "", "/", "/login", "/a/../b", "/x"])
            status = rng.choice([200, 200, 301, 401, 403, 404, 500])
            rows.append((source, i + 1, ts, rng.choice(["+00:00", "-07:00", None]), ip,
                         rng.choice(["GET", "POST", None]), path,
                         rng.choice([None, "q=1", "id=1 UNION select"]), "HTTP/1.1", status, 5,
                         None, rng.choice([None, "curl/8", "Mozilla Firefox/1.2 Linux"]), None,
                         f"raw {source} {i}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ACCESS_LOG)
    return df, sorted((dict(zip(ACCESS_LOG.names, r)) for r in rows),
                      key=lambda r: (r["source"], r["line_number"]))


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark)


def by_source(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["source"]].append(r)
    return found


def in_time(rows):
    return sorted(rows, key=lambda r: (r["ts"], r["line_number"]))


def test_numbering_over_many_blocks(spark, log, monkeypatch):
    df, rows = log
    monkeypatch.setattr(numbering, "BLOCKS_PER_SPAN", 3)
    monkeypatch.setattr(numbering, "LINES_PER_BLOCK", 7)
    odd = df.filter(F.col("status_code") != 200)
    found = {(r.source, r.line_number): (r.rn, r.total)
             for r in numbering.rank_lines(odd, "rn", "total").collect()}
    expected = {}
    for source, items in by_source(r for r in rows if r["status_code"] != 200).items():
        for i, r in enumerate(items):
            expected[source, r["line_number"]] = (i, len(items))
    assert found == expected


def test_a_hot_second_is_cut_by_line_number(spark, monkeypatch):
    monkeypatch.setattr(numbering, "LINES_PER_BLOCK", 50)
    at = "timestamp_seconds(1700000000 + CASE WHEN id BETWEEN 20 AND 950 THEN 7 ELSE id % 5 END)"
    df = spark.range(1000).selectExpr("'a' AS source", f"{at} AS ts", "999 - id AS line_number")
    got = numbering.rank_by_time(df, ["source"], "pos")
    want = sorted(df.collect(), key=lambda r: (r.ts, r.line_number))
    assert [r.line_number for r in got.orderBy("pos").collect()] == [r.line_number for r in want]
    assert got.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (0, 999, 1000)
    blocks = []
    monkeypatch.setattr(numbering, "materialize", lambda d, name, **_: blocks.append((name, d)) or d)
    numbering.rank_by_time(df, ["source"], "pos")
    counts = next(d for name, d in blocks if name == "blocks")
    assert counts.agg(F.max("_n")).first()[0] <= 50             # no task ranks more


def test_fractions_of_seconds_keep_their_order(spark):
    df = spark.range(400).selectExpr(
        "'a' AS source", "timestamp_micros(1700000000000000 + (id * 7919) % 400 * 5000) AS ts", "id AS line_number")
    want = [r.line_number for r in sorted(df.collect(), key=lambda r: (r.ts, r.line_number))]
    assert [r.line_number for r in numbering.rank_by_time(df, ["source"]).orderBy("rn").collect()] == want


def test_an_hour_s_windows_over_ten_years(spark, monkeypatch):
    """3,650 blocks: the tree has three levels, and no group holds more than 16 of a source's tables."""
    rng = __import__("random").Random(8)
    seconds = sorted(rng.sample(range(3650 * 86_400), 9_000))
    df = spark.createDataFrame([("a", 1_400_000_000 + s) for s in seconds], "source string, s bigint").select(
        "source", F.timestamp_seconds("s").alias("ts"))
    trees = []
    real = chunking.materialize
    monkeypatch.setattr(chunking, "materialize", lambda d, name: trees.append((name, real(d, name))) or trees[-1][1])
    got = {r.sec - 1_400_000_000: (r.window_start - 1_400_000_000, r.window_index)
           for r in chunking.window_starts(df, 3600).collect()}
    start, index, want = None, -1, {}
    for s in seconds:
        if start is None or s > start + 3600:
            start, index = s, index + 1
        want[s] = (start, index)
    assert got == want
    levels = [d for name, d in trees if name == "window-tree"]
    assert len(levels) == 3
    assert all(d.agg(F.max(F.size("parts"))).first()[0] <= 16 for d in levels)


@pytest.mark.parametrize("window, spread, n, span", [
    (60, 900, 300, 86_400), (3, 40, 60, 16), (10, 5_000, 200, 64), (0, 50, 60, 8), (7, 300, 300, 32)])
def test_greedy_windows(spark, monkeypatch, window, spread, n, span):
    monkeypatch.setattr(chunking, "SECONDS_PER_BLOCK", span)
    df, rows = make_log(spark, n, seed=window, spread=spread)
    found = {(r.source, r.line_number): (r.window_start, r.window_index)
             for r in chunking.time_window(df, window).collect()}
    expected = {}
    for source, items in by_source(rows).items():
        start, index = None, -1
        for r in in_time(items):
            sec = int(r["ts"].timestamp())
            if start is None or sec > start + window:
                start, index = sec, index + 1
            expected[source, r["line_number"]] = (start, index)
    assert found == expected


def test_chunkers(spark, log):
    df, rows = log
    fixed = chunking.chunk_profile(chunking.chunk(df, "fixed_size", chunk_size=30)).withColumn(
        "codes", F.map_keys("status_codes")).collect()
    assert {r.chunk_id for r in fixed if r.source == "a"} == {
        f"fixed_{i}_{min(i + 30, 400)}" for i in range(0, 400, 30)}
    first = next(r for r in fixed if r.source == "a" and r.chunk_id == "fixed_0_30")
    items = by_source(rows)["a"][:30]
    assert first.start_time.replace(tzinfo=timezone.utc) == items[0]["ts"]
    assert first.end_time.replace(tzinfo=timezone.utc) == items[-1]["ts"]
    assert first.status_codes == dict(Counter(r["status_code"] for r in items))
    assert first.codes == list(Counter(r["status_code"] for r in items))
    assert first.unique_ips == sorted({r["client_ip"] for r in items if r["client_ip"]})
    smart = chunking.chunk(df, "intelligent", chunk_size=8).groupBy("source", "chunk_id").count()
    assert smart.agg(F.max("count"), F.sum("count")).first()[:] == (8, 800)
    with pytest.raises(ValueError):
        chunking.chunk(df, "by_moon_phase")
    chunking.register_chunker("everything", lambda d: d.withColumn("chunk_id", F.lit("all")))
    assert chunking.chunk(df, "everything").select("chunk_id").distinct().count() == 1


def test_batches_and_summaries(spark, log):
    df, rows = log
    batched = batching.assign_batches(df, 60)
    assert batched.groupBy(*BATCH).count().agg(F.min("count"), F.count("*")).first()[:] == (60, 12)
    assert batching.assign_batches(df, 60, include_partial=True).count() == 800
    grouped = batching.group_entries(batched)
    found = {(r.source, r.batch_id, r.group_id): r
             for r in batching.summarize_groups(grouped).collect()}
    expected = defaultdict(list)
    for source, items in by_source(rows).items():
        for b in range(len(items) // 60):
            for r in in_time(items[b * 60:(b + 1) * 60]):
                status, ip = r["status_code"], r["client_ip"]
                name = ("4xx_errors" if status // 100 == 4 else "5xx_errors" if status // 100 == 5
                        else f"cidr_{ip.rsplit('.', 1)[0]}.0/24" if status == 200 and ip else "other_status")
                expected[source, b, name].append(r)
    assert set(found) == set(expected)
    for key, items in expected.items():
        r = found[key]
        assert r.n == len(items)
        assert [(i.value, i.n) for i in r.methods] == Counter(
            x["method"] for x in items if x["method"]).most_common()
        assert [(i.value, i.n) for i in r.top_paths] == Counter(
            x["path"] for x in items if x["path"]).most_common(5)
        if not key[2].startswith("cidr_"):
            assert [(i.value, i.n) for i in r.top_ips] == Counter(
                str(x["client_ip"]) for x in items).most_common(3)
        assert r["first"].tz_offset == items[0]["tz_offset"]
        last = next(x for x in items if x["ts"] == items[-1]["ts"])
        assert (r["last"].tz_offset, r.last_entry.tz_offset) == (last["tz_offset"], items[-1]["tz_offset"])
        assert r.auth_failures == sum(x["status_code"] in (401, 403) for x in items)
    general = {(r.source, r.batch_id, r.group_id, r["rank"]): (r.value, r.n) for r in profiles.top_values(
        grouped, GROUP, *batching.summary_lists()["top_ips"]).collect()}
    assert general == {(*key, i + 1): (x.value, x.n) for key, r in found.items()
                       for i, x in enumerate(r.top_ips)}


def test_evidence(spark, log):
    df, rows = log
    batched = batching.assign_batches(df, 50)
    cases = [(["10.0.0.0"], []), (["9.9.9.9"], ["/log"]), ([], ["/x", "zzz"]), ([], []),
             (["9.9.9.9"], []), (None, None)]
    found = spark.createDataFrame(
        [(s, b, i + 1, "Odd-Type", None, None, "d", ["e"], None, ips, paths)
         for s in "ab" for b in range(8) for i, (ips, paths) in enumerate(cases)],
        "source STRING, batch_id BIGINT, threat_no INT, type STRING, severity STRING, "
        "confidence DOUBLE, description STRING, evidence ARRAY<STRING>, recommendation STRING, "
        "source_ips ARRAY<STRING>, target_paths ARRAY<STRING>")
    alerts = {r.alert_id: r for r in analysis.alert_rows(
        found, batched, batching.batch_profile(batched)).collect()}
    assert len(alerts) == 2 * 8 * len(cases)
    for source, items in by_source(rows).items():
        for b in range(8):
            batch = in_time(items[b * 50:(b + 1) * 50])
            for i, (ips, paths) in enumerate(cases):
                ips, paths, hits = ips or [], paths or [], []
                for r in batch:
                    if ips and r["client_ip"] in ips:
                        hit = True
                    elif paths and r["path"]:
                        hit = any(p in r["path"] for p in paths)
                    else:
                        hit = not ips and not paths
                    if hit:
                        hits.append(r)
                hits = hits[:15]
                alert = alerts[f"{source}#{b}#{i + 1}"]
                assert [s.raw_line for s in alert.evidence.sample_logs] == [r["raw_line"] for r in hits]
                want = sorted({r["client_ip"] for r in hits if r["client_ip"]}) or [
                    ip for ip, _ in Counter(r["client_ip"] for r in batch if r["client_ip"]).most_common(10)]
                assert alert.source_ips == want
                want = sorted({r["path"].strip() for r in hits if r["path"]}) or [
                    p for p, _ in Counter(r["path"] for r in batch if r["path"]).most_common(20)]
                assert alert.target_paths == want
                assert (alert.threat_type, alert.description) == ("other", "[odd_type] d")
                assert (alert.severity, alert.confidence) == ("medium", 0.5)


def test_flood_counts_two_trailing_seconds(spark, log):
    df, rows = log
    limits = rules.Thresholds(ddos=2)
    found = {(r.source, r.window_start, r.client_ip): r.n
             for r in rules.find_threats(df, limits, ("ddos",)).collect()}
    per = Counter((r["source"], r["client_ip"].rsplit(".", 1)[0] + ".0/24", int(r["ts"].timestamp()))
                  for r in rows if r["client_ip"])
    expected = defaultdict(int)
    for (source, network, sec), n in per.items():
        key = (source, sec // 300 * 300, network)
        expected[key] = max(expected[key], n + per[source, network, sec - 1])
    assert found == {k: n for k, n in expected.items() if n >= 2}


def test_replies(spark):
    cases = {
        '{"threats":[{"type":"ddos"}],"summary":"s"}': ("ok", "s", ["ddos"]),
        '{"threats":[]}': ("ok", "Analysis complete.", []),
        '[{"type":"ddos"},{"x":1},3]': ("ok", "Analysis complete.", ["ddos"]),
        '{"a":1}': ("unexpected", "Parse failed (unexpected format).", []),
        '"text"': ("unexpected", "Parse failed (unexpected format).", []),
        "```json\n{}\n```": ("invalid", "Parse failed (invalid JSON).", []),
        '{"threats":[{"type"': ("invalid", "Parse failed (invalid JSON).", []),
        "": ("invalid", "Parse failed (invalid JSON).", []),
        '{"threats":null}': ("ok", "Analysis complete.", []),
        '\n {"threats":[{"type":"bot","source_ips":"x"},{"type":"b"}],"summary":null}\n': (
            "ok", "Analysis complete.", ["bot", "b"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply STRING")
    read = threats.read_replies(df)
    types = defaultdict(list)
    for r in threats.reply_threats(read, ["reply"]).orderBy("threat_no").collect():
        types[r.reply].append(r.type)
    assert {r.reply: (r.status, r.summary, types[r.reply]) for r in read.collect()} == cases
    bot = spark.createDataFrame([("Bot Activity", "d")], "type STRING, description STRING").selectExpr(
        "*", "null severity", "cast(null as double) confidence", "null recommendation")
    assert threats.normalize(bot, alias_bot=True).first().threat_type == "bot"


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((500, 16)).astype(np.float32)
    data[7] = 0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)],
                                   "id BIGINT, embedding ARRAY<FLOAT>").repartition(5)
    queries = [(f"q{i}", rng.standard_normal(16).tolist()) for i in range(3)]
    unit = vectors.unit_rows(data.astype(float))
    exact = {}
    for name, q in queries:
        d = np.round(1 - unit @ (np.array(q) / np.linalg.norm(q)), 6)
        exact[name] = sorted((x, i) for i, x in enumerate(d))[:10]
    found = defaultdict(list)
    for r in vectors.nearest(corpus, queries, 10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.distance, r.id))
    assert dict(found) == exact
    assert vectors.nearest(corpus, queries, 0).count() == 0
    hashed = vectors.nearest_hashed(vectors.with_buckets(corpus, 16, 12, 4), queries, 10, 12, 4)
    got = {(r.query_id, r.id) for r in hashed.collect()}
    want = {(n, i) for n, hits in exact.items() for _, i in hits}
    assert len(got & want) / len(want) >= 0.8


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_hashed_search_finds_the_nearest(spark, sf):
    path = f"/root/testdata/{sf}"
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    want = pairs(catalog.cosine_topk(spark, path))
    assert len(pairs(catalog.cosine_topk_lsh(spark, path)) & want) / len(want) >= 0.9
    # A query alone must not need the buckets of others.
    indexed = vectors.with_buckets(catalog.corpus(spark, path), dim=64).cache()
    alone = [vectors.nearest_hashed(indexed, [(r.query_id, r.vector)], 10)
             for r in catalog.centroids(spark, path).collect()]
    assert len(pairs(reduce(DataFrame.unionByName, alone)) & want) / len(want) >= 0.9


def test_many_query_vectors_are_searched_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 8))
    wanted = rng.normal(size=(2500, 8))
    frame = lambda m, a, b: spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{a} BIGINT, {b} ARRAY<DOUBLE>")
    found = vectors.nearest(frame(corpus, "id", "embedding"), frame(wanted, "query_id", "vector"), 1)
    got = {int(r.query_id): r.id for r in found.collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == dict(enumerate((unit(wanted) @ unit(corpus).T).argmax(1).tolist()))


def test_batches_may_be_large(spark):
    df, _ = make_log(spark, 200)
    batched = batching.assign_batches(df, 100_000, include_partial=True)
    assert batching.batch_profile(batched).agg({"n": "sum"}).first()[0] == df.count()
