import uuid
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import make_log
from vigilog.operators import prompts
from vigilog.functions.embedding import with_embedding
from vigilog.plans import analysis
from vigilog.schema import RAW_LINES
from vigilog.session import folders, scratch_root
from vigilog.sources import logs, tables
from vigilog.streaming import analyzer, jobs

ONCE = {"availableNow": True}


@pytest.fixture
def folder(spark):
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def test_scan_numbers_lines_across_splits(spark, folder):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    spark.createDataFrame([(v,) for v in lines], "value STRING").coalesce(1).write.text(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = logs.scan_lines(spark, folder).orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in found] == lines
    assert [r.line_number for r in found] == list(range(1, 3001))


def test_store(spark, folder):
    store = tables.TableStore(spark, folder)
    df, _ = make_log(spark, 60)
    rows = tables.individual_rows(df)
    assert store.read("individual_logs").count() == 0
    store.append("individual_logs", rows)
    store.append_new("individual_logs", rows)
    assert store.read("individual_logs").count() == 120
    one = rows.first()
    assert store.get("individual_logs", one.id).first().document == one.document
    since = tables.cutoff(rows.agg(F.max("ts")).scalar(), timedelta(seconds=300))
    store.expire("individual_logs", since)
    kept = store.read("individual_logs", since).count()
    assert kept == rows.filter(F.col("ts") >= since).count() and 0 < kept < 120
    assert "PartitionFilters: [isnotnull(ingest_date" in store.read(
        "individual_logs", since)._jdf.queryExecution().executedPlan().toString()
    store.truncate()
    assert [r.n for r in store.counts().collect()] == [0, 0, 0, 0]


def test_clean_up_drops_days_and_no_row_appended_meanwhile(spark, folder, monkeypatch):
    store = tables.TableStore(spark, folder)
    df, _ = make_log(spark, 30)
    rows = tables.individual_rows(df)
    aged = lambda days: rows.select("*").withColumns({
        "ts": F.col("ts") - F.make_dt_interval(F.lit(days)),
        "ingest_date": F.date_sub("ingest_date", days), "id": F.concat("id", F.lit(f"-{days}"))})
    for days in (0, 1, 5, 9):
        store.append("individual_logs", aged(days))
    before = folders(spark, f"{folder}/individual_logs")
    newest = rows.agg(F.max("ts")).scalar()
    real = tables.remove

    def racing(session, path):          # an indexer appends while the clean-up deletes
        store.append("individual_logs", aged(0).withColumn("id", F.concat("id", F.lit("-late"))))
        real(session, path)

    monkeypatch.setattr(tables, "remove", racing)
    files = lambda: {r.f for r in store.read("individual_logs").filter(
        "id NOT LIKE '%-late'").select(F.input_file_name().alias("f")).collect()}
    held = files()
    store.cleanup(newest, timedelta(days=2))
    after = folders(spark, f"{folder}/individual_logs")
    assert set(after) < set(before) and len(after) < len(before)
    left = store.read("individual_logs")
    assert left.filter("id LIKE '%-late'").count() == 60 * (len(before) - len(after))
    assert left.filter("id LIKE '%-0'").count() == 60 and left.filter("id LIKE '%-9'").count() == 0
    assert files() < held                                        # nothing was written anew


def test_lookup_uses_bloom_filters(spark, folder):
    import pyarrow.parquet as pq

    store = tables.TableStore(spark, folder)
    df, _ = make_log(spark, 30)
    store.append("individual_logs", tables.individual_rows(df))
    name = next(r.f for r in store.read("individual_logs").select(F.input_file_name().alias("f")).collect())
    path = name.removeprefix("file://").removeprefix("file:").replace("%3D", "=")
    with open(path, "rb") as f:
        bare = f.read()
    store.truncate("individual_logs")
    tables.individual_rows(df).write.partitionBy("ingest_date").parquet(f"{folder}/individual_logs")
    plain = next(r.f for r in store.read("individual_logs").select(F.input_file_name().alias("f")).collect())
    assert pq.ParquetFile(plain.removeprefix("file://")).metadata.num_rows <= 60
    with open(plain.removeprefix("file://"), "rb") as f:
        assert len(bare) > len(f.read()) + 1000                  # the filter's bits


def write_segments(spark, folder, df, parts):
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, folder):
    jobs.write_parquet(df, f"{folder}/out", f"{folder}/state", ONCE).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def test_count_batches_span_micro_batches(spark, folder):
    df, rows = make_log(spark, 130)
    n = F.col("line_number")
    stream = write_segments(spark, folder, df, [n <= 45, (n > 45) & (n <= 120), n > 120])
    seen = []
    jobs.flush_batches(stream, folder + "-b", folder + "-c", 50, trigger=ONCE,
                       on_batches=lambda full, epoch: seen.append(full.count())).awaitTermination()
    found = {(r.source, r.line_number): r.batch_id
             for r in jobs.full_batches(spark, folder + "-b", df.schema).collect()}
    assert seen == [0, 200, 0]
    assert found == {(s, i): (i - 1) // 50 for s in "ab" for i in range(1, 101)}


def test_statistics_and_duplicates(spark, folder):
    df, rows = make_log(spark, 200)
    stream = write_segments(spark, folder, df, [F.col("line_number") > 0])
    windows = drain(spark, jobs.recent_stats(stream, delay="0 seconds"), folder + "-w")
    batch = df.groupBy(F.window("ts", "5 minutes")).count()
    closed = {r.window_start: r.n for r in windows.groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert closed and closed.items() <= {r.window.start: r["count"] for r in batch.collect()}.items()
    assert drain(spark, jobs.visits(stream), folder + "-v").columns == ["start", "client_ip", "n"]
    twice = stream.select(F.concat("source", F.col("line_number").cast("string")).alias("id"), "ts")
    doubled = twice.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c")
    assert drain(spark, jobs.unique_rows(doubled), folder + "-u").count() == 400


def test_late_lines(spark, folder):
    df, _ = make_log(spark, 100, sources=("a",), spread=100)
    moved = df.withColumn("ts", F.when(F.col("line_number") <= 50, F.col("ts") + F.expr("interval 1 hour"))
                          .otherwise(F.col("ts")))
    n = F.col("line_number")
    stream = write_segments(spark, folder, moved, [n <= 50, n > 50])
    jobs.split_late(stream, f"{folder}-t", f"{folder}-t/state", 600, ONCE).awaitTermination()
    split = jobs.late_split(spark, f"{folder}-t", moved.schema)
    assert {(r.late, r["count"]) for r in split.groupBy("late").count().collect()} == {(True, 50), (False, 50)}


def test_text_segments(spark, folder):
    raw = spark.createDataFrame([("s", i, f"l{i}") for i in range(50)], RAW_LINES)
    raw.select("value").repartition(3).write.text(folder)
    found = drain(spark, logs.stream_lines(spark, folder), folder + "-s")
    assert {r.value for r in found.collect()} == {f"l{i}" for i in range(50)}


def test_model_plug_ins(spark):
    df, _ = make_log(spark, 100)

    def embedder():
        import numpy as np
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    def scorer():
        def score(texts):
            if any("raw a 0\n" in t for t in texts):
                raise RuntimeError("model is away")
            return ['{"threats": [{"type": "bot", "source_ips": ["10.0.0.0"]}]}'] * len(texts)
        return score

    two = with_embedding(df.select(F.col("raw_line").alias("document")), "document", embedder)
    assert two.first().embedding[1] == 1.0
    done = analysis.analyze_batches(df, embedder=embedder, scorer=scorer, always_record=True)
    runs = {r.run_id: r for r in done.runs.collect()}
    assert set(runs) == {"a#0", "a#1", "b#0", "b#1"}
    failed = {k: r for k, r in runs.items() if r.status == "error"}
    assert set(failed) == {"a#0"}
    assert failed["a#0"].error_message == "model is away" and failed["a#0"].threats_found == 0
    good = [r for r in runs.values() if r.status == "success"]
    assert len(good) == 3 and all(r.threats_found == 1 for r in good)
    told = {r.batch_id: r.document for r in done.analysis_summaries.collect() if r.source == "a"}
    assert "Analysis failed: model is away" in told[0] and "failed" not in told[1]
    assert done.alerts.count() == len(good)
    assert done.prompts.filter(F.col("prompt").contains("Reply with one JSON object")).count() == 4


def test_scores_keep_going_after_a_failure(spark):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k INT, prompt STRING").coalesce(1)

    def scorer():
        def score(texts):
            if texts == ["p3"]:
                raise ValueError("no")
            return ["{}"] * len(texts)
        return score

    rows = {r.k: r for r in prompts.score_prompts(asked, scorer, ["k"], batch_rows=1).collect()}
    assert rows[3].error == "no" and rows[3].reply == ""
    assert all(rows[k].error is None for k in rows if k != 3)


def test_a_wrong_number_of_replies_is_an_error(spark):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "k INT, prompt STRING").coalesce(1)

    def scorer():
        return lambda texts: ["{}"] * (len(texts) if "p2" not in texts else len(texts) + 1)

    rows = {r.k: r for r in prompts.score_prompts(asked, scorer, ["k"]).collect()}
    assert rows[2].error == "2 replies to 1 prompts"
    assert all(rows[k].error is None and rows[k].reply == "{}" for k in rows if k != 2)


def test_tail_takes_the_last_lines_of_every_source(spark):
    from vigilog.sources.logs import tail

    lines = spark.createDataFrame(
        [("a", i, f"a{i}") for i in range(1, 31)] + [("b", i, f"b{i}") for i in range(1, 6)],
        "source STRING, line_number BIGINT, value STRING")
    got = {(r.source, r.line_number) for r in tail(lines, 10).collect()}
    assert got == {("a", i) for i in range(21, 31)} | {("b", i) for i in range(1, 6)}


def test_open_windows_are_returned_and_marked(spark):
    path = "/root/testdata/sf0.001"
    from vigilog.plans import catalog

    rows = catalog.stream_group_stats_all(spark, path).collect()
    assert sum(r.n for r in rows) == catalog.kept(spark, path).count()
    assert any(r.open for r in rows)
    closed = {tuple(r)[:4] for r in rows if not r.open}
    assert closed == {tuple(r) for r in catalog.stream_group_stats(spark, path).collect()}


def test_the_analyzer_embeds_an_entry_once(spark, tmp_path):
    """What is stored of an entry is what its batch's analysis reads; only entries that waited are
    embedded again."""
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.log").write_text("".join(
            f'10.0.0.{i % 9} - - [01/Jan/2024:00:0{part}:{i % 60:02d} +0000] "GET /admin{i % 5} HTTP/1.1" 401 5 "-" "curl/8"\n'
            for i in range(70)))
    seen = str(tmp_path / "seen")

    def counting():
        def embed(texts):
            with open(seen, "a") as f:
                f.writelines("x\n" for _ in texts)
            return np.tile([1.0, 0.0], (len(texts), 1)).astype(np.float32)
        return embed

    def other():
        return lambda texts: np.tile([1.0, 2.0, 3.0], (len(texts), 1)).astype(np.float32)

    out = str(tmp_path / "out")
    analyzer.run_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "state"), max_files=1,
                        embedder=counting, summary_embedder=other,
                        trigger={"availableNow": True}).awaitTermination()
    assert analyzer.stored(spark, out, "individual_logs").count() == 140
    assert analyzer.stored(spark, out, "analysis_summaries").count() == 2
    with open(seen) as f:                               # 140 entries, 20 that waited, phrases searched for
        assert sum(1 for _ in f) <= 140 + 20 + 2 * 4
