"""Times the headline jobs on the synthetic log; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_REPEAT (rounds, best
one counts).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("vigilog-bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "8g")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vigilog-bench-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from vigilog.operators import batching, chunking, filtering, parsing, rules, vectors
    from vigilog.plans import analysis, catalog
    from vigilog.plans.oracle import BATCH_LOW, LOW
    from vigilog.session import configure, materialize, scratch_root
    from vigilog.sources import logs, tables

    configure(spark)
    # The log as a cluster would find it: split over as many files as there are cores.
    raw = materialize(logs.synthetic_lines(spark, SF_DIR).repartitionByRange(
        int(CPUS), "line_number"), "raw")
    lines = raw.count()
    access_log = materialize(parsing.parse_log(raw), "access_log")
    accepted = filtering.keep_entries(access_log)

    def grouped() -> DataFrame:
        return batching.group_entries(batching.assign_batches(accepted, stored=True))

    text_path = f"{scratch_root(spark)}/text"
    raw.select("value").write.text(text_path)
    entries_row = materialize(tables.individual_rows(accepted), "entry_rows")
    store = tables.TableStore(spark, f"{scratch_root(spark)}/store")
    jobs = {
        "scan_lines": lambda: drain(logs.scan_lines(spark, text_path)),
        "append": lambda: store.append("individual_logs", entries_row),
        "parse": lambda: drain(parsing.parse_log(raw)),
        "parse_filter": lambda: drain(filtering.keep_entries(parsing.parse_log(raw))),
        "filter_reasons": lambda: drain(filtering.reason_counts(access_log)),
        "batch_by_count": lambda: drain(batching.assign_batches(accepted, stored=True)),
        "group_basic_stats": lambda: drain(batching.group_stats(grouped())),
        "parse_to_group_summaries": lambda: drain(batching.summarize_groups(
            batching.group_entries(batching.assign_batches(
                filtering.keep_entries(parsing.parse_log(raw)))))),
        "group_summaries": lambda: drain(batching.summarize_groups(grouped())),
        "chunk_time_window": lambda: drain(chunking.window_profile(
            chunking.time_window(access_log))),
        "chunk_intelligent": lambda: drain(chunking.chunk_profile(
            chunking.intelligent(access_log, stored=True))),
        "rule_threats": lambda: drain(rules.find_threats(access_log, rules.Thresholds(**LOW))),
        "embed_entries": lambda: drain(tables.individual_rows(accepted)),
        "cosine_topk": lambda: drain(vectors.nearest(
            catalog.corpus(spark, SF_DIR), catalog.centroids(spark, SF_DIR), 10)),
        "analyze_batches": lambda: drain(analysis.analyze_batches(
            accepted, limits=rules.Thresholds(**BATCH_LOW)).alerts),
    }
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    jobs = {n: run for n, run in jobs.items() if not only or n in only}
    best: dict[str, float] = {}
    for _ in range(REPEAT):
        for name, run in jobs.items():
            began = time.perf_counter()
            run()
            best[name] = min(best.get(name, 1e9), time.perf_counter() - began)
    best = {name: round(seconds, 3) for name, seconds in best.items()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(best.values()), 3), "unit": "sec",
        "queries": best, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "lines": lines,
        "cpus": int(CPUS),
        "lines_per_second": {name: round(lines / best[name]) for name in (
            "parse_filter", "parse_to_group_summaries", "rule_threats", "analyze_batches") if name in best}}))
    spark.stop()


if __name__ == "__main__":
    main()
