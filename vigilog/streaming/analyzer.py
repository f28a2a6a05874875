"""The continuous analyzer: text segments to stored entries, full batches, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from vigilog.config import EngineConfig
from vigilog.functions.embedding import EmbedderFactory
from vigilog.operators import batching, prompts, rules
from vigilog.operators.filtering import keep_entries
from vigilog.operators.parsing import parse_log
from vigilog.plans.analysis import analyze_batches
from vigilog.schema import ACCESS_LOG
from vigilog.session import materialize
from vigilog.sources.follow import follow_lines
from vigilog.sources.logs import number_lines, stream_lines
from vigilog.sources.tables import TABLES, individual_rows
from vigilog.streaming.epochs import EpochTable
from vigilog.streaming.jobs import start

#: Stored table -> part of an analysis; the entries themselves are stored as they come.
WRITTEN = {"group_summaries": "group_summaries", "analysis_summaries": "analysis_summaries",
           "threat_alerts": "alerts", "analysis_runs": "runs"}
#: Earlier batches whose summaries a batch sees at most.
HISTORY = 5
_CUT = T.StructType([*ACCESS_LOG.fields, T.StructField("batch_id", T.LongType()),
                     T.StructField("position", T.IntegerType())])


def run_stream(spark: SparkSession, path: str, root: str, checkpoint: str,
               source: str = "access.log", config: EngineConfig | None = None,
               limits: rules.Thresholds | None = None, embedder: EmbedderFactory | None = None,
               scorer: prompts.ScorerFactory | None = None, max_files: int | None = None,
               trigger: dict | None = None, follow: str | None = None,
               summary_embedder: EmbedderFactory | None = None) -> StreamingQuery:
    """Follow closed log segments in `path` as one log named `source` and analyse it on the way.

    With `follow`, `path` is a growing file, or a folder of them, read from its "end" or from its
    "beginning" on.

    Each micro-batch: lines are numbered on from those before, parsed and filtered; entries wait
    until a batch is full; full batches are analysed with the stored summaries as history; entries,
    groups, summaries, alerts and runs are stored. What a micro-batch writes lies in folders named
    by its number and is overwritten when it is replayed, so a restart neither loses nor repeats
    rows and nothing stored is searched; folders are merged as their number grows. Segments of one micro-batch follow each other in the order
    of their names. Batches and alerts equal those of `analyze_batches` over the whole log.
    """
    config = config or EngineConfig()
    size = config.buffer_size

    hand_over = {name: EpochTable(spark, root, name, schema) for name, schema in (
        ("_state", "lines BIGINT, batches BIGINT"), ("_waiting", ACCESS_LOG), ("_entries", ACCESS_LOG),
        ("_cut", _CUT))}
    kept = {name: _table(spark, root, name) for name in ("individual_logs", *WRITTEN)}

    def write(rows: DataFrame, epoch: int) -> None:
        for table in kept.values():
            table.begin(epoch)
        for table in hand_over.values():
            table.keep_last(epoch)
        state = hand_over["_state"].of(epoch - 1).first()
        lines, batches = (state.lines, state.batches) if state else (0, 0)
        entries, total = _entries(rows, lines, source, config)
        new = hand_over["_entries"].put(entries, epoch)
        rows_of_new = kept["individual_logs"].put(individual_rows(new, embedder), epoch)
        waited = hand_over["_waiting"].of(epoch - 1)
        arrived = waited.unionByName(new)
        cut = hand_over["_cut"].put(
            batching.assign_batches(arrived, size, include_partial=True, stored=True), epoch)
        full = (cut.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") == size).select("source", "batch_id"))
        done = cut.join(full, ["source", "batch_id"], "left_semi").withColumn(
            "batch_id", F.col("batch_id") + batches)
        waiting = hand_over["_waiting"].put(cut.join(full, ["source", "batch_id"], "left_anti"), epoch)
        # Entries are embedded once, as they are stored; only the few that waited are again.
        known = rows_of_new.unionByName(materialize(individual_rows(waited, embedder), "waited"))
        individual = known.join(F.broadcast(waiting.select("source", "line_number")),
                                ["source", "line_number"], "left_anti").select(*known.columns)
        # A batch sees the summaries of a few batches before it: the filter reaches the Parquet scan.
        history = kept["analysis_summaries"].upto(epoch, epoch).filter(F.col("batch_id") >= batches - HISTORY)
        found = analyze_batches(done.drop("batch_id", "position"), config, limits, embedder, scorer,
                                history, batched=done, summary_embedder=summary_embedder,
                                individual=individual)
        for name, part in WRITTEN.items():
            kept[name].put(getattr(found, part), epoch)
        hand_over["_state"].put(spark.createDataFrame([(lines + total, batches + full.count())],
                                                      "lines BIGINT, batches BIGINT"), epoch)

    lines = follow_lines(spark, path, follow) if follow else stream_lines(spark, path, max_files)
    return start(lines, write, checkpoint, trigger)


def _entries(rows: DataFrame, lines: int, source: str, config: EngineConfig
             ) -> tuple[DataFrame, int]:
    """Accepted entries of a micro-batch as lines of one log, and its number of lines."""
    numbered = number_lines(rows)
    sizes = numbered.groupBy("source").agg(F.max("line_number").alias("n"))     # one per segment
    order = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_start"))
    one = numbered.join(F.broadcast(starts), "source").select(
        F.lit(source).alias("source"),
        (F.col("line_number") + F.col("_start") + lines).alias("line_number"), "value")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return keep_entries(parse_log(one), config), total


def _table(spark: SparkSession, root: str, name: str) -> EpochTable:
    return EpochTable(spark, root, name, TABLES[name])


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table that `run_stream` has written so far."""
    return _table(spark, root, name).all()
