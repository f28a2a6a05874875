"""Continuous ingest, count batches, recent statistics, de-duplication and late lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from vigilog.config import EngineConfig
from vigilog.functions import text
from vigilog.functions.embedding import EmbedderFactory
from vigilog.operators.filtering import keep_entries
from vigilog.operators.parsing import parse_log
from vigilog.sources.numbering import rank_lines
from vigilog.sources.tables import TABLES, individual_rows
from vigilog.streaming.epochs import EpochTable


def accepted(lines: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Parsed and filtered entries of a stream; stateless."""
    return keep_entries(parse_log(lines), config)


def store_individual(entries: DataFrame, root: str, checkpoint: str,
                     embedder: EmbedderFactory | None = None, trigger: dict | None = None
                     ) -> StreamingQuery:
    """Store every accepted entry with its sentence and vector; a replayed batch adds nothing.

    A micro-batch owns its folder, so nothing stored is searched for its ids; `stored_individual`
    reads the rows.
    """
    def write(rows: DataFrame, epoch: int) -> None:
        table = _individual(rows.sparkSession, root)
        table.begin(epoch)
        table.put(individual_rows(rows, embedder), epoch)

    return start(entries, write, checkpoint, trigger)


def _individual(spark: SparkSession, root: str) -> EpochTable:
    return EpochTable(spark, root, "individual_logs", TABLES["individual_logs"])


def stored_individual(spark: SparkSession, root: str, since: Column | None = None) -> DataFrame:
    """The rows that `store_individual` has written so far, from `since` on."""
    rows = _individual(spark, root).all()
    return rows if since is None else rows.filter(
        (F.col("ingest_date") >= F.to_date(since)) & (F.col("ts") >= since))


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
          trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    return (df.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def write_parquet(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
                  ) -> StreamingQuery:
    return (df.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def flush_batches(entries: DataFrame, root: str, checkpoint: str, size: int = 50,
                  on_batches: Callable[[DataFrame, int], None] | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Hand on the entries of full batches: a source's batch is full at `size` entries.

    Every micro-batch ranks its entries together with the few (fewer than `size` per source)
    left waiting by the one before. The ranking is the distributed one, so a source that
    sends most of the lines is still spread over many tasks. What a micro-batch writes lies in
    folders named by its number, which a replay overwrites and later ones merge. `on_batches` gets
    the entries of the batches that just became full.
    """
    schema = entries.schema
    cut_schema = T.StructType(
        [*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("_full", T.BooleanType())])

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        cut = EpochTable(spark, root, "cut", cut_schema)
        counts = EpochTable(spark, root, "done", "source STRING, batches BIGINT")
        full = _batches(spark, root, schema)
        full.begin(epoch)
        cut.keep_last(epoch)
        counts.keep_last(epoch)
        done = counts.of(epoch - 1)
        waiting = cut.of(epoch - 1).filter(~F.col("_full")).select(*rows.columns)
        ranked = rank_lines(waiting.unionByName(rows), "_rn", "_rows").join(
            done.withColumnRenamed("batches", "_done"), "source", "left")
        turn = F.floor(F.col("_rn") / size)
        new = cut.put(ranked.withColumn("batch_id", F.coalesce("_done", F.lit(0)) + turn)
                      .withColumn("_full", (turn + 1) * size <= F.col("_rows")), epoch)
        ready = full.put(new.filter("_full").drop("_full"), epoch)
        counts.put(ready.groupBy("source").agg((F.max("batch_id") + 1).alias("batches"))
                   .unionByName(done).groupBy("source").agg(F.max("batches").alias("batches")), epoch)
        if on_batches:
            on_batches(ready, epoch)

    return start(entries, write, checkpoint, trigger)


def _batches(spark: SparkSession, root: str, schema: T.StructType) -> EpochTable:
    return EpochTable(spark, root, "full", T.StructType(
        [*schema.fields, T.StructField("batch_id", T.LongType())]))


def full_batches(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Entries, of the given schema, of all batches `flush_batches` has completed so far."""
    return _batches(spark, root, schema).all()


def recent_stats(entries: DataFrame, window: str = "5 minutes", slide: str | None = None,
                 delay: str = "10 minutes") -> DataFrame:
    """Requests, failures and distinct addresses (estimated) per event-time window and group."""
    group = text.batch_group(F.col("status_code"), F.col("client_ip")).alias("group_id")
    return (entries.withWatermark("ts", delay)
            .groupBy(F.window("ts", window, slide or window), group)
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"),
                 F.max("ts").alias("max_ts"),
                 F.count_if(F.col("status_code").isin(401, 403)).alias("auth_failures"),
                 F.approx_count_distinct("client_ip").alias("addresses"))
            .select(F.col("window.start").alias("window_start"), "group_id", "n", "min_ts",
                    "max_ts", "auth_failures", "addresses"))


def keep_stats(stats: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
               ) -> StreamingQuery:
    """Write `recent_stats` as they change: one folder per micro-batch, open windows included."""
    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return start(stats, write, checkpoint, trigger, mode="update")


def all_stats(spark: SparkSession, path: str, window_seconds: int = 300, delay_seconds: int = 600
              ) -> DataFrame:
    """The latest row of every window and group that `keep_stats` wrote, with `open`: whether the
    window ends after the newest time seen minus the delay, so that rows may still come."""
    written = spark.read.parquet(path)
    values = [c for c in written.columns if c not in ("window_start", "group_id", "epoch")]
    latest = written.groupBy("window_start", "group_id").agg(
        F.max_by(F.struct(*values), "epoch").alias("last"))
    newest = written.agg(F.max(F.unix_seconds("max_ts")).alias("_newest"))
    end = F.unix_seconds("window_start") + window_seconds
    return latest.crossJoin(F.broadcast(newest)).select(
        "window_start", "group_id", "last.*", (end > F.col("_newest") - delay_seconds).alias("open"))


def visits(entries: DataFrame, gap: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of requests per address, ended by a pause of `gap`."""
    return (entries.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap), "client_ip")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("session_window.start").alias("start"), "client_ip", "n"))


def unique_rows(rows: DataFrame, key: str = "id", delay: str = "10 minutes") -> DataFrame:
    """First row of every id among those within `delay` of each other."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def split_late(entries: DataFrame, root: str, checkpoint: str, delay_seconds: int = 600,
               trigger: dict | None = None) -> StreamingQuery:
    """Mark entries that are later than the newest seen, minus the delay; `late_split` reads them.

    A micro-batch is evaluated once, as it is written with its marks. The newest time per source
    so far is handed on from one to the next. What it writes lies in folders named by its number.
    """
    schema = T.StructType([*entries.schema.fields, T.StructField("late", T.BooleanType())])

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        marks = EpochTable(spark, root, "marks", "source STRING, newest BIGINT")
        marked = EpochTable(spark, root, "entries", schema)
        marked.begin(epoch)
        marks.keep_last(epoch)
        before = marks.of(epoch - 1)
        late = F.coalesce(F.unix_seconds("ts") < F.col("newest") - delay_seconds, F.lit(False))
        new = marked.put(rows.join(before, "source", "left").withColumn("late", late), epoch)
        marks.put(new.groupBy("source").agg(F.max(F.unix_seconds("ts")).alias("newest"))
                  .unionByName(before).groupBy("source").agg(F.max("newest").alias("newest")), epoch)

    return start(entries, write, checkpoint, trigger)


def late_split(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Entries, of the given schema, that `split_late` has seen so far, with `late`."""
    return EpochTable(spark, root, "entries", T.StructType(
        [*schema.fields, T.StructField("late", T.BooleanType())])).all()
