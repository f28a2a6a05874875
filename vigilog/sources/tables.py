"""Stored tables: typed append, idempotent append, lookup, counts, retention, reset."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from vigilog import schema
from vigilog.config import EXCLUDED_PATH_HINTS
from vigilog.functions import text
from vigilog.functions.embedding import EmbedderFactory, with_embedding
from vigilog.session import folders, remove

TABLES: dict[str, T.StructType] = {
    "individual_logs": schema.INDIVIDUAL_LOGS,
    "group_summaries": schema.GROUP_SUMMARIES,
    "analysis_summaries": schema.ANALYSIS_SUMMARIES,
    "chunks": schema.CHUNKS,
    "analysis_runs": schema.ANALYSIS_RUNS,
    "threat_alerts": schema.THREAT_ALERTS,
}
COLLECTIONS = ("individual_logs", "group_summaries", "analysis_summaries", "chunks")
EXPIRING = ("individual_logs", "group_summaries", "analysis_summaries")
KEYS = {"individual_logs": "id", "group_summaries": "id", "analysis_summaries": "id",
        "chunks": "chunk_id", "analysis_runs": "run_id", "threat_alerts": "alert_id"}
TIMES = {"chunks": "end_time"}


# --- rows to store --------------------------------------------------------------------------

def individual_rows(entries: DataFrame, embedder: EmbedderFactory | None = None) -> DataFrame:
    """One row per entry: a stable id, the sentence and its vector."""
    rows = entries.select(
        F.sha2(F.concat_ws("#", "source", F.col("line_number").cast("string")), 256).alias("id"),
        "ts", "source", "line_number", "client_ip", "status_code", "path", "method",
        text.sentence().alias("document"), F.to_date("ts").alias("ingest_date"))
    return with_embedding(rows, "document", embedder).to(schema.INDIVIDUAL_LOGS)


def group_rows(summaries: DataFrame, as_of: DataFrame, embedder: EmbedderFactory | None = None
               ) -> DataFrame:
    """One row per group summary, dated by the end of its batch (`source, batch_id, ts`)."""
    rows = summaries.join(as_of, ["source", "batch_id"]).select(
        F.concat("source", F.lit("#batch_"), F.col("batch_id").cast("string"), F.lit("_"),
                 "group_id").alias("id"),
        "ts", "source", "batch_id", "group_id", F.col("n").alias("log_count"),
        F.col("summary_text").alias("document"), F.to_date("ts").alias("ingest_date"))
    return with_embedding(rows, "document", embedder).to(schema.GROUP_SUMMARIES)


def summary_rows(summaries: DataFrame, embedder: EmbedderFactory | None = None) -> DataFrame:
    """One row per analysed batch."""
    rows = summaries.select(
        F.concat("source", F.lit("#analysis_batch_"), F.col("batch_id").cast("string"))
        .alias("id"),
        F.col("last_entry.ts").alias("ts"), "source", "batch_id", "threats_found", "document",
        F.to_date("last_entry.ts").alias("ingest_date"))
    return with_embedding(rows, "document", embedder).to(schema.ANALYSIS_SUMMARIES)


def chunk_rows(profiles: DataFrame, embedder: EmbedderFactory | None = None) -> DataFrame:
    rows = profiles.withColumn("ingest_date", F.to_date("end_time"))
    return with_embedding(rows, "document", embedder).to(schema.CHUNKS)


# --- operators on stored rows -----------------------------------------------------------------


def collection_counts(collections: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
              for name, df in collections.items()]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total


def inspect_samples(collections: dict[str, DataFrame], k: int = 5,
                    hints: tuple[str, ...] = EXCLUDED_PATH_HINTS) -> DataFrame:
    """Total and first `k` documents of every collection, with the noise hints they contain."""
    parts = []
    for name, df in collections.items():
        key = KEYS[name]
        first = (df.orderBy(key).limit(k).select(F.col(key).alias("id"), "document")
                 .withColumn("total", df.agg(F.count(F.lit(1))).scalar()))
        parts.append(first.select(
            F.lit(name).alias("collection"), "total",
            F.row_number().over(Window.orderBy("id")).cast("bigint").alias("sample"), "id",
            F.concat(F.substring("document", 1, 400), F.when(
                F.length("document") > 400, F.lit("...")).otherwise(F.lit(""))).alias("preview"),
            F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(
                F.lower("document"), F.lower(h))).alias("hints")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def new_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, each key once: a replayed batch adds nothing.

    A key always has the same ingest date, so only the stored dates the new rows span are read.
    """
    if "ingest_date" in rows.columns:
        day = F.col("ingest_date")
        stored = stored.filter(day.between(rows.agg(F.min("ingest_date")).scalar(),
                                           rows.agg(F.max("ingest_date")).scalar()))
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(
        *rows.columns)


def cutoff(as_of: Column, max_age: timedelta) -> Column:
    return F.timestamp_seconds(F.unix_seconds(as_of) - int(max_age.total_seconds()))


class TableStore:
    """Parquet tables below one root, in folders by `ingest_date` where they have it.

    Retention has two halves. Readers pass the time from which rows count, which prunes folders and
    filters the rest. `expire` deletes the folders of whole days before that time: no row is
    copied, and what is appended meanwhile stays, as it goes to files that no one touches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; files carry a Bloom filter of the ids, so that a lookup by id skips them."""
        writer = (rows.to(TABLES[name]).write.mode("append")
                  .option(f"parquet.bloom.filter.enabled#{KEYS[name]}", "true"))
        if "ingest_date" in TABLES[name].names:
            writer = writer.partitionBy("ingest_date")
        writer.parquet(self._path(name))

    def append_new(self, name: str, rows: DataFrame) -> None:
        """Append the rows whose key is not stored yet."""
        self.append(name, new_rows(rows, self.read(name), KEYS[name]))

    def read(self, name: str, since: Column | None = None) -> DataFrame:
        """The stored rows, or those from `since` on."""
        try:
            rows = self.spark.read.schema(TABLES[name]).parquet(self._path(name))
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])
        if since is None:
            return rows
        if "ingest_date" in rows.columns:
            rows = rows.filter(F.col("ingest_date") >= F.to_date(since))
        return rows.filter(F.col(TIMES.get(name, "ts")) >= since)

    def get(self, name: str, key: str) -> DataFrame:
        """Point lookup by id; the predicate reaches the Parquet scan and its Bloom filters."""
        return self.read(name).filter(F.col(KEYS[name]) == key)

    def expire(self, name: str, since: Column) -> None:
        """Delete the days that end before `since`."""
        day = str(self.spark.range(1).select(F.to_date(since)).first()[0])
        for folder in folders(self.spark, self._path(name)):
            if folder.startswith("ingest_date=") and folder.partition("=")[2] < day:
                remove(self.spark, f"{self._path(name)}/{folder}")

    def truncate(self, *names: str) -> None:
        for name in names or tuple(TABLES):
            remove(self.spark, self._path(name))

    def cleanup(self, as_of: Column, max_age: timedelta) -> None:
        """Delete what is older than `max_age` in the three context collections, by whole days."""
        for name in EXPIRING:
            self.expire(name, cutoff(as_of, max_age))

    def counts(self) -> DataFrame:
        return collection_counts({name: self.read(name) for name in COLLECTIONS})
