"""Raw log lines: text files with line numbers, the tail of a log, and a synthetic log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.schema import RAW_LINES
from vigilog.session import materialize
from vigilog.sources import ranges


def scan_lines(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """All lines of the text files under `path` with 1-based line numbers per file.

    The files are cut into byte ranges, whose table is written once. One pass counts the lines of
    each range, the other reads them with the lines before the range as offset: the text is never
    shuffled, and both passes follow the same table, whatever the settings are when they run.
    Readable are local files and the stores that pyarrow opens; `scan_text` reads all others.
    """
    return ranges.read_ranges(ranges.number_ranges(ranges.plan_ranges(spark, path, range_bytes)))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """As `scan_lines`, by Spark's own text reader: for stores that only Spark opens.

    Its splits can differ from one execution to the next, so the text is written once."""
    return number_lines(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("split"),
        F.make_valid_utf8("value").alias("value")))


#: Splits whose table may be broadcast: 64 TB of text in splits of 128 MB, about 50 MB of rows.
BROADCAST_SPLITS = 500_000


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers from 1 per source for rows `(source, split, value)` as a text scan gives them.

    Inside a split the reader keeps the line order. The rows are written with their places before
    anything is counted: two executions of the scan need not have the same splits.
    """
    placed = materialize(lines.withColumn("_place", F.monotonically_increasing_id()), "lines")
    splits = placed.groupBy("source", "split").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("source").orderBy("split")
                               .rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(splits.select("source", "split", "_first",
                                       F.coalesce(earlier, F.lit(0)).alias("_start")), "splits")
    if starts.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return placed.join(starts, ["source", "split"]).select(
        "source", (F.col("_place") - F.col("_first") + F.col("_start") + 1).alias("line_number"),
        "value").to(RAW_LINES)


def tail(lines: DataFrame, n: int = 100) -> DataFrame:
    """The last `n` raw lines of every source, before any parsing or filtering.

    The rank limit is applied in each task before rows are shuffled, so at most `n` lines of a
    source leave a task.
    """
    last = Window.partitionBy("source").orderBy(F.desc("line_number"))
    return (lines.withColumn("_rank", F.row_number().over(last))
            .filter(F.col("_rank") <= n).drop("_rank"))


def scan_tail(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """`(source, from_end, value)`: the last `n` lines of every file under `path`.

    Files are read backwards from their ends, so a log of any length costs what its tail does.
    """
    return ranges.read_tails(ranges.plan_ranges(spark, path), n)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Follow a directory of closed log segments; new files become new rows.

    Segment files have to be complete when they appear: bytes appended to a file already
    read are not seen. Each row carries its file and the start of its split; `number_lines`
    numbers the lines of a micro-batch, in which a segment is always whole.
    """
    reader = spark.readStream.schema("value STRING")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (reader.format("text").load(path)
            .select(F.col("_metadata.file_path").alias("source"),
                    F.col("_metadata.file_block_start").alias("split"),
                    F.make_valid_utf8("value").alias("value")))


_SYNTHETIC = """
SELECT 'access.log' AS source, event_id AS line_number,
  CASE WHEN event_id % 97 = 0 THEN concat('garbage line ', CAST(event_id AS STRING))
  ELSE concat(
    CASE WHEN event_id % 73 = 0 THEN '2001:db8::1'
         ELSE concat('10.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 7 AS STRING), '.',
                     CAST(user_id % 250 + 1 AS STRING)) END,
    ' - ', CASE WHEN event_type = 'purchase' THEN concat('u', CAST(user_id AS STRING)) ELSE '-' END,
    ' [', CASE WHEN event_id % 83 = 0 THEN {now}
               WHEN event_id % 79 = 0 THEN concat({west}, ' -0700')
               ELSE concat({now}, ' +0000') END, '] "',
    CASE WHEN event_id % 89 = 0 THEN '-' ELSE concat(
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END, ' ',
      CASE event_id % 12
        WHEN 0 THEN '/login' WHEN 1 THEN '/product.php?id=1%27+UNION+SELECT+pw'
        WHEN 2 THEN '/download?file=../../etc/passwd' WHEN 3 THEN '/static/app.CSS'
        WHEN 4 THEN '/health' WHEN 5 THEN concat('/item/', CAST(event_id % 50 AS STRING))
        WHEN 6 THEN '/search?q=shoes' WHEN 7 THEN '/admin' WHEN 8 THEN '/wp-login.php'
        WHEN 9 THEN '/' WHEN 10 THEN '/img/logo.png' ELSE '/checkout' END, ' HTTP/1.1') END, '" ',
    CASE WHEN event_id % 89 = 0 THEN '400'
         WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN '401' WHEN 1 THEN '403'
              WHEN 2 THEN '404' WHEN 3 THEN '500' ELSE '503' END
         WHEN event_type = 'signup' AND event_id % 3 = 0 THEN '302' ELSE '200' END, ' ',
    CASE WHEN event_type = 'error' THEN '-' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS STRING) END,
    CASE WHEN event_id % 10 = 9 THEN '' ELSE concat(' "',
      CASE WHEN event_id % 3 = 0 THEN 'https://www.example.com/home?x=1' ELSE '-' END, '" "',
      CASE event_id % 8
        WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
        WHEN 1 THEN 'curl/8.4.0' WHEN 2 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
        WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
        WHEN 4 THEN 'python-requests/2.31.0'
        WHEN 5 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1'
        WHEN 6 THEN '-' ELSE 'sqlmap/1.7 (Linux)' END, '"') END)
  END AS value
FROM (SELECT *, 1704067200 + (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000)
             div 600000000 AS sec FROM {{events}})
"""


def synthetic_lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """An access log with one line per row of the `events` table, 600x time compression.

    A row group is read by one task, and a file may have few; `tasks` deals the rows out to so many.
    """
    stamp = "date_format(timestamp_seconds({}), 'dd/MMM/yyyy:HH:mm:ss')"
    query = _SYNTHETIC.format(now=stamp.format("sec"), west=stamp.format("sec - 25200"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(query, events=events.repartition(tasks) if tasks else events)
