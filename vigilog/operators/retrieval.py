"""Retrieval of context: recent similar entries, and chunks by time, meaning and anomaly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.embedding import EmbedderFactory, hashed_words
from vigilog.operators.vectors import QueryVectors, best_k, nearest, nearest_candidates

# Phrases searched for.
THREAT_QUERIES = (
    "failed login authentication attempts brute force",
    "SQL injection union select database attack",
    "directory traversal path manipulation etc passwd",
    "high frequency requests denial of service",
    "scanning reconnaissance probing vulnerability",
    "suspicious user agent bot crawler scanner",
)
CONTEXT_QUERIES = (
    "failed authentication brute force",
    "SQL injection attack",
    "high volume requests DDoS",
    "scanning reconnaissance probing",
)


def embed_queries(phrases: tuple[str, ...] | list[str],
                  embedder: EmbedderFactory | None = None) -> QueryVectors:
    """Query vectors keyed by their position (`q1`, `q2`, …)."""
    vectors = (embedder or hashed_words())()(list(phrases))
    return [(f"q{i + 1}", [float(x) for x in v]) for i, v in enumerate(vectors)]


# --- recent context of every batch -------------------------------------------------------

PANE_BASE = 8


def _pane_levels(window_seconds: int) -> int:
    levels = 1
    while PANE_BASE ** levels <= window_seconds:
        levels += 1
    return levels


def _span(start: Column, end: Column) -> Column:
    """Integers from `start` up to but not including `end`."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(
        F.array().cast("array<bigint>"))


def window_panes(start: Column, end: Column, levels: int) -> Column:
    """Panes `(level, pane)` that tile the seconds `[start, end)` exactly.

    Pane `p` of level `l` covers `8**l` aligned seconds. A run of panes that fills a pane of
    the next level is left to that level.
    """
    def tagged(panes: Column, level: int) -> Column:
        return F.transform(panes, lambda p: F.struct(
            F.lit(level).alias("level"), p.alias("pane")))

    parts = []
    for level in range(levels):
        size = PANE_BASE ** level
        lo, hi = F.ceil(start / size).cast("bigint"), F.floor(end / size).cast("bigint")
        up_lo = F.ceil(lo / PANE_BASE).cast("bigint") * PANE_BASE
        up_hi = F.floor(hi / PANE_BASE).cast("bigint") * PANE_BASE
        whole = _span(lo, hi)
        if level < levels - 1:
            whole = F.when(up_lo < up_hi, F.concat(_span(lo, up_lo), _span(up_hi, hi))).otherwise(
                whole)
        parts.append(tagged(whole, level))
    return F.concat(*parts)


def nearest_in_window(corpus: DataFrame, moments: DataFrame, queries: QueryVectors, k: int,
                      window_seconds: int) -> DataFrame:
    """For every `(source, as_of)` and query: the `k` nearest rows of the last window.

    A row is wanted by every moment of the following half hour, so joining rows to moments
    would multiply the log. Instead the best `k` rows of each second are found first, then
    of each pane of 8, 64, 512 … seconds; a window is tiled by a few dozen panes, whose
    best rows contain the window's best. Everything is an equi-join with bounded fan-out.
    """
    levels = _pane_levels(window_seconds)
    seconds = corpus.withColumn("sec", F.unix_seconds("ts"))
    scored = best_k(nearest_candidates(seconds, queries, k, ["source", "sec"]),
                    ["source", "sec", "query_id"], k).drop("rank")
    panes = best_k(
        scored.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
        .withColumn("pane", F.floor(F.col("sec") / F.pow(F.lit(PANE_BASE), "level"))
                    .cast("bigint")),
        ["source", "query_id", "level", "pane"], k).drop("rank", "sec")
    wanted = moments.select("source", "as_of").distinct().select(
        "source", "as_of", F.inline(window_panes(
            F.col("as_of") - window_seconds, F.col("as_of") + 1, levels)))
    found = wanted.join(panes, ["source", "level", "pane"])
    return best_k(found, ["source", "as_of", "query_id"], k).select(
        "source", "as_of", "query_id", "rank", "id", "distance")


def distinct_texts(found: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One row per text, told by the digest `_text`: its nearest, ranked by distance then id, at most
    `limit`."""
    per_text = Window.partitionBy(*keys, "_text").orderBy("distance", "id")
    unique = (found.withColumn("_n", F.row_number().over(per_text)).filter("_n = 1").drop("_n"))
    return best_k(unique.drop("rank"), keys, limit)


def recent_context(batches: DataFrame, individual: DataFrame, groups: DataFrame,
                   summaries: DataFrame, queries: QueryVectors, minutes: int = 30,
                   max_individual: int = 20, max_groups: int = 10, max_summaries: int = 5,
                   group_queries: QueryVectors | None = None) -> DataFrame:
    """`(source, batch_id, kind, rank, id, document, distance)` for all batches at once.

    `batches` has `(source, batch_id, as_of)` with the second of the batch's last entry; a
    batch sees rows of the `minutes` up to it, and the latest summaries of earlier batches. Groups
    are searched with `group_queries` where they have vectors of another model.
    """
    window = minutes * 60

    def similar(corpus: DataFrame, kind: str, limit: int, queries: QueryVectors) -> DataFrame:
        k = max(1, limit // len(queries))
        ids = nearest_in_window(corpus, batches, queries, k, window)
        # Digests tell equal texts apart; the texts themselves are joined to what is left.
        hashed = ids.join(corpus.select("source", "id", F.sha2("document", 256).alias("_text")), ["source", "id"])
        unique = distinct_texts(hashed, ["source", "as_of"], limit).drop("_text").join(
            corpus.select("source", "id", "document"), ["source", "id"])
        return batches.join(unique, ["source", "as_of"]).select(
            "source", "batch_id", F.lit(kind).alias("kind"), "rank", "id", "document", "distance")

    earlier = (summaries
               .withColumn("_back", F.explode(F.array(*[
                   F.lit(i + 1) for i in range(max_summaries)])))
               .select("source", (F.col("batch_id") + F.col("_back")).alias("batch_id"),
                       "_back", "id", "document", F.unix_seconds("ts").alias("_sec"))
               .join(batches, ["source", "batch_id"])
               .filter(F.col("_sec") >= F.col("as_of") - window))
    newest = Window.partitionBy("source", "batch_id", "document").orderBy("_back")
    order = Window.partitionBy("source", "batch_id").orderBy("_back")
    prior = (earlier.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
             .withColumn("rank", F.row_number().over(order).cast("bigint"))
             .select("source", "batch_id", F.lit("analysis_summaries").alias("kind"), "rank",
                     "id", "document", F.lit(None).cast("double").alias("distance")))
    return (similar(individual, "individual_logs", max_individual, queries)
            .unionByName(similar(groups, "grouped_summaries", max_groups, group_queries or queries))
            .unionByName(prior))


# --- chunk retrieval ------------------------------------------------------------------------

def latest(chunks: DataFrame) -> Column:
    """The newest `end_time`, as a scalar subquery: the default for `as_of`."""
    return chunks.agg(F.max("end_time")).scalar()


def _newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("start_time"), "chunk_id").limit(max(n, 0))


def _ago(as_of: Column, hours: float) -> Column:
    return F.timestamp_seconds(F.unix_seconds(as_of) - int(hours * 3600))


def in_time_window(chunks: DataFrame, start: Column, end: Column, n: int = 100) -> DataFrame:
    """Chunks lying inside the window, newest first."""
    return _newest(chunks.filter((F.col("start_time") >= start) & (F.col("end_time") <= end)), n)


def by_meaning(chunks: DataFrame, queries: QueryVectors, n: int = 50,
               hours: float | None = None, as_of: Column | None = None) -> DataFrame:
    """`(query_id, rank, chunk_id, distance)`: nearest chunks, optionally of the last hours."""
    if hours:
        chunks = chunks.filter(F.col("start_time") >= _ago(
            latest(chunks) if as_of is None else as_of, hours))
    found = nearest(chunks.select(F.col("chunk_id").alias("id"), "embedding"), queries, n)
    return found.withColumnRenamed("id", "chunk_id")


# Counts of a status in one chunk that make it anomalous.
ANOMALOUS_STATUS = {401: 5, 403: 5, 404: 10, 500: 3}
BUSY_CHUNK = 20


def anomalies(chunks: DataFrame, n: int = 50, hours: float = 1,
              as_of: Column | None = None) -> DataFrame:
    """Chunks full of failures, then busy chunks; half of `n` each, duplicates once."""
    recent = chunks.filter(F.col("start_time") >= _ago(
        latest(chunks) if as_of is None else as_of, hours))
    failing = F.lit(False)
    for status, at_least in ANOMALOUS_STATUS.items():
        seen = F.coalesce(F.try_element_at("status_codes", F.lit(status)), F.lit(0))
        failing = failing | (seen >= at_least)
    order = Window.orderBy(F.desc("start_time"), "chunk_id")
    parts = [
        (1, _newest(recent.filter(failing), n // 2)),
        (2, _newest(recent.filter(F.col("log_count") >= BUSY_CHUNK), n // 2)),
    ]
    ranked = [part.withColumn("strategy", F.lit(i)).withColumn(
        "rank", F.row_number().over(order).cast("bigint")) for i, part in parts]
    return first_by_id(ranked[0].unionByName(ranked[1])).orderBy("strategy", "rank").limit(max(n, 0))


def first_by_id(found: DataFrame) -> DataFrame:
    """First occurrence of every chunk, in strategy order."""
    order = Window.partitionBy("chunk_id").orderBy("strategy", "rank")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def combined(chunks: DataFrame, queries: QueryVectors, hours: float | None = 1, n: int = 100,
             as_of: Column | None = None) -> DataFrame:
    """Union of the strategies, duplicates once, newest first, at most `n` chunks.

    A third of `n` by time, a third by meaning (shared by the queries), a third by anomaly.
    Without a time window only the queries are used. The lists ranked here hold at most `n`
    rows.
    """
    listed = ["chunk_id", "strategy", "rank"]
    if hours is None:
        hits = by_meaning(chunks, queries, n // len(queries)).withColumn("strategy", F.substring(
            "query_id", 2, 9).cast("int")).select(*listed)
    else:
        as_of = latest(chunks) if as_of is None else as_of
        order = Window.orderBy(F.desc("start_time"), "chunk_id")
        timed = (in_time_window(chunks, _ago(as_of, hours), as_of, n // 3)
                 .withColumn("strategy", F.lit(0))
                 .withColumn("rank", F.row_number().over(order).cast("bigint")).select(*listed))
        alike = (by_meaning(chunks, queries, n // (3 * len(queries)), hours, as_of)
                 .withColumn("strategy", F.substring("query_id", 2, 9).cast("int"))
                 .select(*listed))
        odd = (anomalies(chunks, n // 3, hours, as_of)
               .withColumn("strategy", F.col("strategy") + 1000).select(*listed))
        hits = timed.unionByName(alike).unionByName(odd)
    unique = first_by_id(hits)
    return (chunks.join(unique, "chunk_id")
            .orderBy(F.desc("start_time"), "strategy", "rank").limit(max(n, 0)))


# Presets of the window analysis as (hours, chunks).
SCAN_PRESETS = {"quick": (0.25, 50), "default": (1, 100), "deep": (24, 200)}
