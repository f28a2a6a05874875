"""End-to-end analyses: every batch of a log at once, or a window of stored chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.config import EngineConfig
from vigilog.functions.embedding import EmbedderFactory, hashed_words
from vigilog.operators import batching, prompts, retrieval, rules, threats
from vigilog.operators.batching import BATCH
from vigilog.schema import ANALYSIS_RUNS, ANALYSIS_SUMMARIES, THREAT_ALERTS
from vigilog.session import materialize
from vigilog.sources import tables

NO_LOGS = "No logs available for analysis in the specified time window."


@dataclass(frozen=True)
class Analysis:
    """The tables one analysis produces."""

    batched: DataFrame
    individual_logs: DataFrame
    group_summaries: DataFrame
    analysis_summaries: DataFrame
    context: DataFrame
    prompts: DataFrame
    threats: DataFrame
    alerts: DataFrame
    runs: DataFrame


def rule_findings(batched: DataFrame, limits: rules.Thresholds | None = None) -> DataFrame:
    """Rule findings per batch in the shape of a model's threats."""
    found = rules.find_threats(batched, limits, scope=BATCH)
    what = F.translate("threat_type", "_", " ")
    order = Window.partitionBy(*BATCH).orderBy(
        "threat_type", "client_ip", F.coalesce("detail", F.lit("")))
    numbered = found.withColumn("threat_no", F.row_number().over(order))
    return numbered.select(
        *BATCH, "threat_no", F.col("threat_type").alias("type"), "severity", "confidence",
        F.concat_ws("", what, F.lit(" from "), "client_ip", F.lit(": "),
                    F.col("n").cast("string"), F.lit(" requests")).alias("description"),
        F.array().cast("array<string>").alias("evidence"),
        F.concat(F.lit("Review and rate-limit "), F.col("client_ip")).alias("recommendation"),
        "source_ips",
        F.when(F.col("threat_type") == "brute_force", F.array("detail"))
        .otherwise(F.array().cast("array<string>")).alias("target_paths"))


def model_findings(prompt_table: DataFrame, scorer: prompts.ScorerFactory,
                   settings: prompts.ModelCall | None = None) -> tuple[DataFrame, DataFrame]:
    """Threats read from a model's replies, and the replies themselves."""
    replies = materialize(prompts.score_prompts(prompt_table, scorer, BATCH, settings=settings), "replies")
    read = threats.read_replies(replies)
    return threats.reply_threats(read, BATCH), read


def alert_rows(found: DataFrame, batched: DataFrame, profile: DataFrame,
               alias_bot: bool = False) -> DataFrame:
    """Alerts of all batches; addresses and paths come from the evidence only."""
    rows = threats.with_evidence(threats.normalize(found, alias_bot), batched, profile).join(
        profile.select(*BATCH, F.col("last_entry.ts").alias("ts")), BATCH)
    run_id = F.concat_ws("#", "source", F.col("batch_id").cast("string"))
    return rows.select(
        F.concat_ws("#", "source", F.col("batch_id").cast("string"),
                    F.col("threat_no").cast("string")).alias("alert_id"),
        run_id.alias("run_id"), "ts", "threat_type", "severity", "confidence", "description",
        "evidence", "recommendation", F.col("evidence.derived_source_ips").alias("source_ips"),
        F.col("evidence.derived_target_paths").alias("target_paths"),
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit("").alias("acknowledged_by"), F.lit("").alias("notes")).to(THREAT_ALERTS)


def run_rows(profile: DataFrame, summaries: DataFrame, prompt_table: DataFrame, model: str,
             replies: DataFrame | None = None, always_record: bool = False) -> DataFrame:
    """One run per batch with at least one threat (every batch with `always_record`)."""
    rows = (profile.join(summaries.select(*BATCH, "threats_found"), BATCH)
            .join(prompt_table.select(*BATCH, "tokens"), BATCH, "left"))
    if replies is None:
        rows = rows.withColumn("error", F.lit(None).cast("string")).withColumn(
            "seconds", F.lit(0.0))
    else:
        rows = rows.join(replies.select(*BATCH, "error", "seconds"), BATCH, "left")
    if not always_record:
        rows = rows.filter(F.col("threats_found") > 0)
    return rows.select(
        F.concat_ws("#", "source", F.col("batch_id").cast("string")).alias("run_id"),
        F.col("last_entry.ts").alias("ts"), F.col("n").cast("int").alias("logs_analyzed"),
        F.col("first.ts").alias("time_window_start"), F.col("last_entry.ts").alias("time_window_end"),
        F.col("threats_found").cast("int").alias("threats_found"),
        F.col("seconds").alias("duration_seconds"), F.col("tokens").alias("tokens_used"),
        F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        F.lit(model).alias("model_used")).to(ANALYSIS_RUNS)


def analyze_batches(entries: DataFrame, config: EngineConfig | None = None,
                    limits: rules.Thresholds | None = None,
                    embedder: EmbedderFactory | None = None,
                    scorer: prompts.ScorerFactory | None = None,
                    history: DataFrame | None = None, include_partial: bool = False,
                    always_record: bool = False, batched: DataFrame | None = None,
                    summary_embedder: EmbedderFactory | None = None,
                    individual: DataFrame | None = None) -> Analysis:
    """Analyse all batches of accepted entries as one set of joins and aggregations.

    With rules, the summaries of earlier batches are known at once and serve as context, beside
    the stored ones given as `history`. A
    plugged-in model sees the stored summaries given as `history` instead, as a summary of
    the run itself would depend on the replies being asked for. Shared intermediates are
    written once to the shared scratch folder. `batched` gives the batches if they are already
    cut (entries with `batch_id` and `position`), `individual` the rows of the entries if they are
    already made; what is given is taken as stored. Vectors have two tiers: `embedder` is for single
    entries, where it has to be fast, `summary_embedder` (default: the same) for groups and summaries.
    """
    config = config or EngineConfig()
    embedder = embedder or hashed_words(config.embedding_dim)
    summary_embedder = summary_embedder or embedder
    queries = retrieval.embed_queries(retrieval.CONTEXT_QUERIES, embedder)
    group_queries = (queries if summary_embedder is embedder else
                     retrieval.embed_queries(retrieval.CONTEXT_QUERIES, summary_embedder))
    if batched is None or individual is None:
        entries = materialize(entries, "entries")       # parsed once, read by both branches
    if batched is None:
        batched = batching.assign_batches(entries, config.buffer_size, include_partial, stored=True)
    batched = materialize(batched, "batched")
    if individual is None:
        individual = materialize(tables.individual_rows(entries, embedder), "individual")
    profile = materialize(batching.batch_profile(batched), "profile")
    ends = profile.select(*BATCH, F.col("last_entry.ts").alias("ts"),
                          F.unix_seconds("last_entry.ts").alias("as_of"))
    groups = materialize(tables.group_rows(
        batching.summarize_groups(batching.group_entries(batched)),
        ends.select(*BATCH, "ts"), summary_embedder), "groups")

    def context_of(summaries: DataFrame) -> DataFrame:
        return retrieval.recent_context(
            ends.select(*BATCH, "as_of"), individual, groups, summaries, queries,
            config.rag_time_window_minutes, group_queries=group_queries)

    replies = None
    if scorer is None:
        found = materialize(rule_findings(batched, limits), "threats")
    else:
        if history is None:
            history = entries.sparkSession.createDataFrame([], ANALYSIS_SUMMARIES)
        context = materialize(context_of(history), "context")
        prompt_table = materialize(prompts.context_prompt(batched, context), "prompts")
        found, replies = model_findings(prompt_table, scorer, config.model_call)
    summaries = materialize(
        tables.summary_rows(batching.analysis_summary(profile, found, replies), summary_embedder), "summaries")
    if scorer is None:      # no model reads them, so they are made only if they are looked at
        context = context_of(summaries if history is None else history.unionByName(summaries))
        prompt_table = prompts.context_prompt(batched, context)
    return Analysis(
        batched=batched, individual_logs=individual, group_summaries=groups,
        analysis_summaries=summaries, context=context, prompts=prompt_table, threats=found,
        alerts=alert_rows(found, batched, profile),
        runs=run_rows(profile, summaries, prompt_table, config.model, replies, always_record))


def analyze_window(chunks: DataFrame, hours: float | None = 1, n: int = 100,
                   phrases=retrieval.THREAT_QUERIES, embedder: EmbedderFactory | None = None,
                   scorer: prompts.ScorerFactory | None = None, as_of: Column | None = None,
                   members: DataFrame | None = None, limits: rules.Thresholds | None = None,
                   model: str = "rules", settings: prompts.ModelCall | None = None) -> DataFrame:
    """One row: what a window of stored chunks shows.

    A plugged-in model is sent the prompt of the retrieved chunks. Without one, the rules look at
    the entries of these chunks, which `members` has (entries with `chunk_id`); they count over all
    of the window's entries together. `threats` are JSON texts in either case; `status`, `error`,
    `model_used` and `seconds` tell how the analysis went.
    """
    queries = retrieval.embed_queries(phrases, embedder)
    found = materialize(ranked_chunks(retrieval.combined(chunks, queries, hours, n, as_of)), "retrieved")
    prompt = prompts.chunk_prompt(found)
    none = F.lit(None)
    if scorer is None:
        scored = prompt.withColumns({"error": none.cast("string"), "seconds": F.lit(0.0)})
        if members is None:
            scored = scored.withColumn("reply", F.lit('{"threats": []}'))
        else:
            scored = scored.withColumn("reply", _window_reply(found, members, limits).scalar())
    else:
        keys = ["chunks", "window_start", "window_end", "sections", "tokens"]
        scored = prompts.score_prompts(prompt, scorer, keys, settings=settings)
    read = threats.read_replies(scored)
    empty, failed = F.col("chunks") == 0, F.col("error").isNotNull()
    return read.select(
        F.col("chunks").alias("chunks_analyzed"), "window_start", "window_end",
        F.when(empty, F.lit(NO_LOGS)).when(failed, F.concat(F.lit("Analysis failed: "), "error"))
        .otherwise(F.col("summary")).alias("summary"),
        F.when(~empty, F.col("tokens")).alias("estimated_tokens"), "sections", "threats",
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"), "error",
        F.lit(model).alias("model_used"), "seconds")


def _window_reply(found: DataFrame, members: DataFrame, limits: rules.Thresholds | None) -> DataFrame:
    """One row, one column: what the rules find in the retrieved chunks, in the form of a model's reply.

    The chunks are at most as many as were asked for and of bounded size, and so are the findings.
    """
    ids = found.select("chunk_id").distinct()
    inside = members.join(F.broadcast(ids), "chunk_id", "left_semi").withColumn("batch_id", F.lit(0).cast("bigint"))
    rows = rule_findings(inside, limits)
    threat = F.struct("type", "severity", "confidence", "description", "evidence", "recommendation",
                      "source_ips", "target_paths")
    return rows.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(
        F.struct("source", "threat_no", threat.alias("threat")))), lambda r: r["threat"]).alias("threats"))))


def ranked_chunks(found: DataFrame) -> DataFrame:
    """Retrieved chunks with their place in the result list (at most the requested number)."""
    order = Window.orderBy(F.desc("start_time"), "strategy", "rank")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint"))
