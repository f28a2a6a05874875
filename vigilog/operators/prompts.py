"""Prompt tables and batch scoring of prompts by a plugged-in model."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions.text import token_estimate
from vigilog.operators.batching import BATCH
from vigilog.schema import SEVERITIES, THREAT_TYPES

Scorer = Callable[[list[str]], list[str]]
#: Called without arguments, or with a `ModelCall` if it has a parameter for one.
ScorerFactory = Callable[..., Scorer]

_REPLY_FORMAT = (
    '{"threats": [{"type": "<' + "|".join(THREAT_TYPES) + '>", "severity": "<'
    + "|".join(SEVERITIES) + '>", "confidence": <0.0-1.0>, "description": "<text>", '
    '"evidence": ["<text>"], "source_ips": ["<ip>"], "target_paths": ["<path>"], '
    '"recommendation": "<text>"}], "summary": "<text>"}')
INSTRUCTIONS = (
    "Threat types: brute_force (repeated attempts on one path), ddos (very many requests "
    "within two seconds), sql_injection, path_traversal, reconnaissance (scanning), bot, "
    "other.\nReport only what the logs support with high confidence; an empty list of "
    "threats is a valid answer.\nReply with one JSON object and nothing else:\n" + _REPLY_FORMAT)


def chunk_prompt(chunks: DataFrame) -> DataFrame:
    """One prompt for a retrieved list of chunks (`rank`, profile columns, `document`)."""
    codes = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("status_codes"), lambda e: (
        F.concat(F.lit('"'), e["key"].cast("string"), F.lit('": '), e["value"].cast("string")))),
        ", "), F.lit("}"))
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("\n--- Chunk "), F.col("rank").cast("string"), F.lit(" ---")),
        F.concat(F.lit("Time: "), F.unix_seconds("start_time").cast("string"),
                 F.lit(" to "), F.unix_seconds("end_time").cast("string")),
        F.concat(F.lit("Log Count: "), F.col("log_count").cast("string")),
        F.concat(F.lit("Unique IPs: "), F.size("unique_ips").cast("string")),
        F.concat(F.lit("Status Codes: "), codes),
        F.lit("\nLogs:"), F.col("document"))
    sections = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.min("start_time").alias("window_start"), F.max("end_time").alias("window_end"),
        F.array_sort(F.collect_list(F.struct("rank", section.alias("text")))).alias("_parts"))
    body = F.when(F.col("chunks") > 0, F.array_join(F.transform(
        "_parts", lambda p: p["text"]), "\n")).otherwise(F.lit("No log entries retrieved."))
    return with_tokens(sections.select("chunks", "window_start", "window_end", body.alias("sections")))


def context_prompt(batched: DataFrame, context: DataFrame) -> DataFrame:
    """One prompt per batch: retrieved context, then the batch's raw lines in time order."""
    limits = {"individual_logs": 10, "grouped_summaries": 5, "analysis_summaries": 3}
    titles = {"individual_logs": "[entries before this batch]",
              "grouped_summaries": "[groups before this batch]",
              "analysis_summaries": "[what earlier batches showed]"}
    picked = [F.array_sort(F.collect_list(F.when(
        (F.col("kind") == kind) & (F.col("rank") <= limit), F.struct("rank", "document"))))
        .alias(kind) for kind, limit in limits.items()]
    found = context.groupBy(*BATCH).agg(*picked)
    lines = batched.groupBy(*BATCH).agg(F.array_sort(F.collect_list(
        F.struct("ts", "line_number", "raw_line"))).alias("_lines"))
    parts = [F.when(F.size(kind) > 0, F.concat(F.lit(f"{titles[kind]}\n"), F.array_join(
        F.transform(kind, lambda d: d["document"]), "\n\n"))) for kind in limits]
    current = F.concat(F.lit("[this batch: "), F.size("_lines").cast("string"), F.lit(" lines]\n"),
                       F.array_join(F.transform("_lines", lambda x: x["raw_line"]), "\n"))
    return with_tokens(lines.join(found, BATCH, "left").select(
        *BATCH, F.concat_ws("\n\n", *parts, current).alias("sections")))


def with_tokens(prompts: DataFrame) -> DataFrame:
    """Adds the whole `prompt` and its estimated number of tokens."""
    return (prompts.withColumn("prompt", F.concat_ws("\n", F.lit(
        "Here is part of a web server's access log. Which attacks does it show?\n"),
        F.col("sections"), F.lit(INSTRUCTIONS)))
        .withColumn("tokens", token_estimate(F.col("prompt"))))


@dataclass(frozen=True)
class ModelCall:
    """What a model is called with beside the prompt."""

    system: str = ("You look for attacks in web-server logs. You report what the lines show, nothing "
                   "else, as JSON.")
    temperature: float = 0.1
    max_tokens: int | None = None


def build_scorer(scorer: ScorerFactory, call: ModelCall | None) -> Scorer:
    """The scorer of a factory; one that takes an argument is given the call's settings."""
    return scorer(call or ModelCall()) if inspect.signature(scorer).parameters else scorer()


def score_prompts(prompts: DataFrame, scorer: ScorerFactory, keys: list[str],
                  batch_rows: int = 16, settings: ModelCall | None = None) -> DataFrame:
    """`(keys, reply, error, seconds)`: prompts sent to a model, built once per partition.

    A call fails by raising or by a wrong number of replies. The prompts of a failed call are
    sent again one by one, so only those that fail alone have an `error` and an empty reply. A scorer
    factory with a parameter gets the `settings`: system text, temperature and token limit.
    """
    def call(score: Scorer, texts: list[str]) -> list[str]:
        replies = list(score(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
        return replies

    def alone(score: Scorer, prompt: str) -> tuple[str, str | None]:
        try:
            return call(score, [prompt])[0], None
        except Exception as failure:  # one bad prompt must not end the job
            return "", str(failure)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = build_scorer(scorer, settings)
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at:at + batch_rows]
                texts = part["prompt"].tolist()
                began = time.monotonic()
                try:
                    replies, errors = call(score, texts), [None] * len(texts)
                except Exception:
                    replies, errors = zip(*[alone(score, t) for t in texts], strict=True)
                spent = (time.monotonic() - began) / len(part)
                yield part[keys].assign(reply=list(replies), error=list(errors), seconds=spent)

    schema = T.StructType([prompts.schema[k] for k in keys] + [
        T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("seconds", T.DoubleType())])
    return prompts.select(*keys, "prompt").mapInPandas(run, schema)
