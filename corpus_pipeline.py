"""Corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import bpe, decontaminate, minhash, repeats, toxicity
from vigilog.llm.common import batches_of_at_most, fresh, table
from vigilog.session import materialize

#: Text in a batch, less than the operators take alone: an executor that has run one stage starts the next
#: with a grown heap and with workers that still stand.
BATCH_BYTES = 1 << 20
#: Rows that Spark's Parquet reader decodes at once. The usual 4,096 texts are arrays of tens of MB in every
#: task, for which an executor's heap is rather grown than collected.
READ_ROWS = 512


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]
         ) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches of at most BATCH_BYTES and READ_ROWS, in the passes it runs and in the one
    it returns."""
    @functools.wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
        with batches_of_at_most(BATCH_BYTES):
            return stage(spark, docs, sf_dir)

    return run_lean


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns of `docs`, with n_chars brought up to date where a stage changes texts."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*docs.columns)


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; the others stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs.columns)
    scored = toxicity.score(docs, model, out=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document of least id stays."""
    return minhash.keep_first(docs)


@lean
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word passages that stand elsewhere too go."""
    return _same_columns(repeats.remove_repeats(docs), docs)


@lean
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with test items go; documents made of them for the larger part go whole."""
    items = table(spark, sf_dir, "benchmark")
    return _same_columns(decontaminate.remove_spans(docs, items), docs)


@lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    encoded = bpe.encode(docs, path, keep=keep, exact="exact")
    return encoded.select(*keep, F.size("ids").cast("bigint").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("benchmark", cut_benchmark),
    ("byte_pairs", encode),
]

#: The stages train a model, link sets and build automata: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
