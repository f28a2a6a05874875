"""The registered queries of the operators; each reads whole tables and whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import (
    align,
    bpe,
    chat,
    decontaminate,
    huffman,
    minhash,
    mixing,
    negatives,
    neighbours,
    repeats,
    rules,
    samples,
    toxicity,
    webpages,
)
from vigilog.llm.common import table
from vigilog.llm.oracle import ORACLE  # noqa: F401
from vigilog.session import scratch_root


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, _tokenizer("byte_bpe_50k.json"), keep=["doc_id"])


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = neighbours.fit(docs, table(spark, sf_dir, "labels"))
    return neighbours.score(docs, space, keep=["doc_id"]).select(
        "doc_id", (samples.fold_of("doc_id", neighbours.FOLDS) == 1).alias("held_out"), "score",
        neighbours.predicted().alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = rules.plan_from(docs).rules
    # Which rule came first depends on the measured order, the verdict doesn't.
    return rules.apply_rules(docs, order, keep=["doc_id"]).drop("rejected_by")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (samples.fold_of("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    imitation = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT bigint(-1) AS conv_id, bigint(t) AS turn, r AS role, s AS text FROM "
                      "VALUES (0, 'user', :s), (1, 'assistant', :s) AS v(t, r, s)",
                      args={"s": imitation})
    out = chat.render(chat.fold(chat.as_events(rows.unionByName(extra))))
    line = chat.read_turns(F.col("formatted"))
    told = F.array_join(F.transform(line, lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = chat.loss_text(F.col("formatted"), F.col("loss"))
    return out.select(
        "conv_id", F.size(line).cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{scratch_root(spark)}/token-ids-{uuid.uuid4().hex}"
    huffman.write(docs, path, _tokenizer("word_bpe_49k.json"), end_id=1)
    return huffman.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_count().cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.groups(docs, width=4).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"),
                       keep=["doc_id"])


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                      keep=["doc_id"]).rows


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_votes": op2_quality_votes,
    "op3_quality_rules": op3_quality_rules,
    "op4_html": op4_html,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat": op7_chat,
    "op8_huffman_ids": op8_huffman_ids,
    "op9_decontamination": op9_decontamination,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}
