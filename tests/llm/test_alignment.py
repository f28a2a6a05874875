"""Cross-tokenizer alignment against a version that compares byte ranges one by one."""

import random

import public_tokenizers
import pytest

from plain_versions import alignment
from vigilog.llm import align

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
NEW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  a  b ", "\ta\n\nb ", "<|endoftext|> </s><s> <0x0A>", "▁x", "x▁", "naïve café",
       "数据处理，大规模。", "🙂🙃 é", "\x00\x1f\x7f", "same words same words", "same words same words",
       "a" * 300, "don't won't I'll", "1234567 3.14", " nbsp　wide"]


def check(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in NEW) for r in align.align(df, A, B, **more).collect()}
    assert [got[i] for i in range(len(texts))] == alignment(texts, A, B)


def test_odd_texts(spark):
    check(spark, ODD)


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["the", "The", " ", "  ", "\n", "tokenization", "Überraschung", ",", ".", "'s", "数", "é", "0x", "<s>", "\t", "x_y"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)])


def test_very_long_text(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma-ray", "δέλτα", "x" * 50]
    text = " ".join(rng.choice(words) for _ in range(3000))
    check(spark, [text, text[:1000]])


def test_rare_pairs_join_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(align._sums, "__defaults__", (3,))
    check(spark, ["the the the cat", "the cat sat on the mat", "on the mat", "zebra"])


def test_a_small_memo_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(align, "MEMO_BYTES", 1000)
    check(spark, ["some words and more words", "more words and some words", *ODD])


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align(none, A, B).collect() == []
    df = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id bigint, text string, n_a int, number int, row int")
    (row,) = align.align(df, A, B).collect()
    assert (row.doc_id, row.text, row.n_a, row.number, row.row) == (1, "a b", 2, 8, 9)


@pytest.mark.parametrize("copies", [2, 5])
def test_repeated_rows_all_count(spark, copies):
    check(spark, ["one and the same text"] * copies)
