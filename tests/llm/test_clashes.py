"""Stages keep columns whatever their names, and ids beside separators are the library's."""

import random

import public_tokenizers

from vigilog.llm import bpe, decontaminate, huffman, repeats

PASSAGE = " ".join(f"word{i}" for i in range(40))


def test_spans_and_repeats_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, f"a b {PASSAGE} c"), (2, f"{PASSAGE} d"), (3, "clean"), (4, None)],
                               "doc_id bigint, text string").selectExpr(
        "*", "777 AS n_words", "'x' AS hit", "1 AS item_ids", "2 AS _runs", "3 AS _packed", "4 AS row", "5 AS runs",
        "6 AS _row", "7 AS _id")
    items = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    more = (777, "x", 1, 2, 3, 4, 5, 6, 7)
    kept = {r.doc_id: tuple(r)[1:] for r in decontaminate.remove_spans(df, items, max_coverage=1.0).collect()}
    assert kept == {1: ("a b  c", *more), 2: (" d", *more), 3: ("clean", *more), 4: (None, *more)}
    kept = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}
    assert kept == {1: ("a b c", *more), 2: ("d", *more), 3: ("clean", *more), 4: (None, *more)}


def test_word_ids_with_control_characters():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = huffman.WordTokenizer(path)
    rng = random.Random(11)
    parts = ["Ä", "\x1c", "\x1d", "\x1e", "\x1f", ". ", ", ", ".", ",", " ", "  ", "'RE", "<s>", "|>", "word", "_", "\x85", "\xa0",
             "\x00", "\x7f", "\n", "É", "'s", "1", "<|endoftext|>", "数"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    flat, bounds = t.encode_batch(texts)
    flat = flat.tolist()
    want = [e.ids for e in t.whole.encode_batch(texts, add_special_tokens=False)]
    wrong = [x for x, w, a, b in zip(texts, want, bounds, bounds[1:]) if flat[a:b] != w]
    assert not wrong, wrong[:5]


def test_bytes_that_only_begin_labels():
    t = bpe.TokenAutomaton({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4}, [(b"a", b"b"), (b"ab", b"c")])
    assert t.encode(b"abcabab") == (4, 3, 3) and t.encode(b"") == ()


def test_toxic_words_are_seen_wherever_they_stand(spark):
    from vigilog.llm import toxicity

    model = toxicity.Model({"badword": 3.0, "~adword": 1.0}, -1.0)
    texts = ["badword here", "badword,hello", "hello/badword", "hello_badword", "中文badword", "x" * 50 + ",badword",
             "x" * 60 + "badword" + "y" * 9, "good words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.score > 0.45 for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert got == [True] * 7 + [False]


def test_toxicity_scores_equal_a_plain_sum(spark):
    import math
    import re

    from vigilog.llm import toxicity

    weights = {"bad": 1.5, "badw-": 0.5, "~中文": 0.7, "ok": -0.4, "~文字": -0.2}
    texts = [None, "", "bad ok", "Bad, BADWORDS bad", "中文字 ok", "badwords/bad_ok\nbad", "ok " * 3000 + "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS score", "2 AS _input_")

    def plain(text):
        words = re.findall(r"[0-9a-z]+|[^\W_0-9a-z]+", (text or "").lower())
        seen = {f for f in weights if any(
            f == w or (f[-1] == "-" and w.startswith(f[:-1]) and len(w) > len(f) - 1)
            or (f[0] == "~" and w[0] > "z" and f[1:] in w) for w in words)}
        return 1 / (1 + math.exp(0.3 - sum(weights[f] for f in seen)))

    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.Model(weights, -0.3)).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t in enumerate(texts))
