"""Pieces of texts are looked up together, and batches stay as small as their caller asks."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from vigilog.llm import bpe, huffman, repeats
from vigilog.llm.bpe import ByteCodec, Numbers, TokenAutomaton, codec
from vigilog.llm.common import Recent, batches_of_at_most, extend, small_batches, tidy

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_stay_below_what_the_caller_allows(spark):
    with batches_of_at_most(1000):
        small_batches(spark, 2000)
        assert spark.conf.get(BYTES) == "1000"
        small_batches(spark, 500)
        assert spark.conf.get(BYTES) == "500"
    small_batches(spark, 2000)
    assert spark.conf.get(BYTES) == "2000"


def test_the_pipeline_asks_for_lean_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(9)], "doc_id BIGINT, text STRING")
    found = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert int(spark.conf.get(BYTES)) == corpus_pipeline.BATCH_BYTES
    assert found.where("exact").count() == 9


def test_many_keys_are_looked_up_as_one_by_one():
    made = []
    recent = Recent(4)

    def make(key):
        found = recent.get(key)
        if found is None:
            made.append(key)
            found = key.upper()
            recent.put(key, found)
        return found

    assert recent.many(["a", "b", "a"], make) == ["A", "B", "A"]
    assert recent.many(["b", "c", "d", "a"], make) == ["B", "C", "D", "A"]
    assert made == ["a", "b", "c", "d"]


def test_words_with_one_mark_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, codec = Tokenizer.from_file(path), ByteCodec(path)
    for text in ("one two, three. Four! five? six; seven: . , a", "x ., y,, z's 'tis don't. no.1 a1, b2", "", " ", "a  b ",
                 "hé, wörld. 日本, x.", "<|endoftext|>, a<|endoftext|>. endoftext."):
        assert codec.encode(text) == whole.encode(text, add_special_tokens=False).ids, text


def test_words_of_a_batch_are_encoded_together(monkeypatch):
    """Of thousands of distinct words only the last few are encoded one by one; ids are the library's."""
    from tokenizers import Tokenizer

    path, rng, alone = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3), []
    whole, codec = Tokenizer.from_file(path), ByteCodec(path)
    syllables = "tion er wh ly ció né schaft ß ing x th 漢 ' . , \n 1 <|endoftext|> \x85 \xa0".split(" ")
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(40))
             for _ in range(200)] + ["x" * 3000, "", " ", "a  b", None]
    encode = TokenAutomaton.encode
    monkeypatch.setattr(TokenAutomaton, "encode", lambda self, w: alone.append(w) or encode(self, w))
    monkeypatch.setattr(bpe, "CELLS", 300)                  # tables are emptied on the way
    ids, bounds = codec.encode_batch(texts)
    assert len(alone) <= 100
    want = whole.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [w.ids for w in want]
    assert codec.encode_batch([])[0].tolist() == []


def test_many_words_are_encoded_as_one_by_one():
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"ab"), (b"b", b"a"), (b"ab", b"ba")]
    names = [b"a", b"b", *(x + y for x, y in merges)]
    automaton = TokenAutomaton({n: i for i, n in enumerate(names)}, merges)
    words = [bytes(97 + (k >> i & 1) for i in range(n)) for n in range(10) for k in range(1 << n)]

    def many(words):
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        return automaton.encode_many(np.frombuffer(b"".join(words), np.uint8), bounds)

    ids, bounds = many(words)
    assert [tuple(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])] == [*map(automaton.encode, words)]
    for bad in (b"z", b"abz", b"zab"):
        with pytest.raises(ValueError):
            many([*words, bad])
        with pytest.raises(ValueError):
            many([bad] * 200)


def test_numbers_are_found_by_key():
    table, keys = Numbers(10), np.arange(700, dtype=np.int64) * 1_000_003
    table.put(keys[:600], np.arange(600))
    assert table.get(keys).tolist() == [*range(600)] + [-1] * 100
    table.clear()
    assert (table.get(keys) == -1).all() and table.used == 0


def test_documents_are_put_in_order_before_they_are_coded(spark):
    tokens = spark.createDataFrame(
        [(i, bytes([(i or 0) % 7, 0]) * 3, 3) for i in [*range(40), None, 7]],
        "order_id BIGINT, ids BINARY, n BIGINT")
    blocks = huffman.encode(huffman.in_shards(tokens, 3), np.array([3] * 7, np.uint8), 7)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.count("MapInArrow") == 1
    assert plan.index("MapInArrow") < plan.index("rangepartitioning")      # the sampled input has no Python
    rows = sorted(blocks.collect(), key=lambda r: (r.shard, r.block))
    assert [d for r in rows for d in r.docs] == [None, *range(8), *range(7, 40)]
    assert sum(r.n_ids for r in rows) == 3 * 42


def test_a_task_refines_few_groups_at_a_time():
    """Memory of a pass is bounded: groups of 300,000 words in all come back in more than one batch."""
    words = [f"w{i}" for i in range(50)]
    rows = [(key, b"%d" % key, " ".join([*words, str(key)]).encode(), 1 + key % 2) for key in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "digest", "words", "n"])
    out = list(repeats._trees(35)(iter([batch])))
    assert len(out) > 1 and sum(map(len, (b.column(0) for b in out))) == 6000
    masks = {d: m for b in out for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert masks[b"0"] & 0xFFFF == 0xFFFF and masks[b"1"] == (1 << 17) - 1


def test_a_pass_without_a_codec_lets_the_worker_s_go(spark):
    def codec_after(rows):                  # in the worker that runs the pass
        first = codec(path)
        assert codec(path) is first
        list(rows([]))
        return codec(path) is first

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not codec_after(tidy(lambda batches: batches))
    made = []

    class Frame:                            # stands for a DataFrame: runs the pass at once
        columns, sparkSession, schema = ["t"], spark, StructType([StructField("t", StringType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            made.append(run)

    field = StructField("n", LongType())
    extend(Frame(), "t", [field], lambda: lambda texts: [[len(t) for t in texts]])
    extend(Frame(), "t", [field], lambda: lambda texts: [[len(t) for t in texts]], uses_kept=True)
    assert not codec_after(made[0]) and codec_after(made[1])


def test_the_pipeline_reads_few_rows_at_once(spark, tmp_path):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, "4096")
    corpus_pipeline.lean(lambda spark, docs, at: docs)(spark, spark.range(1), str(tmp_path))
    assert int(spark.conf.get(name)) == corpus_pipeline.READ_ROWS < 4096
