"""What one task or one micro-batch holds doesn't grow with the log or with the length of texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import make_log
from vigilog.functions.embedding import hashed_words, with_embedding
from vigilog.operators import batching
from vigilog.plans import catalog
from vigilog.session import ARROW_BYTES, configure
from vigilog.streaming import jobs


def test_an_embedder_gets_few_long_texts_at_once(spark):
    def factory():
        def embed(texts):
            if sum(map(len, texts)) > 2 * ARROW_BYTES:
                raise ValueError("too much text at once")
            return hashed_words()()(texts)

        return embed

    texts = configure(spark).range(120).repartition(1).select("id", F.repeat(F.lit("word "), 40_000).alias("text"))
    found = with_embedding(texts, "text", factory).select(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.count("s"), F.min("s"), F.max("s")).first()
    assert tuple(found) == (120, 1.0, 1.0)


def test_vectors_equal_word_counts(spark):
    texts = [f"a{i % 7} b{i % 5} A{i % 7} é" for i in range(700)] + ["", None, "..."]
    got = hashed_words(16)()(texts)
    one_by_one = np.vstack([hashed_words(16)()([t]) for t in texts])
    assert (got == one_by_one).all() and not got[-3:].any()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    stored = with_embedding(rows, "text", hashed_words(16)).orderBy("id").collect()
    assert [r.embedding for r in stored] == got.tolist()


def test_an_embedder_has_to_give_a_vector_per_text(spark):
    rows = with_embedding(spark.createDataFrame([("a",), ("b",)], "text STRING").coalesce(1), "text",
                          lambda: lambda texts: np.zeros((1, 4)))
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        rows.collect()


def test_tasks_of_batches_grow_with_the_entries(spark, monkeypatch):
    monkeypatch.setattr(batching, "ENTRIES_PER_TASK", 10)
    log = make_log(spark, 200)[0]
    n = log.count()
    found = batching.assign_batches(log, 5)
    assert found.rdd.getNumPartitions() == -(-n // 10)
    assert found.groupBy("source", "batch_id").count().filter("count != 5").isEmpty()


def test_a_segment_is_one_micro_batch_however_many_files_it_has(spark, tmp_path):
    (spark.range(4000).repartition(6).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 600) AS ts", "id % 50 AS user_id",
        "'view' AS event_type", "1.0D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet"))
    jobs.write_parquet(catalog.live(configure(spark), str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/state",
                       catalog.ONCE).awaitTermination()
    commits = [f for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit()]
    assert len(commits) == 4
    got = spark.read.parquet(f"{tmp_path}/out").select("line_number")
    want = catalog.kept(spark, str(tmp_path)).select("line_number")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
