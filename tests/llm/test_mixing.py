"""Mixing against a version that lays out single words, and what a mix has to hold."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_versions import words
from vigilog.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def documents(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 40, 200, 900]))),
             rng.choice(["a", "a", "a", "b", "c", "é", "d", None])) for i in range(n)]


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * size[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    return target


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, mixing.mix(df, keep=["doc_id", "source"], **more)


def test_targets_and_taken_words(spark):
    rows = documents()
    _, mix = run(spark, rows)
    got = mix.rows.collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    want, taken = plain_targets(size), Counter()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    for r in got:
        assert r["size"] == len(words(rows[r.doc_id][1]))
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5


def test_equals_a_version_that_takes_single_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 7)
    monkeypatch.setattr(mixing, "DOCS_PER_BUCKET", 13)
    rows = documents(120, 3)
    df, mix = run(spark, rows, shard_blocks=11)
    order = df.select("doc_id", F.xxhash64(F.lit(12), "doc_id", F.xxhash64("text")).alias("h")).collect()
    place = {r.doc_id: r.h % 2**64 for r in order}
    keys = {r.source: r.k for r in df.select("source").distinct().select(
        "source", F.xxhash64(F.lit(12), "source", F.lit("blocks")).alias("k")).collect()}
    key_of = {(s, p): spark.range(1).select(F.xxhash64(F.lit(k), F.lit(p).cast("bigint"))).first()[0]
              for s, k in keys.items() for p in (0, 1)}
    size, want = defaultdict(int), Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    for s, target in plain_targets(size).items():
        stream = [d for d, t, g in sorted(rows, key=lambda r: place[r[0]]) if g == s for _ in words(t)]
        blocks = [stream[i:i + 7] for i in range(0, len(stream), 7)]
        mixed = []
        for p in (0, 1):
            n = np.full(len(blocks), len(blocks))
            at = mixing.permuted(np.arange(len(blocks)), n, np.full(len(blocks), key_of[s, p]))
            assert sorted(at) == list(range(len(blocks)))
            mixed += [d for b in np.argsort(at) for d in blocks[b]]
        want.update(mixed[:int(target + 0.5)])
    assert {r.doc_id: r.taken for r in mix.rows.collect()} == {d: want[d] for d, *_ in rows}


def test_pieces_are_disjoint_and_fill_shards_evenly(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "LEVELS", 2)
    rows = documents(200, 5)
    df, mix = run(spark, rows, shard_blocks=20)
    pieces = mix.pieces.collect()
    seen = Counter((p.key, p.copy, w) for p in pieces for w in range(p.first_word, p.first_word + p.n_words))
    assert set(seen.values()) == {1}
    assert {d: n for d, n in Counter(k for k, _, _ in seen).items()} == {
        r.doc_id: r.taken for r in mix.rows.collect() if r.taken}
    shards = defaultdict(list)
    for p in pieces:
        shards[p.shard].append(p)
    assert len(shards) > 16
    for found in shards.values():
        assert sorted(p.place for p in found) == list(range(len(found)))
    words_in = [sum(p.n_words for p in found) for found in shards.values()]
    assert max(words_in) <= 20 * 16 and min(words_in) >= 14 * 16
    mixing.write(df, mix.pieces, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert len(back) == len(pieces)
    text_of = {d: words(t) for d, t, _ in rows}
    at = {(p.shard, p.place): p for p in pieces}
    for r in back:
        p = at[r.shard, r.place]
        assert r.words.split(" ") == text_of[r.key][p.first_word:p.first_word + p.n_words]


def test_splits_follow_the_hypergeometric_law():
    import pandas as pd

    node = pd.DataFrame({"lo": 0, "hi": 2, "no": [0, 1], "first": [0, 0], "count": [300, 100]})
    draws = [mixing._split(400, 2, seed, 9)(node) for seed in range(400)]
    left = np.array([d[(d["lo"] == 0) & (d["no"] == 1)]["count"].sum() for d in draws])
    assert all((d.groupby("lo")["count"].sum() == 200).all() for d in draws)
    assert abs(left.mean() - 50) < 1 and 15 < left.var() < 23        # 18.8 by the law


def test_reruns_agree_however_partitioned(spark):
    rows = documents(150, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    a = mixing.mix(df.repartition(1), keep=["doc_id"])
    b = mixing.mix(df.repartition(7), keep=["doc_id"])
    assert sorted(a.rows.collect()) == sorted(b.rows.collect())
    facts = ("shard", "place", "key", "copy", "first_word", "n_words")
    assert sorted(a.pieces.select(*facts).collect()) == sorted(b.pieces.select(*facts).collect())


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "x y z", "b"), (None, "x y z", "b"),
            (4, "word " * 50_000, "b"), (5, "one", ""), (5, "one", ""), (5, "two words", "")]
    _, mix = run(spark, rows)
    got = sorted(map(tuple, mix.rows.collect()), key=repr)
    assert len(got) == len(rows)
    assert [(r[0], r[2], r[5]) for r in got if r[2] == 0] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert all(r[5] <= 2 * r[2] for r in got)
    empty = run(spark, [])[1]
    assert empty.rows.collect() == [] and empty.pieces.collect() == []
    nothing = run(spark, [(1, None, None), (2, "", "a")])[1]
    assert [r.taken for r in nothing.rows.collect()] == [0, 0]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"a b c {i}", "s") for i in range(20)], SCHEMA).selectExpr(
        "*", "1 AS size", "2 AS number", "3 AS no", "4 AS h", "5 AS key", "6 AS row", "7 AS start")
    got = mixing.mix(df).rows
    assert got.columns == ["doc_id", "text", "source", "number", "no", "h", "key", "row", "start",
                           "size", "source_size", "target", "taken"]
    assert {(r["size"], r.number, r.no, r.h, r.key, r.row, r.start) for r in got.collect()} == {(4, 2, 3, 4, 5, 6, 7)}
