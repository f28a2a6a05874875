"""Near-duplicate groups that the first hubs can't resolve, against all pairs."""

import random

import pytest

from plain_versions import near_groups
from vigilog.llm import minhash


def check(spark, rows, width=4):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(df, width=width).collect()}
    assert got == near_groups(rows, width)
    return got


def altered(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_around_centres_that_are_no_hubs(spark, seed):
    rng = random.Random(seed)
    rows, key = [], 0
    for centre in range(3):
        base = [f"w{centre}_{rng.randrange(400)}" for _ in range(rng.choice([60, 150]))]
        group = [altered(rng, base, share) for share in
                 [rng.choice([0.005, 0.02, 0.03, 0.05, 0.08]) for _ in range(60)]]
        group.insert(rng.randrange(40, 60), base)                # the centre has no small id
        for words in group:
            rows.append((key, " ".join(words)))
            key += 1
    got = check(spark, rows)
    assert 1 < len({c for _, c in got.values()}) < len(rows)


def test_chains_of_growing_sizes(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[:40 + 4 * i] + [f"own{i}_{k}" for k in range(rng.randrange(4))])) for i in range(30)]
    got = check(spark, rows)
    assert len({c for _, c in got.values()}) < 30


def test_satellites_share_their_changes(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):                                          # words dropped at a few common places
        gone = set(rng.sample(range(0, 100, 7), rng.randrange(1, 7)))
        rows.append((i, " ".join(w for j, w in enumerate(base) if j not in gone)))
    check(spark, rows)


def test_prefix_pairs_have_every_link(spark):
    """The filter alone, with every node open: no link of all pairs is missing."""
    from vigilog.llm.minhash import _by_rarity, _prefix_pairs, _sets

    rng = random.Random(12)
    base = [f"b{rng.randrange(300)}" for _ in range(80)]
    rows = [(i, " ".join(altered(rng, base[:rng.randrange(40, 81)], rng.choice([0, 0.01, 0.03])))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = df.selectExpr("doc_id AS id")
    left = df.selectExpr("1 AS bucket", "doc_id AS node", "doc_id AS root")
    sets = _sets(df, "doc_id", "text", 4, ids)
    found = {(r.a, r.b) for r in _prefix_pairs(left, _by_rarity(sets, left), 80).collect()}
    shingles = {i: {tuple(w[k:k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    links = {(a, b) for a in shingles for b in shingles if a < b and
             100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    same = {(a, b) for a, b in links if shingles[a] == shingles[b]}
    assert links - same <= found and len(found) < 60 * 59 / 2
