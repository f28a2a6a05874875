"""Operators on document tables against plain-Python versions, with odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import plain_versions as H
from vigilog.llm import bpe, decontaminate, huffman, minhash, neighbours, repeats, rules, toxicity
from vigilog.llm.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in "ka le mi no pu sa te vi".split() for b in "n r st l m".split()]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE, BASE = prose(60), prose(200)
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(30) + " " + PASSAGE + "\n" + prose(9)),
    (6, PASSAGE), (7, BASE), (8, BASE), (9, BASE.replace("kan", "KAN")),
    (10, " ".join(w if i % 40 else "changed" for i, w in enumerate(BASE.split()))),
    (11, "a " * 90), (12, prose(4000)), (13, "Ünïcode “quotes” 漢字 <|endoftext|>  end \x1c."),
    (14, PASSAGE.upper()), (15, "x" * 5000), (16, prose(3)), (17, PASSAGE + " " + PASSAGE),
]
CLASH = "doc_id BIGINT, text STRING, n_words STRING, score STRING, ids STRING, component_id STRING"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "mine", "mine", "mine", "mine") for k, t in ODD]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_byte_pairs_match_the_library_and_come_back(spark, docs, empty):
    library = Tokenizer.from_file(BYTE)
    got = by_id(bpe.decode(bpe.encode(docs, BYTE), BYTE))
    told = by_id(bpe.round_trip(docs, BYTE, keep=["doc_id"]))
    for k, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].score == "mine"
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False)
        assert (told[k].n_tokens, told[k].ids_sha256) == (len(ids), H.sha(",".join(map(str, ids))))
        assert told[k].decoded_sha256 == H.sha(text or "")
    assert bpe.encode(empty, BYTE).count() == 0


def test_byte_pairs_on_random_text():
    library, codec = Tokenizer.from_file(BYTE), bpe.codec(BYTE)
    letters = list("aabethinr  \n\t'sS.,19<|>üñ∈漢é\x1c\xa0　")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, bounds = codec.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(
            t, add_special_tokens=False).ids, repr(t)


def test_automaton_accepts_only_canonical_sequences():
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"ab"), (b"b", b"a"), (b"ab", b"ba")]
    names = [b"a", b"b", *(x + y for x, y in merges)]
    automaton = bpe.TokenAutomaton({n: i for i, n in enumerate(names)}, merges)

    def by_rule(word):
        parts = [bytes([c]) for c in word]
        for x, y in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i:i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for n in range(1, 11):
        for code in range(2 ** n):
            word = bytes(b"ab"[code >> i & 1] for i in range(n))
            assert [names[i] for i in automaton.encode(word)] == by_rule(word), word
    with pytest.raises(ValueError):
        automaton.encode(b"z")


def test_huffman_files(spark, docs, empty, tmp_path):
    library, start = Tokenizer.from_file(WORD), 0
    huffman.write(docs, str(tmp_path / "a"), WORD, end_id=1)
    got = by_id(huffman.read(spark, str(tmp_path / "a")))
    for k, text in sorted(ODD):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[k].start, got[k].n_tokens, bytes(got[k].ids)) == (start, len(ids), raw)
        start += len(ids)
    huffman.write(docs.union(docs), str(tmp_path / "b"), WORD, end_id=1)
    twice = huffman.read(spark, str(tmp_path / "b"))
    assert twice.count() == 2 * len(ODD) and twice.agg(F.sum("n_tokens")).first()[0] == 2 * start
    huffman.write(empty, str(tmp_path / "c"), WORD, end_id=1)
    assert huffman.read(spark, str(tmp_path / "c")).count() == 0


def test_code_lengths_are_short_and_complete():
    for n, limit in ((1, 16), (2, 16), (300, 9), (300, 16), (5000, 13)):
        counts = np.array([int(3 ** (i % 30)) for i in range(n)] + [0, 0])
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(float)
        assert used.max() <= limit and not lengths[counts == 0].any()
        assert n == 1 or (2.0 ** -used).sum() == 1
        coder = huffman.Coder(lengths)
        ids = np.random.default_rng(n).integers(0, n, 2000)
        bits, checkpoints = coder.encode(ids, np.array([0, len(ids)]))
        at = np.frombuffer(checkpoints[0], "<u4")
        lanes = np.minimum(huffman.STRIDE, len(ids) - huffman.STRIDE * np.arange(len(at)))
        assert coder.decode(bits[0], at, lanes).tolist() == ids.tolist()


def test_rules(spark, docs, empty):
    got = by_id(rules.apply_rules(docs, rules.plan_from(docs).rules))
    for k, text in ODD:
        w, t = H.words(text), text or ""
        lines = [x for x in t.split("\n") if H.words(x)]
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i:i + 3]), []).append(i)
        again = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
            len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed) and r.kept == (r.rejected_by is None)
    assert rules.apply_rules(empty, rules.plan_from(empty).rules).count() == 0


def test_plan_orders_by_rejections_per_cost_and_keeps_the_verdict():
    cheap = rules.Rule("cheap", lambda d: len(d.words) % 2 == 0, cost=1.0)
    dear = rules.Rule("dear", lambda d: len(d.words) % 3 > 0, cost=9.0)
    never = rules.Rule("never", lambda d: False, cost=0.1)
    plan = rules.plan([prose(n) for n in range(30)], (never, dear, cheap))
    assert [r.name for r in plan.rules] == ["cheap", "dear", "never"]
    assert plan.measured["dear"][2] == 15            # it saw what the first rule let pass


def test_repeats(spark, docs, empty):
    got = {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in by_id(repeats.digests(docs)).items()}
    assert got == H.repeats(ODD)
    left = by_id(repeats.remove_repeats(docs))
    assert set(left) == {k for k, _ in ODD} and left[12].text == dict(ODD)[12]
    assert left[6].text == "" and left[1].text is None and left[5].score == "mine"
    assert repeats.digests(empty).count() == 0 and repeats.remove_repeats(empty).count() == 0


def test_repeats_in_groups_too_large_for_a_task(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_SEGMENTS", 1)
    got = {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in by_id(repeats.digests(docs)).items()}
    assert got == H.repeats(ODD)


def test_repeated_rows_and_null_ids_in_repeats(spark):
    rows = [(None, PASSAGE), (1, BASE), (1, BASE), (1, "other text " + PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted((r.n_words, r.n_removed) for r in repeats.digests(df).collect())
    assert got == [(60, 60), (62, 60), (200, 200), (200, 200)]


def test_near_groups(spark, docs, empty):
    got = {k: (r.n_shingles, r.component_id) for k, r in by_id(minhash.groups(docs, width=4)).items()}
    assert got == H.near_groups(ODD)
    kept = by_id(minhash.keep_first(docs))
    assert 7 in kept and 8 not in kept and 9 not in kept and {1, 2, 3} <= set(kept)
    assert kept[7].component_id == "mine"
    assert minhash.groups(empty).count() == 0 and minhash.keep_first(empty).count() == 0


def test_chains_of_near_copies_are_followed(spark):
    text, rows = prose(220).split(), []
    for i in range(40):                        # each is near the one before, not near the first
        rows.append((i, " ".join(text)))
        for j in range(4):
            text[(5 * i + 53 * j) % len(text)] = f"new{i}x{j}"
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = {k: (r.n_shingles, r.component_id) for k, r in by_id(minhash.groups(df, width=4)).items()}
    assert got == H.near_groups(rows)


def test_super_minhash_estimates_similarity():
    random_ = np.random.default_rng(1)
    shares = []
    for _ in range(60):
        a = random_.integers(0, 2 ** 63, 300, dtype=np.uint64)
        x, y = minhash.super_minhash(a[:270], 128), minhash.super_minhash(a[30:], 128)
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01 and np.std(shares) < (0.8 * 0.2 / 128) ** 0.5


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(links, "a BIGINT, b BIGINT").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {500 + i: 500 for i in range(1, 50)}


ITEMS = [("q1", PASSAGE), ("q2", prose(14)), ("q3", "Short Item, here!"), ("q4", None), ("q5", ""),
         ("q6", PASSAGE), (None, prose(12))]


def test_benchmark_hits(spark, docs, empty, monkeypatch):
    rows = ODD + [(20, "x, " + ITEMS[1][1].upper() + " short item HERE y"), (21, "short item")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id STRING, text STRING")
    named = [x for x in ITEMS if x[0]]
    want = {k: H.hits(t, named) for k, t in rows}

    def found(frame):
        return {r.doc_id: (r.n_words, sum(bytes(r.hit)), r.item_ids)
                for r in decontaminate.find_hits(frame, items).collect()}

    assert found(df) == want
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(df, items).collect()}
    assert 6 not in clean and clean[7] == BASE and clean[1] is None
    assert all(not H.hits(t, named)[1] for t in clean.values())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert found(df) == want
    assert decontaminate.find_hits(docs, items).columns.count("n_words") == 1
    assert decontaminate.find_hits(empty, items).count() == 0
    assert sum(n for _, n, _ in map(lambda r: (0, sum(bytes(r.hit)), 0), decontaminate.find_hits(
        df, items.limit(0)).collect())) == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of which every fourth holds insults and every fifth is shouted."""
    rows, labels = [], []
    for i in range(400):
        text = prose(60)
        if i % 4 == 0:
            text += " you scum and moron " + prose(5)
        if i % 5 == 0:
            text = " ".join(f"{w}###" for w in text.upper().split())
        rows.append((i, text))
        labels.append((i, int(i % 5 != 0), int(i % 4 == 0)))
    return (spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id BIGINT, text STRING"),
            spark.createDataFrame([*labels, (999, 1, 1), (None, 0, 1), (3, None, None)],
                                  "doc_id BIGINT, quality INT, toxic INT"))


def test_toxicity_of_held_out_texts(spark, marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score < 0.5
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_risk_is_not_negative_and_corrects_for_the_prior():
    random_ = np.random.default_rng(2)
    positive = (random_.random((200, 6)) < [.9, .8, .3, .3, .3, .3]).astype(float)
    rest = (random_.random((1600, 6)) < [.05, .05, .3, .3, .3, .3]).astype(float)
    unlabelled = np.vstack([rest, positive])             # one in nine is positive
    w, b = toxicity.fit_nnpu(positive, unlabelled, 1 / 9)
    # The best rule asks for both of the first two features: 0.9 * 0.8 of the positives.
    assert ((rest @ w + b) < 0).mean() > 0.95 and ((positive @ w + b) > 0).mean() > 0.65


def test_quality_votes_of_held_out_texts(spark, marked):
    docs, labels = marked
    space = neighbours.fit(docs, labels)
    got = by_id(neighbours.score(docs, space))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.5) == (i % 5 != 0) for i in held) >= 0.95 * len(held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert neighbours.fit(docs, labels.limit(0)) is None
    assert {r.score for r in neighbours.score(docs, None).collect()} == {0.5}
