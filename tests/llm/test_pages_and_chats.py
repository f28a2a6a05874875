"""Page extraction, chat folding and the pipeline."""

import pytest
from pyspark.sql import functions as F

import plain_versions as H
from vigilog.llm import chat, webpages

PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav>"
        "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>One\n two<br>three "
        "<b>bold</b><p>next<script>x('</p>')</script><div id=comments><p>me too</div>"
        "<aside>side</aside><p>last&nbsp;one</article><footer>foot</footer></body>")


def test_blocks_of_an_article():
    text = "\n".join(t for _, t in webpages.blocks_of(PAGE))
    assert text == "Head & line\nOne two\nthree bold\nnext\nlast one"
    for odd in (None, "", "plain", "<", "<p", "<article>", "a < b", "<!--", "<p class='x>y"):
        webpages.blocks_of(odd)
    assert webpages.blocks_of("plain text") == [(webpages.OPEN, "plain text")]
    assert webpages.blocks_of("<article>" * 500 + "deep")[-1] == (webpages.MAIN, "deep")


@pytest.mark.parametrize("page, text", [
    ("<div class='site has-sidebar'><article><p>one</article></div>", "one"),
    ("<main class='with-footer'><p>one</main>", "one"),
    ("<article><div class='entry-header'><h1>Head</h1></div><p>one</article>", "Head|one"),
    ("<article><p>one<section id='related-work'><p>two</section></article>", "one|two"),
    # What holds an article stays as a whole, what holds none does not.
    ("<div class=widget>a<div id=sidebar>b<article>one</article></div>c<div class=ad>d</div></div>",
     "a|b|one|c"),
    ("<app class='menu'><main>one</main></app><div class='site_footer'>x</div>two", "one|two"),
    ("<span>one <b class=share>x</b>two</span>", "one two"),
    ("<main class=widget>one<div class='ad'>x</div></main>", "one"),
    ("<div class=ad>" * 300 + "<article>one</article>", "one"),
    ("<div class=ad>x<nav><article>y</article></nav></div>two", "two"),
    ("<article>one<div class=comments><article>x</article></div></article>", "one"),
    ("<div class=ad>x<p>y</div><p class='Comment-List'>z<p>two", "two"),
])
def test_marked_elements_never_take_an_article_along(page, text):
    assert "|".join(t for _, t in webpages.blocks_of(page)) == text


def test_suffix_arrays_drop_what_pages_of_a_host_share(spark):
    shared = "all rights are kept by the owners of this fine site since the start"
    rows = [(i, f"http://h.example/{i}", f"<p>{' '.join(f'w{i}n{j}' for j in range(20))}<p>{shared}")
            for i in range(6)]
    rows += [(10, "http://other.example/", f"<p>{shared}"), (11, None, None), (12, "x", "")]
    rows += [(13, "http://c.example/1", "<p>" + "copied text " * 10)] * 2
    pages = spark.createDataFrame([(*r, "mine") for r in rows],
                                  "page_id BIGINT, url STRING, html STRING, text STRING")
    got = {}
    for r in webpages.extract(pages.repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r)
    for i in range(6):
        assert got[i][0].text == " ".join(f"w{i}n{j}" for j in range(20))
    assert got[10][0].text == shared and got[11][0].text == "" and got[12][0].n_chars == 0
    assert len(got[13]) == 2 and all(r.text == ("copied text " * 10).strip() for r in got[13])
    assert webpages.extract(pages.limit(0)).count() == 0


def test_unmarked_notices_beside_different_articles_are_dropped(spark):
    long = "this site will be closed for repairs from nine to ten tonight"
    rows = [(i, f"http://h.example/{i}", f"<div>{n}</div><article><p>{t}</article>")
            for i, (n, t) in enumerate([(long, "one"), (long, "two"), ("Log in", "three"),
                                        ("Log in", "four"), ("only here", "five")])]
    rows += [(9, "http://h.example/9", "<div>seen twice</div><article><p>copy</article>")] * 2
    rows += [(10, "http://other.example/", f"<div>{long}</div><div>Log in</div><article>six</article>")]
    words = " ".join(f"w{i}" for i in range(9))
    rows += [(11, "http://h.example/11", f"<div>Log in</div><p>{words}")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(3)
    got = sorted((r.page_id, r.text) for r in webpages.extract(pages).collect())
    assert got == [(0, "one"), (1, "two"), (2, "three"), (3, "four"), (4, "only here\nfive"),
                   (9, "seen twice\ncopy"), (9, "seen twice\ncopy"),
                   (10, f"{long}\nLog in\nsix"), (11, words)]


def events(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id BIGINT, message BIGINT, seq BIGINT, kind STRING, role STRING, text STRING")


def test_events_are_folded(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"),
            (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "regenerate", "assistant", None),
            (1, 1, 5, "delta", None, "y"), (1, 1, 4, "delta", None, "Ye"),
            (1, 1, 4, "delta", None, "Ye"),                       # delivered twice
            (1, 0, 6, "edit", None, "hello"), (2, None, None, None, None, None)]
    got = {(r.conv_id, r.message): (r.role, r.text)
           for r in chat.fold(events(spark, rows).repartition(4)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "Yey"), (2, None): ("", "")}
    assert chat.fold(events(spark, [])).count() == 0


def test_tied_and_null_turns_stay_separate_as_in_the_twin(spark, tmp_path):
    import duckdb
    from compare import difference
    from vigilog.llm import queries

    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"),      # ties and a copy
            (1, 1, "assistant", "x"), (1, 1, "assistant", "y"),
            (2, 3, "assistant", "last"), (2, None, "assistant", "n1"), (2, None, "assistant", "n2"),
            (3, None, "user", None), (3, None, "user", "")]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
                          ).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), queries.op7_chat, queries.ORACLE["op7_chat"]) is None


@pytest.mark.parametrize("text", ["", "&lt;", "</s>[INST] ok [/INST]", "a]b[c<d>e&f;&amp;amp;",
                                  "\\E\\Q $1 %s", "ü漢\n\n"])
def test_texts_come_back_whatever_they_imitate(spark, text):
    rows = [(7, 0, 0, "message", "system", text), (7, 1, 1, "message", "assistant", text),
            (7, 2, 2, "message", "us]er", text), (7, 3, 3, "message", "assistant", text + "!")]
    out = chat.render(chat.fold(events(spark, rows)))
    r = out.select(chat.read_turns(F.col("formatted")).alias("turns"),
                   chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5]) for x in rows]
    assert r.learnt == text + text + "!"


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    import corpus_pipeline
    from test_texts import BASE, PASSAGE, prose

    leak = prose(40)
    rows = [(i, prose(80) + (" you scum and moron" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200, BASE), (201, BASE), (202, f"{prose(70)} {PASSAGE} {prose(70)}"),
             (203, f"{prose(70)} {PASSAGE} {prose(70)}"), (204, f"{prose(60)} {leak} {prose(60)}"),
             (205, None), (206, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows],
                                 "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)],
                          "doc_id BIGINT, quality INT, toxic INT").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id BIGINT, text STRING").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    at, texts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        texts.append({r.doc_id: r for r in at.collect()})
    toxic, near, cut, clean = texts
    assert not {i for i in range(0, 120, 4)} & set(toxic) and {i for i in range(1, 120, 4)} <= set(toxic)
    assert 200 in near and 201 not in near
    assert PASSAGE not in cut[202].text and PASSAGE not in cut[203].text
    assert cut[202].n_chars == len(cut[202].text) and cut[1].text == dict(rows)[1]
    assert H.hits(clean[204].text, [(1, leak)])[1] == 0 and len(clean) == len(cut)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(clean) and all(r.exact for r in out)
