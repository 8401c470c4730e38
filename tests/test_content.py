from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelode.functions.text import browser_trim, count_literal, decode_entities, escape_html, fold_title, inline_bold, js_json, replace_segments
from sitelode.operators import content

HEADER = '---\ntitle: "A: b"\nkey : v \ntitle:  "last"  \nbroken\nempty:\nq: "say "hi""\n---\n\nBody\n'


def one(spark, value, expr, column="x"):
    return spark.createDataFrame([(value,)], f"{column} string").select(expr.alias("r")).first().r


def parsed(spark, text, dialect="tolerant"):
    return content.front_matter(spark.createDataFrame([(text,)], "text string"), dialect=dialect).first()


def test_front_matter(spark):
    row = parsed(spark, HEADER)
    assert row.meta == {"title": "last", "key": "v", "empty": "", "q": 'say "hi"'}
    assert row.body == "Body"


@pytest.mark.parametrize("text", ["no head", "", "---\ntitle: x\nno end", " ---\na: b\n---\nx"])
def test_without_front_matter_the_text_is_kept(spark, text):
    row = parsed(spark, text)
    assert row.meta == {} and row.body == text


def test_dialects(spark):
    loose = "--- \nTitle2: a\nname: \"b\n---  \nx"
    assert parsed(spark, loose).meta == {"Title2": "a", "name": '"b'}
    assert parsed(spark, loose, "strict").meta == {}
    assert parsed(spark, loose, "letters").meta == {"name": "b"}


def test_metadata_fallbacks(spark):
    docs = spark.createDataFrame([({"eyebrow": "", "category": "C", "excerpt": "E", "title": "T"},)], "meta map<string,string>")
    row = content.article_metadata(docs).first()
    assert (row.eyebrow, row.deck, row.description, row.format, row.image_alt) == ("C", "E", "E", "", "T")


MARKDOWN = "Hello **b** & <c>\n- a\n- b\n1. one\n2.  two\n\n3. three\n \n## H ##\n### I\n#### J\n1.x\n-y\n- \r\nlast **open"
RENDERED = (
    "<p>Hello <strong>b</strong> &amp; &lt;c&gt;</p>\n<ul><li>a</li><li>b</li></ul>\n<ol><li>one</li><li>two</li></ol>\n"
    "<ol><li>three</li></ol>\n<h2>H ##</h2>\n<h3>I</h3>\n<p>#### J</p>\n<p>1.x</p>\n<p>-y</p>\n<ul><li></li></ul>\n<p>last **open</p>"
)


def test_rendered_body(spark):
    assert one(spark, MARKDOWN, content.render_body(F.col("x"))) == RENDERED
    assert one(spark, "", content.render_body(F.col("x"))) == ""


def test_blocks_give_the_rendered_body(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, "\n\n")], "doc int, body string")
    blocks = content.markdown_blocks(docs, ["doc"]).collect()
    assert {b.doc for b in blocks} == {1}
    assert [(b.block_id, b.pos, b.kind, b["item"]) for b in sorted(blocks, key=lambda b: (b.block_id, b.pos))][:6] == [
        (0, 0, "p", "Hello **b** & <c>"),
        (1, 0, "ul", "a"),
        (1, 1, "ul", "b"),
        (2, 0, "ol", "one"),
        (2, 1, "ol", "two"),
        (3, 0, "ol", "three"),
    ]


def test_text_expressions(spark):
    assert one(spark, "﻿  a b \n", browser_trim(F.col("x"))) == "a b"
    assert one(spark, "<a href='x'>&\"", escape_html(F.col("x"))) == "&lt;a href=&#039;x&#039;&gt;&amp;&quot;"
    assert one(spark, "**a**b** c\n**d", inline_bold(F.col("x"))) == "<strong>a</strong>b** c\n**d"
    assert one(spark, "&amp;mdash; &mdash;", decode_entities(F.col("x"))) == "&mdash; —"
    assert one(spark, " It&rsquo;s &#8220;x” &amp; ", fold_title(F.col("x"))) == "It's \"x\" &"
    assert one(spark, "aaaa", count_literal(F.col("x"), "aa")) == 2
    assert one(spark, 'a"\\\n/é', js_json(F.col("x"))) == '"a\\"\\\\\\n/é"'


@pytest.mark.parametrize("text", ["", "x", "[a]", "[a][b]", "p[a]q[b]r", "[a]p", "p[a]"])
def test_segments_are_loss_free(spark, text):
    keep = replace_segments(F.col("x"), r"\[[^\]]*\]", lambda m: m)
    swap = replace_segments(F.col("x"), r"\[[^\]]*\]", lambda m: F.lit("$1\\"), hint="[")
    assert one(spark, text, keep) == text
    assert one(spark, text, swap) == text.replace("[a]", "$1\\").replace("[b]", "$1\\")


def test_asset_audio_and_cta(spark):
    paths = ["../../a.png", "./a.png", "/a.png", "HTTP://x/a", "mailto:x", "data:x", "a/../b.png", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.a for r in df.select(content.resolve_asset(F.col("p")).alias("a")).collect()]
    assert got == ["../a.png", "../a.png", "../a.png", "HTTP://x/a", "mailto:x", "data:x", "../a/../b.png", "", None]
    assert one(spark, "x.M4A", content.audio_type(F.col("x"))) == "audio/mp4"
    assert one(spark, "", content.audio_type(F.col("x"))) is None
    assert one(spark, "", content.cta_href(F.col("x"), F.lit("/h"), "d")) is None
    assert one(spark, "Go", content.cta_href(F.col("x"), F.lit(""), "d")) == "d"


def test_article_parts_in_order(spark):
    meta = {"audio": "../a.m4a", "contentImage": "/i.png", "contentImageAlt": 'x"y', "ctaLabel": "Go & see"}
    docs = spark.createDataFrame([(meta, "text")], "meta map<string,string>, body string")
    assert content.render_article(docs, "mailto:a@b.cd").first().rendered == (
        '<div class="insight-audio"><audio controls><source src="../a.m4a" type="audio/mp4"></audio></div>'
        '<figure class="insight-content-image"><img src="../i.png" alt="x&quot;y"><figcaption></figcaption></figure>'
        "<p>text</p>"
        '<div class="insight-article-cta"><a href="mailto:a@b.cd" class="btn btn-primary">Go &amp; see</a></div>'
    )


def test_only_awaited_documents_are_rendered(spark):
    pages = spark.createDataFrame([(1, "<main></main>"), (2, "<main><!--PRERENDERED--></main>"), (3, None), (4, "")], "id int, html string")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "d"), (None, "e")], "id int, body string")
    assert sorted(r.id for r in content.awaited(docs, pages, "id").collect()) == [1, 3]


def test_prerender_keeps_the_tag_and_runs_once(spark):
    page = '<body><main id="m">old</main><main>two</main>\n <script src="/js/detail.js" defer></script></body>'
    pages = spark.createDataFrame([(1, page), (2, page)], "id int, html string")
    bodies = spark.createDataFrame([(1, "cost $1 \\ more")], "id int, rendered string")
    once = content.prerender(pages, bodies, "id", drop_script="detail.js")
    got = {r.id: r for r in once.collect()}
    assert got[1].html_new == '<body><main id="m">\n<!--PRERENDERED-->\ncost $1 \\ more\n</main><main>two</main></body>'
    assert (got[2].status, got[2].html_new) == ("no_body", page)
    again = content.prerender(once.select("id", F.col("html_new").alias("html")), bodies, "id")
    assert {r.id: r.status for r in again.collect()} == {1: "already", 2: "no_body"}


def test_series(spark):
    parts = spark.createDataFrame([("s", i, f"T{i}", f"{i}.html") for i in (1, 2, 5)], "key string, part int, title string, href string")
    out = content.series_cards(content.series_navigation(parts, ["key"], "part", "Hub", "hub.html", "All", labels=("Back to Series", "Previous Brief", "Next Brief"), chunk=2))
    got = [tuple(r) for r in out.orderBy("part").select("prev_label", "prev_title", "next_title", "next_href", "card").collect()]
    assert got == [
        ("Back to Series", "Hub", "T2", "2.html", "Part 1 of 3"),
        ("Previous Brief", "T1", "T5", "5.html", "Part 2 of 3"),
        ("Previous Brief", "T2", "All", "hub.html", "Part 3 of 3"),
    ]


def test_series_body(spark):
    df = spark.createDataFrame([([f"p{i}" for i in range(7)],)], "b array<string>")
    html = df.select(content.render_series_body(F.col("b"), F.lit("q&")).alias("r")).first().r
    assert html.index("<p>p4</p>") < html.index("<blockquote>q&amp;</blockquote>") < html.index("<p>p5</p>")
