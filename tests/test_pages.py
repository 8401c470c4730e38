"""Rewriting, links, assets, JSON-LD and attribution on small fixtures."""

from __future__ import annotations

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from sitelode.functions import urls
from sitelode.functions.images import image_size
from sitelode.operators import assets, attribution, jsonld, links
from sitelode.operators import rewrite as rw


def corpus(spark, *htmls):
    return spark.createDataFrame([(i, f"/d/p{i}.html", h) for i, h in enumerate(htmls)], "id int, path string, html string")


def result(spark, html, *rules):
    row = rw.rewrite_pages(corpus(spark, html), list(rules)).first()
    return row.html_new, [(e.status, e.n_repl) for e in row.ledger]


RULES = [
    rw.word("word", "ABC", "Long name", outside=rw.COMMENTS_AND_STYLES),
    rw.Insert(name="insert", text="<i>new</i>", anchors=["</footer>"], guard="<i>new</i>"),
    rw.asset_version("/s.css", "9"),
    rw.double_slash(),
    rw.root_background(),
    rw.hero_priority('<figure class="hero">'),
    rw.tidy_void_tags(),
    rw.drop_script("old.js"),
]
PAGE = (
    '<link href="/s.css?v=1"><style>.ABC{}</style><!-- ABC -->ABC éABC xABC <a href="//assets/x">'
    '<a href="//cdn.example/x"><div style="background:url(\'assets/a.png\')">'
    '<figure class="hero"> <img src="a.png" loading="lazy" / data-x></figure><footer></footer>'
    '\n<script src="/js/old.js" defer></script>'
)


def test_all_rules_once_and_twice(spark):
    once, ledger = result(spark, PAGE, *RULES)
    assert once == (
        '<link href="/s.css?v=9"><style>.ABC{}</style><!-- ABC -->Long name éLong name xABC <a href="/assets/x">'
        '<a href="//cdn.example/x"><div style="background:url(\'/assets/a.png\')">'
        '<figure class="hero"> <img src="a.png" data-x fetchpriority="high" loading="eager"></figure><footer><i>new</i></footer>'
    )
    assert ledger == [("updated", 2), ("updated", 1), ("updated", 1), ("updated", 1), ("updated", 1), ("updated", 1), ("updated", 1), ("updated", 1)]
    twice, statuses = result(spark, once, *RULES)
    assert twice == once
    assert {s for s, _ in statuses} <= {"already", "no_match", "unchanged"}


def test_ledger_adds_up(spark):
    pages = corpus(spark, PAGE, "", "<footer></footer>", None)
    totals = rw.ledger_totals(rw.rewrite_pages(pages, RULES)).collect()
    for rule in {t.rule for t in totals}:
        assert sum(t.pages for t in totals if t.rule == rule) == 4
    assert rw.changed_only(rw.rewrite_pages(pages, RULES)).count() == 2


def test_literal_text_is_never_a_pattern(spark):
    assert result(spark, "a.b", rw.ReplaceText(name="r", old=".", new="$1\\"))[0] == "a$1\\b"
    assert result(spark, "x a", rw.word("r", "a", "$0\\"))[0] == "x $0\\"
    assert result(spark, "ab", rw.Insert(name="r", text="$&", anchors=["b"]))[0] == "a$&b"


def test_anchors(spark):
    last = rw.Insert(name="r", text="+", anchors=["<s>", "</main>"], last=frozenset({"<s>"}))
    assert result(spark, "<s>1<s>2</main>", last)[0] == "<s>1+<s>2</main>"
    assert result(spark, "1</main>2</main>", last)[0] == "1+</main>2</main>"
    assert result(spark, "none", last) == ("none", [("no_match", 0)])
    after = rw.Insert(name="r", text="+", anchors=["x"], after=True)
    assert result(spark, "axbx", after)[0] == "ax+bx"


def test_first_match_with_groups(spark):
    rule = rw.ReplacePattern(name="r", pattern=r"<b>(\w+)</b>", replacement="[$1]", first=True)
    assert result(spark, "\n<b>a</b><b>c</b>", rule)[0] == "\n[a]<b>c</b>"


def test_all_or_nothing(spark):
    rule = rw.AllOf(name="r", parts=[rw.ReplaceText(name="", old="a", new="b"), rw.ReplaceText(name="", old="bb", new="c")])
    assert result(spark, "ab", rule)[0] == "c"
    assert result(spark, "a", rule) == ("a", [("no_match", 0)])


def test_strict_rule_fails(spark):
    with pytest.raises(Exception, match="r: text to replace not found"):
        result(spark, "x", rw.ReplaceText(name="r", old="y", new="z", strict=True))


def test_move_line(spark):
    rule = rw.MoveLine(name="r", line_pattern=r'(?m)^  <p class="m">[^<]*</p>\n', marker='<p class="m"', above="  <div>")
    moved, status = result(spark, 'a\n  <div>\n    <q>  \n  <p class="m">x</p>\nend', rule)
    assert moved == 'a\n  <p class="m">x</p>\n  <div>\n    <q>  \nend' and status == [("updated", 1)]
    assert result(spark, moved, rule) == (moved, [("already", 0)])
    assert result(spark, "a", rule) == ("a", [("no_match", 0)])


def test_replace_by_key_leaves_unknown_keys(spark):
    rule = rw.ReplaceByKey(
        name="r", pattern=r'<b k="(\w+)">', key_group=1, values={"a": "/a$1/"}, build=lambda m, v: F.concat(F.lit("<"), v, F.lit(">"))
    )
    assert result(spark, '<b k="a"><b k="z"><b k="a">', rule) == ('</a$1/><b k="z"></a$1/>', [("updated", 2)])


def test_scope(spark):
    rule = rw.ReplaceText(name="r", old="a", new="b", scope=F.col("id") == 1)
    out = rw.rewrite_pages(corpus(spark, "a", "a"), [rule]).orderBy("id").collect()
    assert [(r.html_new, r.ledger[0].status) for r in out] == [("a", "out_of_scope"), ("b", "updated")]


def test_image_dimensions(spark):
    tags = '<img src="/a.png" alt="x"><img alt="y" src="https://own.ex/a.png"/><img src="/a.png" width="1"><img src="b.png"><img src="/none.png"><img>'
    sizes = spark.createDataFrame([("/a.png", 3, 4), ("b.png", 5, 6)], "path string, width int, height int")
    out = rw.enrich_images(corpus(spark, tags, "none"), sizes, "id", site_origin="https://own.ex").orderBy("id").collect()
    dims = ' width="3" height="4"'
    assert out[0].html_new == (
        f'<img src="/a.png"{dims} alt="x"><img alt="y" src="https://own.ex/a.png"{dims}/><img src="/a.png" width="1"><img src="b.png"><img src="/none.png"><img>'
    )
    assert out[1].html_new == "none"


def test_coverage_and_residuals(spark):
    pages = corpus(spark, "hook mark", "hook", "mark")
    assert [r.status for r in rw.token_coverage(pages, "hook", "mark").orderBy("id").collect()] == ["already", "to_do", "no_hook"]
    assert {(r.id, r.token) for r in rw.residual_tokens(pages, ["mark", "zz"], ["id"]).collect()} == {(0, "mark"), (2, "mark")}


RESOLVED = [
    ("/a/b/c.html", "../x.html", "/a/x.html"),
    ("/a/b/c.html", "./q/", "/a/b/q/"),
    ("/a/b.html", "../../../z.png", "/z.png"),
    ("a.html", "z//y.png", "/z/y.png"),
    ("/a.html", "./", "/"),
    ("/a.html", "..", "/"),
    ("/a/b.html", "x/..", "/a"),
    ("/a.html", "#f", None),
    ("/a.html", "mailto:x", None),
    ("/a.html", "/abs", None),
    ("/a.html", "https://x/y", None),
]


def test_resolution(spark):
    df = spark.createDataFrame([(p, r) for p, r, _ in RESOLVED], "p string, r string")
    assert [x.u for x in df.select(urls.resolve_ref(F.col("p"), F.col("r")).alias("u")).collect()] == [u for *_, u in RESOLVED]


def test_clean_urls(spark):
    cases = {"/index.html": "/", "": "/", "/a.html": "/a/", "/d/index.html": "/d/index/", "/a.png": "/a.png", "//a.html": "/a/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.c for r in df.select("p", urls.clean_url(F.col("p"), F.lit("#f")).alias("c")).collect()} == {k: v + "#f" for k, v in cases.items()}


def test_hosts_and_sources(spark):
    hosts = {
        "https://A.b:443/x": "a.b",
        "http://a.b:443": "a.b:443",
        "http://u:p@a.b:80/": "a.b",
        "//c.d/e": "c.d",
        "/x": "",
        "mailto:a@b": "",
        "https://a.b?x@y": "a.b",
    }
    df = spark.createDataFrame([(k,) for k in hosts], "u string")
    assert {r.u: r.h for r in df.select("u", urls.url_host(F.col("u")).alias("h")).collect()} == hosts
    queries = {
        "https://h/?utm_source=a%20b+c&utm_source=z": "a b c",
        "https://h/?x=1&utm_source=": "direct",
        "https://h/?xutm_source=1": "direct",
        "https://h/#?utm_source=1": "direct",
        "https://h/?utm_source=%zz": "%zz",
    }
    df = spark.createDataFrame([(k,) for k in queries], "u string")
    assert {r.u: r.s for r in df.select("u", urls.acquisition_source(F.col("u")).alias("s")).collect()} == queries


def test_external_links(spark):
    cases = {
        "https://other.ex/": True,
        "HTTPS://OWN.ex/": False,
        "http://own.ex/": False,
        "http://own.ex:8080/": True,
        "//other.ex": True,
        "//own.ex/x": False,
        "/x": False,
        "x.html": False,
        "mailto:a@other.ex": False,
        "ftp://other.ex": False,
        "": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.e for r in df.select("u", urls.is_external(F.col("u"), F.lit("https://own.ex/p")).alias("e")).collect()}
    assert got == cases


def test_link_rewrite(spark):
    html = (
        '<a href="../x.html#f"><a href="y.html?q=1"><a href="/z.html"><a href="index.html"><img src="../assets/i.png">'
        '<a href="https://own.ex/q.html#z"><a href="https://else.ex/q.html"><a href="//cdn.ex/a.html"><a href="mailto:a@b.html">'
        "<a href=\"#top\"><a href=\"\"><i style=\"url('../../assets/b.png')\"> https://own.ex/r/s.html."
    )
    out = corpus(spark, html).select(links.rewrite_links(F.col("html"), F.col("path"), "own.ex").alias("h")).first().h
    assert out == (
        '<a href="/x/#f"><a href="/d/y/?q=1"><a href="/z/"><a href="/d/index/"><img src="/assets/i.png">'
        '<a href="https://own.ex/q/#z"><a href="https://else.ex/q.html"><a href="//cdn.ex/a.html"><a href="mailto:a@b.html">'
        "<a href=\"#top\"><a href=\"\"><i style=\"url('/assets/b.png')\"> https://own.ex/r/s/."
    )


def test_redirects_leave_root_pages(spark):
    pages = spark.createDataFrame([("index.html",), ("404.html",), ("a/b.html",)], "path string")
    rows = links.redirects(pages, F.col("path"), "https://own.ex").collect()
    assert [(r.old_path, r.new_url, r.canonical) for r in rows] == [("/a/b.html", "/a/b/", "https://own.ex/a/b/")]
    assert 'content="0; url=/a/b/"' in rows[0].stub_html and 'replace("/a/b/");' in rows[0].stub_html


def test_audit(spark):
    pages = corpus(spark, "(\"/assets/a.png?v=1#x\" '/assets/a.png' url(/assets/b.png) /content/c.md", 'x/assets/no.png "/assets/a.png"')
    refs = assets.referenced_paths(pages)
    assert {r.path for r in refs.collect()} == {"/assets/a.png", "/assets/b.png", "/content/c.md"}
    files = spark.createDataFrame([("/assets/a.png", 1), ("/assets/z.png", 512001), ("/content/c.md", 1)], "path string, length bigint")
    assert {r.path for r in assets.missing_assets(refs, files).collect()} == {"/assets/b.png"}
    assert {r.path for r in assets.unused_assets(refs, files).collect()} == {"/assets/z.png"}
    summary = {r.finding: r.n for r in assets.audit_summary(refs, files).collect()}
    assert summary == {"referenced": 3, "on_disk": 2, "missing": 1, "unused": 1, "oversized": 1}


def test_reference_counts_by_brute_force(spark):
    texts = ["/x/big-a.png a.png 'a.png'", "my b.png.png /c.PNG b.png", "d.pngd.png", ""]
    names = ["/assets/a.png", "/assets/big-a.png", "/q/b.png", "/assets/my b.png", "/assets/c.PNG", "/assets/d.png", "/e.png"]
    files = spark.createDataFrame([(n, 600000) for n in names], "path string, length bigint")
    got = {r.path: r.refs for r in assets.reference_counts(files, corpus(spark, *texts)).collect()}
    assert got == {n: sum(t.count(n.split("/")[-1]) for t in texts) for n in names}


def test_size_boundaries(spark):
    files = spark.createDataFrame([("/a.png", 512000, 1), ("/b.png", 512001, 1), ("/c.png", 511999, 1), ("/d.png", 900000, 0)], "path string, length bigint, refs bigint")
    assert {r.path for r in assets.oversized_assets(files).collect()} == {"/b.png", "/d.png"}
    queue = assets.compression_queue(files)
    assert {r.path for r in queue.collect()} == {"/a.png", "/b.png"}
    assert assets.queue_totals(queue).first().saving_pct == 50


def test_unmatched_conversion_fails_when_strict(spark):
    done = spark.createDataFrame([("/out/a.webp", 1), ("/out/z.webp", 1)], "path string, length bigint")
    orig = spark.createDataFrame([("assets/insights/a.png", 9), ("assets/a.png", 4)], "path string, length bigint")
    matched = {r.stem: r.original for r in assets.match_converted(done, orig, ("assets", "assets/insights")).collect()}
    assert matched == {"a": "assets/a.png", "z": None}
    with pytest.raises(Exception, match="no original for /out/z.webp"):
        assets.match_converted(done, orig, ("assets",), strict=True).collect()


def test_image_sizes(spark):
    def riff(kind, rest):
        return b"RIFF\0\0\0\0WEBP" + kind + rest + bytes(16)

    files = [
        b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480),
        riff(b"VP8X", bytes(8) + (1919).to_bytes(3, "little") + (1079).to_bytes(3, "little")),
        riff(b"VP8L", bytes(4) + b"\x2f" + ((799) | (599 << 14) | (1 << 28)).to_bytes(4, "little")),
        riff(b"VP8 ", bytes(10) + struct.pack("<HH", 320 | 0x4000, 200)),
        b"\xff\xd8\xff\xe0" + bytes(40),
        b"",
    ]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "i int, content binary")
    got = [r.s and tuple(r.s) for r in df.select("i", image_size(F.col("content")).alias("s")).orderBy("i").collect()]
    assert got == [(640, 480), (1920, 1080), (800, 600), (320, 200), None, None]


ORG = jsonld.Organization("Example Co", "https://own.ex/", "https://own.ex/l.png")


def test_article_block_fields(spark):
    pages = spark.createDataFrame(
        [("i/a.html", "a", "S", None, None, None, None), ("i/b.html", "b", "S", "H", None, None, "Ann")],
        "path string, slug string, section string, headline string, description string, image string, author string",
    )
    docs = spark.createDataFrame([("a", {"title": "T", "excerpt": "", "deck": "D", "image": "../assets/x.png", "author": "Bo"})], "slug string, meta map<string,string>")
    got = {r.path: json.loads(r.json) for r in jsonld.article_blocks(pages, docs, ORG, "https://own.ex").collect()}
    a, b = got["i/a.html"], got["i/b.html"]
    assert list(a) == ["@context", "@type", "headline", "description", "image", "author", "publisher", "mainEntityOfPage", "articleSection", "inLanguage"]
    assert (a["headline"], a["description"], a["image"], a["author"]["name"]) == ("T", "D", "https://own.ex/assets/x.png", "Bo")
    assert a["author"] == {"@type": "Person", "name": "Bo", "worksFor": {"@type": "Organization", "name": "Example Co", "url": "https://own.ex/"}}
    assert "image" not in b and "description" not in b and b["headline"] == "H"
    assert a["mainEntityOfPage"]["@id"] == "https://own.ex/i/a.html"


def test_blocks_in_and_out(spark):
    pages = corpus(spark, "<head></head>", '<head><script type="application/ld+json">{bad</script></head>')
    html = jsonld.insert_block(F.col("html"), jsonld.item_list("N", F.array(F.lit("a$1"), F.lit("b"))))
    done = pages.select("id", html.alias("html"))
    found = jsonld.json_blocks(done, ["id"]).orderBy("id", "pos").collect()
    assert [(b.id, b.pos, b.type) for b in found] == [(0, 0, "ItemList"), (1, 0, None), (1, 1, "ItemList")]
    assert json.loads(found[0].json)["itemListElement"][0] == {"@type": "ListItem", "position": 1, "name": "a$1"}
    assert jsonld.pages_lacking(done, "ItemList").count() == 0 and jsonld.pages_lacking(done, "FAQPage").count() == 2


def test_faq_upsert_twice_is_once(spark):
    block = jsonld.faq_page(F.array(F.struct(F.lit("Q &amp; A?").alias("q"), F.lit("It&rsquo;s $5").alias("a"))))
    once = corpus(spark, "<head></head>x").select("id", jsonld.upsert_block(F.col("html"), "FAQPage", block).alias("html"))
    twice = once.select("id", jsonld.upsert_block(F.col("html"), "FAQPage", block).alias("html"))
    assert once.first().html == twice.first().html
    entry = json.loads(jsonld.json_blocks(once, ["id"]).first().json)["mainEntity"][0]
    assert (entry["name"], entry["acceptedAnswer"]["text"]) == ("Q & A?", "It’s $5")


def test_path_date_is_the_first_hash_byte(spark):
    paths = [f"x/{i}/index.html" for i in range(20)]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", attribution.path_date(F.col("p")).alias("d"))
    assert {r.p: r.d.day for r in df.collect()} == {p: hashlib.sha256(p.encode()).digest()[0] % 15 + 1 for p in paths}


def test_byline_markup(spark):
    from sitelode.plans.attribution import MARKUP

    row = spark.createDataFrame([("A",)], "a string").select(
        attribution.byline(F.col("a"), F.make_date(F.lit(2026), F.lit(5), F.lit(9)), MARKUP).alias("dated"),
        attribution.byline(F.col("a"), F.lit(None).cast("date"), MARKUP).alias("plain"),
    ).first()
    assert row.plain == '<p class="by-line">By A</p>'
    assert row.dated.endswith('<span class="by-line-date">May 9, 2026</span></p>')


def test_unknown_related_key_fails(spark):
    pages = spark.createDataFrame([(1, ["a", "z"])], "id int, related_keys array<string>")
    catalog = spark.createDataFrame([("a", "A")], "key string, title string")
    with pytest.raises(Exception, match="unknown key: z"):
        attribution.related_items(pages, catalog, "id").collect()
    items = attribution.related_items(pages, catalog, "id", strict=False).first()["items"]
    assert [i.title for i in items] == ["A", None]


def test_block_after_a_named_one(spark):
    def person(name):
        return jsonld.person(ORG, F.lit(name), F.lit("P"), F.lit("d"), F.lit("i"), F.lit("u"), F.array(F.lit("t")))

    html = jsonld.insert_block(jsonld.insert_block(F.lit("<head></head>"), person('A "x"')), person("B"))
    pages = spark.range(1).select("id", html.alias("html"))
    new = pages.select("id", jsonld.insert_block_after(F.col("html"), "Person", 'A "x"', person("C $1")).alias("html"))
    assert [json.loads(b.json)["name"] for b in jsonld.json_blocks(new, ["id"]).orderBy("pos").collect()] == ['A "x"', "C $1", "B"]
    same = pages.select(jsonld.insert_block_after(F.col("html"), "Person", "Z", person("C")).alias("html"))
    assert same.first().html == pages.first().html


def test_edit_of_the_first_match_with_a_page_value(spark):
    rule = rw.EditMatches(
        name="r",
        pattern=r'<button( aria-current="page")?>',
        first=True,
        change=lambda m: F.concat(F.lit("<a"), F.when(F.col("id") == 1, F.lit(" here")).otherwise(F.regexp_extract(m, r"<button([^>]*)>", 1)), F.lit(">")),
    )
    pages = corpus(spark, '<button aria-current="page"><button>', "<button><button>", "none")
    out = rw.rewrite_pages(pages, [rule]).orderBy("id").collect()
    assert [r.html_new for r in out] == ['<a aria-current="page"><button>', "<a here><button>", "none"]
    assert [r.ledger[0].status for r in out] == ["updated", "updated", "no_match"]


def test_prioritised_class(spark):
    html = '<img src="a" class="hero" alt="b"><img class="other"><img class="hero" fetchpriority="low">'
    assert result(spark, html, rw.prioritise_class("hero")) == (
        '<img src="a" class="hero" alt="b" fetchpriority="high" loading="eager"><img class="other"><img class="hero" fetchpriority="low">',
        [("updated", 1)],
    )


def test_a_long_name_is_counted(spark):
    name = "n" * 300 + ".png"
    files = spark.createDataFrame([(f"/assets/{name}", 1)], "path string, length bigint")
    assert assets.reference_counts(files, corpus(spark, f"'/assets/{name}'")).first().refs == 1


def test_one_faq_block_however_many_questions(spark):
    rows = spark.range(1001).select(F.lit("p").alias("path"), F.col("id").alias("pos"), F.lit("q").alias("q"), F.col("id").cast("string").alias("a"))
    (block,) = jsonld.faq_blocks(rows, ["path"], F.col("pos")).collect()
    assert block.json.count('"Question"') == 1001


def test_scripts_and_data_are_not_resolved(spark):
    pages = corpus(spark, '<a href="javascript:void(0)"><img src="data:image/png;base64,AA=="><a href="x.html">')
    found = links.link_table(pages, [], F.lit("/a/b.html"))
    assert [r.resolved for r in found.orderBy("pos").collect()] == [None, None, "/a/x.html"]
