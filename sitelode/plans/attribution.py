"""Queries over authors, bylines, dates and related items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.text import fold_title
from sitelode.operators import attribution
from sitelode.operators.rewrite import rewrite_pages
from sitelode.plans.registry import Plan, table

AUTHORS = {"Field src3's \"notes\"": "Ann Author", "Field src7's \"notes\"": "Ann Author", "Field src9's \"notes\"": "Bo Writer"}
DEFAULT_AUTHOR = "Cy Default"
MARKUP = attribution.Markup(
    page=('class="lead-image"', 'class="story"'),
    title="<h1[^>]*data-story-title[^>]*>([^<]+)</h1>",
    anchor=r'(</figure>)(\s*)(<article class="story"[^>]*>)',
    byline='<p class="by-line">',
    date='<span class="by-line-sep">, </span><span class="by-line-date">',
    dated="by-line-date",
)
CARD = r'(<h3 class="card-head">([^<]+)</h3>)\s*(<p class="card-text">)'


def titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit(" Field "), "source", F.lit("&rsquo;s &#8220;notes” "), F.when(F.col("lang") == "es", "&#8212;&amp;").otherwise("")).alias("title")
    )


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).select("doc_id", fold_title(F.col("title")).alias("title"))


def authored(spark: SparkSession, folder: str) -> DataFrame:
    author = attribution.author_of(F.col("title"), AUTHORS, DEFAULT_AUTHOR)
    return titles(spark, folder).select("doc_id", author.alias("author"))


def authored_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """Authors from a table of titles: every other customer wrote the notes of one source, some of them together."""
    customers = table(spark, folder, "customer").where("c_custkey % 2 = 0")
    title = F.concat(F.lit("Field src"), F.col("c_custkey") % 40, F.lit("&rsquo;s “notes” "))
    authors = customers.select(title.alias("title"), F.when(F.col("c_custkey") % 6 > 0, F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 7)).alias("author"))
    return attribution.with_authors(titles(spark, folder), authors, DEFAULT_AUTHOR).select("doc_id", "author")


def author_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.author_counts(authored(spark, folder))


def path_dates(spark: SparkSession, folder: str) -> DataFrame:
    date = attribution.path_date(F.col("url"))
    return table(spark, folder, "pages").select("page_id", F.date_format(date, "yyyy-MM-dd").alias("date"))


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in the markup of articles: most with a title to read, some dated, some with a byline."""
    n = F.col("page_id")
    html = F.when(n % 11 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<h1>[^<]*", '<h1 data-story-title>Field $0'))
    html = F.regexp_replace(html, "Field <h1>[^<]*", F.concat(F.lit("Field src"), n % 10, F.lit("&rsquo;s &quot;notes&#8221;")))
    html = F.replace(
        html, F.lit("<article>"), F.lit('<figure class="lead-image"></figure>\n  <article class="story" data-x>')
    )
    dated = F.replace(html, F.lit("</head>"), F.concat(F.lit('<!-- "datePublished":"2026-01-'), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit('" --></head>')))
    html = F.when(n % 3 == 0, dated).otherwise(html)
    html = F.when(n % 7 == 0, F.replace(html, F.lit("</figure>"), F.lit('</figure><p class="by-line">By Z</p>'))).otherwise(html)
    return table(spark, folder, "pages").select("page_id", html.alias("html"))


def bylines(spark: SparkSession, folder: str) -> DataFrame:
    authors = {'Field src3\'s &quot;notes"': "Ann Author"}
    out = attribution.add_bylines(article_pages(spark, folder), authors, DEFAULT_AUTHOR, MARKUP)
    return out.select("page_id", "status", "author", "html_new")


CARD_HEAD = '<h3 class="card-head">'


def carded(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose navigation entries are cards; every fourth page has its author lines already."""
    done = F.when(F.col("page_id") % 4 == 0, '<p class="card-by">By X</p>').otherwise("")
    card = F.concat(F.lit(f"<li>{CARD_HEAD}$1</h3>"), done, F.lit('  <p class="card-text"><a href="/$1">'))
    html = F.regexp_replace("html", F.lit(r'<li><a href="/([^"]*)">'), card)
    pages = table(spark, folder, "pages").select("page_id", html.alias("html"))
    rule = attribution.card_bylines({"the": "Ann Author", "und": "Bo Writer"}, DEFAULT_AUTHOR, CARD, '<p class="card-by">', "<h3 ")
    out = rewrite_pages(pages, [rule])
    entry = F.get("ledger", 0)
    return out.select("page_id", "html_new", entry["status"].alias("status"), entry["n_repl"].alias("n_repl"))


def undated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Article pages with a byline; some dated already, one in ten of a legacy path."""
    n = F.col("page_id")
    block = F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"x","author":{"@type":"Person"}}</script></head>')
    byline = F.when(n % 3 == 0, '<p class="by-line">By A<span class="by-line-date">d</span></p>').otherwise(
        '<p class="by-line">By Ann $1 </p>'
    )
    head = F.concat(F.lit('<figure class="lead-image"></figure>'), byline, F.lit('<article class="story">'))
    html = F.replace(F.replace("html", F.lit("</head>"), block), F.lit("<article>"), head)
    path = F.when(n % 10 == 0, "legacy/index.html").otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", path.alias("path"), html.alias("html"))


def backfilled(spark: SparkSession, folder: str) -> DataFrame:
    out = attribution.backfill_dates(undated_pages(spark, folder), "path", MARKUP, legacy=["legacy/index.html"])
    return out.select("page_id", "status", F.date_format("assigned", "yyyy-MM-dd").alias("assigned"), "html_new")


def backfill_ledger(spark: SparkSession, folder: str) -> DataFrame:
    out = attribution.backfill_dates(undated_pages(spark, folder), "path", MARKUP, legacy=["legacy/index.html"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def related(spark: SparkSession, folder: str) -> DataFrame:
    """The links of each page, looked up in a catalog of all link names."""
    names = F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)">'), F.lit(1))
    corpus = table(spark, folder, "pages").select("page_id", names.alias("names"))
    catalog = corpus.select(F.explode("names").alias("key")).distinct().select(
        "key", F.concat(F.lit("/"), "key").alias("href"), F.concat("key", F.lit("!")).alias("title")
    )
    pages = corpus.select("page_id", F.col("names").alias("related_keys"))
    rail = attribution.related_items(pages, catalog, "page_id")
    return rail.select(
        "page_id",
        F.array_join(F.transform("items", lambda c: F.concat(c["href"], F.lit("|"), c["title"])), ";").alias("rail"),
    )


_BYLINE = """'<p class="by-line">By ' || {0} || '<span class="by-line-sep">, </span><span class="by-line-date">' || {1} || '</span></p>'"""
_DAY = "(('0x' || substr(sha256({0}), 1, 2))::INT % 15 + 1)"
_TITLES = r"""
t AS (SELECT doc_id, lang, source, trim(' Field ' || source || '''s "notes" ' || CASE WHEN lang = 'es' THEN '—&' ELSE '' END) AS title FROM documents),
a AS (SELECT doc_id, CASE WHEN title IN ('Field src3''s "notes"', 'Field src7''s "notes"') THEN 'Ann Author'
  WHEN title = 'Field src9''s "notes"' THEN 'Bo Writer' ELSE 'Cy Default' END AS author FROM t)
"""
_UNDATED = f"""
u AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'legacy/index.html' ELSE url END AS path, html,
  CASE WHEN page_id % 10 = 0 THEN 'ignored' WHEN page_id % 3 = 0 THEN 'already' ELSE 'updated' END AS status FROM pages),
d AS (SELECT *, CASE WHEN status = 'updated' THEN {_DAY.format('path')} END AS day FROM u)
"""

PLANS = {
    "folded_titles": Plan(folded, f"WITH {_TITLES} SELECT doc_id, title FROM t"),
    "document_authors": Plan(authored, f"WITH {_TITLES} SELECT doc_id, author FROM a"),
    "authors_by_table": Plan(
        authored_by_table,
        f"""WITH {_TITLES}, b AS (SELECT 'Field src' || (c_custkey % 40) || chr(39) || 's "notes"' AS title, min(c_mktsegment || ' ' || (c_custkey % 7)) AS who
             FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 6 > 0 GROUP BY 1)
           SELECT doc_id, coalesce(who, 'Cy Default') AS author FROM t LEFT JOIN b USING (title)""",
    ),
    "author_counts": Plan(author_counts, f"WITH {_TITLES} SELECT author, count(*) AS n FROM a GROUP BY 1"),
    "path_dates": Plan(
        path_dates, f"SELECT page_id, '2026-05-' || lpad(CAST({_DAY.format('url')} AS VARCHAR), 2, '0') AS date FROM pages"
    ),
    "page_bylines": Plan(
        bylines,
        f"""
        WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN html ELSE regexp_replace(html, '<h1>[^<]*',
              '<h1 data-story-title>Field src' || (page_id % 10) || '&rsquo;s &quot;notes&#8221;') END AS html FROM pages),
        q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '</head>', '<!-- "datePublished":"2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '" --></head>') ELSE html END AS html,
          CASE WHEN page_id % 10 = 3 AND page_id % 11 <> 0 THEN 'Ann Author' ELSE 'Cy Default' END AS who,
          CASE WHEN page_id % 7 = 0 THEN 'already' WHEN page_id % 11 = 0 THEN 'no_match' ELSE 'updated' END AS status FROM p)
        SELECT page_id, status, CASE WHEN page_id % 11 = 0 THEN 'Cy Default' ELSE who END AS author,
          replace(html, '<article>', '<figure class="lead-image"></figure>' || CASE status WHEN 'already' THEN '<p class="by-line">By Z</p>'
            WHEN 'updated' THEN chr(10) || '      ' || CASE WHEN page_id % 3 = 0 THEN {_BYLINE.format('who', "'January ' || (page_id % 28 + 1) || ', 2026'")}
              ELSE '<p class="by-line">By ' || who || '</p>' END || chr(10) ELSE '' END
            || chr(10) || '  <article class="story" data-x>') AS html_new
        FROM q""",
    ),
    "card_bylines": Plan(
        carded,
        f"""
        WITH c AS (SELECT page_id, page_id % 4 = 0 AS done, html, CAST(len(regexp_extract_all(html, '<li><a href="/[^"]+">')) AS INTEGER) AS n FROM pages),
        k AS (SELECT *, regexp_replace(html, '<li><a href="/([^"]*)">', '<li>{CARD_HEAD}\\1</h3>' || CASE WHEN done THEN '<p class="card-by">By X</p>  '
            ELSE chr(10) || '          <p class="card-by">By <' || '\\1>' || '</p>' || chr(10) || '          ' END
            || '<p class="card-text"><a href="/\\1">', 'g') AS h FROM c)
        SELECT page_id, regexp_replace(replace(replace(h, 'By <the>', 'By Ann Author'), 'By <und>', 'By Bo Writer'), 'By <[^>]*>', 'By Cy Default', 'g') AS html_new,
          CASE WHEN done OR n = 0 THEN 'no_match' ELSE 'updated' END AS status, CASE WHEN done THEN 0 ELSE n END AS n_repl FROM k""",
    ),
    "backfilled_dates": Plan(
        backfilled,
        f"""
        WITH {_UNDATED}
        SELECT page_id, status, '2026-05-' || lpad(CAST(day AS VARCHAR), 2, '0') AS assigned,
          replace(replace(html, '</head>', '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Article","headline":"x",'
            || CASE WHEN status = 'updated' THEN '"datePublished":"2026-05-' || lpad(CAST(day AS VARCHAR), 2, '0') || '","dateModified":"2026-05-' || lpad(CAST(day AS VARCHAR), 2, '0') || '",' ELSE '' END
            || '"author":{{"@type":"Person"}}}}</script></head>'),
            '<article>', '<figure class="lead-image"></figure>' || CASE
              WHEN status = 'updated' THEN {_BYLINE.format("'Ann $1'", "'May ' || day || ', 2026'")}
              WHEN page_id % 3 = 0 THEN '<p class="by-line">By A<span class="by-line-date">d</span></p>'
              ELSE '<p class="by-line">By Ann $1 </p>' END || '<article class="story">') AS html_new
        FROM d""",
    ),
    "backfill_ledger": Plan(backfill_ledger, f"WITH {_UNDATED} SELECT status, count(*) AS pages FROM d GROUP BY 1"),
    "related_items": Plan(
        related,
        r"""
        SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1),
          lambda k: '/' || k || '|' || k || '!'), ';') AS rail FROM pages WHERE html LIKE '%<li><a href="/%'""",
    ),
}
