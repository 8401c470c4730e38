"""Queries over links, redirects and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators import links
from sitelode.operators.rewrite import double_slash, rewrite_pages, root_background
from sitelode.plans.derived import SITE, SITE_PAGES_SQL, SITE_URL, site_pages, with_sql
from sitelode.plans.registry import Plan, table
from sitelode.sources.corpus import own_page_urls


def link_table(spark: SparkSession, folder: str) -> DataFrame:
    return links.link_table(site_pages(spark, folder), ["page_id"], F.col("path"))


def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    """How often each clean path is linked to, and from how many pages."""
    table_ = links.link_table(site_pages(spark, folder), ["page_id"], F.col("path"))
    return table_.where(F.col("clean").isNotNull()).groupBy("clean").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages")
    )


def migrated_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = site_pages(spark, folder)
    return pages.select("page_id", links.rewrite_links(F.col("html"), F.col("path"), SITE).alias("html"))


def redirects(spark: SparkSession, folder: str) -> DataFrame:
    return links.redirects(site_pages(spark, folder), F.col("path"), SITE_URL)


def kept_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that move, where every third is one of a list of pages that stay."""
    kept = F.concat(F.lit("/kept-"), F.col("page_id") % 4, F.lit(".html"))
    pages = site_pages(spark, folder).select("page_id", F.when(F.col("page_id") % 3 == 0, kept).otherwise(F.col("path")).alias("path"))
    return links.movable_pages(pages, F.col("path"), ["kept-0.html", "kept-1.html", "kept-2.html"])


def sitemap_locs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", links.rewrite_sitemap_loc(F.col("url")).alias("loc"))


def prose(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which every shouted word became a link to a page of the own site."""
    text = F.regexp_replace("text", r"([A-Za-z]+)!!", f"({SITE_URL}/n/$1.html)")
    return table(spark, folder, "documents").select("doc_id", text.alias("text"))


def prose_urls(spark: SparkSession, folder: str) -> DataFrame:
    return own_page_urls(prose(spark, folder), ["doc_id"], SITE)


def migrated_prose(spark: SparkSession, folder: str) -> DataFrame:
    return prose(spark, folder).select("doc_id", links.rewrite_text_urls(F.col("text"), SITE).alias("text"))


def repaired_slashes(spark: SparkSession, folder: str) -> DataFrame:
    html = F.regexp_replace(F.regexp_replace("html", 'href="/([A-M])', 'href="//$1'), 'href="/([n-s])', 'href="//cdn.$1')
    pages = table(spark, folder, "pages").select("page_id", html.alias("html"))
    out = rewrite_pages(pages, [double_slash()])
    return out.select("page_id", "html_new", F.get("ledger", 0)["status"].alias("status"), F.get("ledger", 0)["n_repl"].alias("n_repl"))


def rooted_backgrounds(spark: SparkSession, folder: str) -> DataFrame:
    html = F.replace("html", F.lit("<article>"), F.lit("<article style=\"background: url('assets/a.png'), url('/assets/b.png')\">"))
    pages = table(spark, folder, "pages").select("page_id", html.alias("html"))
    out = rewrite_pages(pages, [root_background()])
    return out.select("page_id", "html_new", F.get("ledger", 0)["n_repl"].alias("n_repl"))


_LINKS = r"""
found AS (SELECT page_id, folder, unnest(l) AS link, CAST(unnest(range(len(l))) AS INTEGER) AS pos FROM (
  SELECT page_id, folder, regexp_extract_all(html, '(?:href|src)="[^"]*"') AS l FROM folders)),
parts AS (SELECT *, regexp_extract(link, '="([^"#?]*)', 1) AS ref, regexp_extract(link, '="[^"#?]*([#?][^"]*)"', 1) AS frag FROM found),
resolved AS (SELECT *,
  CASE WHEN ref LIKE 'http%' THEN NULL WHEN ref LIKE '/%' THEN ref
    WHEN ref LIKE '../%' THEN regexp_replace(folder, '[^/]+/$', '') || substr(ref, 4)
    WHEN ref LIKE './sub/../%' THEN folder || substr(ref, 10)
    ELSE folder || ref END AS resolved FROM parts),
cleaned AS (SELECT *, regexp_replace(resolved, '\.html$', '/') || frag AS clean FROM resolved)
"""

PLANS = {
    "link_table": Plan(
        link_table,
        with_sql(
            SITE_PAGES_SQL,
            _LINKS,
            select="SELECT page_id, pos, split_part(link, '=', 1) AS attr, ref, frag, resolved, clean FROM cleaned",
        ),
    ),
    "link_targets": Plan(
        link_targets,
        with_sql(
            SITE_PAGES_SQL,
            _LINKS,
            select="SELECT clean, count(*) AS links, count(DISTINCT page_id) AS pages FROM cleaned WHERE clean IS NOT NULL GROUP BY 1",
        ),
    ),
    "migrated_pages": Plan(
        migrated_pages,
        with_sql(
            SITE_PAGES_SQL,
            select=r"""SELECT page_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(raw,
                'href="/([A-M][^"]*)"', 'href="' || chr(1) || '\1/#top"', 'g'),
                'href="/([N-Za-f][^"]*)"', 'href="' || chr(2) || '\1/?q=1"', 'g'),
                'href="/([g-m][^"]*)"', 'href="https://site.example/\1/"', 'g'),
                chr(1), regexp_replace(folder, '[^/]+/$', '')),
                chr(2), folder) AS html FROM (
                SELECT page_id, folder, regexp_replace(raw, 'href="/([n-s][^"]*)"', 'href="' || chr(2) || '\1/"', 'g') AS raw FROM folders)""",
        ),
    ),
    "redirects": Plan(
        redirects,
        with_sql(
            SITE_PAGES_SQL,
            "r AS (SELECT path AS old_path, replace(path, '.html', '/') AS new_url FROM site)",
            select="""SELECT old_path, new_url, 'https://site.example' || new_url AS canonical,
              concat_ws(chr(10), '<!DOCTYPE html>', '<html lang="en">', '<head>', '<meta charset="UTF-8" />',
                '<meta name="viewport" content="width=device-width, initial-scale=1.0" />',
                '<meta http-equiv="refresh" content="0; url=' || new_url || '" />',
                '<link rel="canonical" href="https://site.example' || new_url || '" />',
                '<meta name="robots" content="noindex,follow" />', '<title>Redirecting&hellip;</title>',
                '<script>window.location.replace("' || new_url || '");</script>', '</head>', '<body>',
                '<p>This page has moved. <a href="' || new_url || '">Continue to ' || new_url || '</a>.</p>',
                '</body>', '</html>', '') AS stub_html FROM r""",
        ),
    ),
    "movable_pages": Plan(
        kept_pages,
        with_sql(
            SITE_PAGES_SQL,
            select="""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/kept-' || (page_id % 4) || '.html' ELSE path END AS path
              FROM site WHERE NOT (page_id % 3 = 0 AND page_id % 4 < 3)""",
        ),
    ),
    "sitemap_locs": Plan(
        sitemap_locs, r"SELECT page_id, regexp_replace(url, '\.html$', '/') AS loc FROM pages"
    ),
    "prose_urls": Plan(
        prose_urls,
        r"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, 'https://site.example/n/' || unnest(l) || '.html' AS url
            FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)!!', 1) AS l FROM documents)""",
    ),
    "migrated_prose": Plan(
        migrated_prose,
        r"SELECT doc_id, regexp_replace(text, '([A-Za-z]+)!!', '(https://site.example/n/\1/)', 'g') AS text FROM documents",
    ),
    "repaired_slashes": Plan(
        repaired_slashes,
        r"""
        WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, 'href="/([A-M])', 'href="//\1', 'g'),
              'href="/([n-s])', 'href="//cdn.\1', 'g') AS h FROM pages),
        m AS (SELECT page_id, h, regexp_replace(h, '="//([a-zA-Z0-9-]+\.)', '="' || chr(1) || '\1', 'g') AS k FROM b),
        n AS (SELECT *, len(regexp_extract_all(k, '="//')) AS c FROM m)
        SELECT page_id, replace(replace(k, '="//', '="/'), '="' || chr(1), '="//') AS html_new,
          CASE WHEN c = 0 THEN 'no_match' ELSE 'updated' END AS status, CAST(c AS INTEGER) AS n_repl FROM n""",
    ),
    "rooted_backgrounds": Plan(
        rooted_backgrounds,
        """SELECT page_id, replace(html, '<article>',
             '<article style="background: url(''/assets/a.png''), url(''/assets/b.png'')">') AS html_new, 1 AS n_repl FROM pages""",
    ),
}
