"""Links of a page corpus, migration to clean folder URLs, redirects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import bind, js_json, quote_pattern, replace_segments
from sitelode.functions.urls import FOREIGN, clean_url, resolve_ref

LINK = r'(href|src)="([^"#?]*)([#?][^"]*)?"'
RELATIVE_LINK = r'(href|src)="([^"#?:][^"#?]*)([#?][^"]*)?"'

# Pages that keep their place in a migration.
ROOT_PAGES = ("index.html", "404.html")

# Fixed format: the page left behind at an old address.
REDIRECT_STUB = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="UTF-8" />
<meta name="viewport" content="width=device-width, initial-scale=1.0" />
<meta http-equiv="refresh" content="0; url={target}" />
<link rel="canonical" href="{canonical}" />
<meta name="robots" content="noindex,follow" />
<title>Redirecting&hellip;</title>
<script>window.location.replace({target_json});</script>
</head>
<body>
<p>This page has moved. <a href="{target}">Continue to {target}</a>.</p>
</body>
</html>
"""


def link_table(pages: DataFrame, keys: Sequence[str], page_path: Column, html: str = "html") -> DataFrame:
    """One row per ``href`` or ``src``: position, reference, fragment or query, resolved and clean path.

    The page text is scanned once; the parts are taken from the short matches.
    """
    links = pages.select(
        *keys,
        page_path.alias("_path"),
        F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0))).alias("pos", "_link"),
    )
    parts = links.select(
        *keys,
        "_path",
        "pos",
        F.regexp_extract("_link", LINK, 1).alias("attr"),
        F.regexp_extract("_link", LINK, 2).alias("ref"),
        F.regexp_extract("_link", LINK, 3).alias("frag"),
    )
    ref = F.col("ref")
    resolved = (
        F.when((ref == "") | F.startswith(ref, F.lit("//")), F.lit(None).cast("string"))
        .when(F.startswith(ref, F.lit("/")), ref)
        .otherwise(resolve_ref(F.col("_path"), ref))
    )
    return (
        parts.withColumn("resolved", resolved)
        .withColumn("clean", F.when(F.col("resolved").isNotNull(), clean_url(F.col("resolved"), F.col("frag"))))
        .drop("_path")
    )


def _rewrite_link(match: Column, page_path: Column) -> Column:
    def rewritten(link: Column) -> Column:
        ref, frag = link["ref"], link["frag"]
        is_page = F.endswith(ref, F.lit(".html")) & ~F.contains(ref, F.lit(":"))
        rooted = F.startswith(ref, F.lit("/"))
        special = F.contains(ref, F.lit(":")) & F.rlike(ref, F.lit(rf"^({FOREIGN})"))
        target = (
            F.when(F.startswith(ref, F.lit("//")) | special, F.lit(None).cast("string"))
            .when(is_page & rooted, clean_url(ref, frag))
            .when(is_page, bind(resolve_ref(page_path, ref), lambda path: clean_url(path, frag)))
            .when(~rooted, F.concat(resolve_ref(page_path, ref), frag))
        )
        return F.coalesce(F.concat(link["attr"], F.lit('="'), target, F.lit('"')), match)

    return bind(_parts(match, RELATIVE_LINK), rewritten)


def _parts(match: Column, pattern: str) -> Column:
    """``struct<attr, ref, frag>`` of one link."""
    attr, ref, frag = (F.regexp_extract(match, pattern, i) for i in (1, 2, 3))
    return F.struct(attr.alias("attr"), ref.alias("ref"), frag.alias("frag"))


def clean_own_urls(text: Column, site_origin: str, stop: str = r"\s\"'<>?#", with_suffix: bool = True) -> Column:
    """Every absolute ``.html`` URL of the own site in clean form. ``site_origin`` has no scheme."""
    suffix = r"(#[^\s\"'<>]*|\?[^\s\"'<>]*)?" if with_suffix else "()"
    pattern = rf"(https?://{quote_pattern(site_origin)})(/[^{stop}]+?\.html){suffix}"

    def edit(match: Column) -> Column:
        origin, path, tail = (F.regexp_extract(match, pattern, i) for i in (1, 2, 3))
        return F.concat(origin, bind(path, lambda p: clean_url(p, tail)))

    return replace_segments(text, pattern, edit, hint=site_origin)


def rewrite_links(html: Column, page_path: Column, site_origin: str) -> Column:
    """All links of a page root-anchored and in clean form. Row-local: the page text is not shuffled."""
    html = replace_segments(html, RELATIVE_LINK, lambda m: _rewrite_link(m, page_path))
    return bind(
        clean_own_urls(html, site_origin),
        lambda h: F.when(
            F.contains(h, F.lit("../assets/")), F.regexp_replace(h, r"(\.\./)+assets/", "/assets/")
        ).otherwise(h),
    )


def rewrite_text_urls(text: Column, site_origin: str) -> Column:
    """Own-site URLs in prose, which may end at a closing bracket."""
    return clean_own_urls(text, site_origin, stop=r"\s)", with_suffix=False)


def rewrite_sitemap_loc(loc: Column) -> Column:
    pattern = r"^(https?://[^</]+)(/[^<]+?\.html)\z"
    path = F.regexp_extract(loc, pattern, 2)
    return F.when(path == "", loc).otherwise(
        F.concat(F.regexp_extract(loc, pattern, 1), clean_url(path, F.lit("")))
    )


def movable_pages(pages: DataFrame, page_path: Column, keep: Sequence[str] = ROOT_PAGES) -> DataFrame:
    return pages.where(~F.regexp_replace(page_path, r"^/+", "").isin(*keep))


def redirects(pages: DataFrame, page_path: Column, site_url: str, keep: Sequence[str] = ROOT_PAGES) -> DataFrame:
    """Old path, clean URL, canonical URL and the stub document for each page that moves."""
    old = F.regexp_replace(page_path, r"^/+", "")
    moved = movable_pages(pages, page_path, keep).where(F.endswith(page_path, F.lit(".html")))
    table = moved.select(
        F.concat(F.lit("/"), old).alias("old_path"),
        F.concat(F.lit("/"), F.regexp_replace(old, r"\.html\z", ""), F.lit("/")).alias("new_url"),
    ).withColumn("canonical", F.concat(F.lit(site_url), F.col("new_url")))
    values = {"target": F.col("new_url"), "canonical": F.col("canonical"), "target_json": js_json(F.col("new_url"))}
    stub = F.lit(REDIRECT_STUB)
    for name, value in values.items():
        stub = F.replace(stub, F.lit("{" + name + "}"), value)
    return table.withColumn("stub_html", stub)
