"""Markdown corpus: front matter, metadata, blocks, rendered bodies, article series.

A document is one row, so its lines are handled with array functions inside the row. Nothing about a
single document needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import (
    BROWSER_SPACE,
    bind,
    browser_trim,
    escape_html,
    first_filled,
    inline_bold,
    quote_pattern,
)
from sitelode.operators.ordered import with_neighbours
from sitelode.operators.stages import computed_once

LINE_TEXT = r"[^\n\r\x{2028}\x{2029}]"
SPACE = f"[{BROWSER_SPACE}]"

# Three ways front matter is delimited and its lines are read.
FRONT_MATTER = {
    "tolerant": rf"\A---{SPACE}*\n([\s\S]*?)\n---{SPACE}*\n",
    "strict": r"\A---\n([\s\S]*?)\n---\n",
    "letters": rf"\A---{SPACE}*\n([\s\S]*?)\n---",
}
META_LINE = {
    "tolerant": rf"^([^:]+):{SPACE}*({LINE_TEXT}*){SPACE}*\z",
    "strict": rf"^([^:]+):{SPACE}*({LINE_TEXT}*){SPACE}*\z",
    "letters": rf'^([a-zA-Z]+):{SPACE}*"?({LINE_TEXT}*?)"?\z',
}
QUOTED = rf'^"({LINE_TEXT}*)"{SPACE}*\z'

PRERENDERED = "<!--PRERENDERED-->"
LISTS = ("ul", "ol")


def _meta_map(header: Column, dialect: str) -> Column:
    pattern = META_LINE[dialect]

    def entry(line: Column) -> Column:
        raw = F.regexp_extract(line, pattern, 2)
        if dialect == "letters":
            value = F.regexp_replace(raw, r'^"|"\z', "")
        else:
            value = F.when(F.rlike(raw, F.lit(QUOTED)), F.regexp_extract(raw, QUOTED, 1)).otherwise(raw)
            value = browser_trim(value)
        return F.struct(browser_trim(F.regexp_extract(line, pattern, 1)).alias("key"), value.alias("value"))

    lines = F.filter(F.split(header, "\n"), lambda line: F.rlike(line, F.lit(pattern)))
    # A later key wins; map_from_entries would fail on the repeat.
    def last_of_each(found: Column) -> Column:
        names = F.transform(found, lambda e: e["key"])
        return F.map_from_entries(
            F.transform(F.array_distinct(names), lambda k: F.struct(k, F.get(found, F.array_position(names, k).cast("int") - 1)["value"]))
        )

    # Backwards, the first entry of a key is the one that counts.
    return bind(F.reverse(F.transform(lines, entry)), last_of_each)


def front_matter(docs: DataFrame, text: str = "text", dialect: str = "tolerant") -> DataFrame:
    """Adds ``meta`` and ``body``. Without front matter: an empty map and the whole text."""
    pattern, c = FRONT_MATTER[dialect], F.col(text)
    # Only the head of the document is matched; the body is what follows it.
    head = F.when(
        F.startswith(c, F.lit("---")), bind(F.regexp_extract(c, pattern, 0), lambda h: F.when(h != "", h))
    )
    empty = F.create_map().cast("map<string,string>")

    def parse(head: Column) -> Column:
        body = browser_trim(F.substring(c, F.length(head) + 1, F.length(c)))
        meta = _meta_map(F.regexp_extract(head, pattern, 1), dialect)
        return F.struct(
            F.when(head.isNotNull(), meta).otherwise(empty).alias("meta"),
            F.when(head.isNotNull(), body).otherwise(c).alias("body"),
        )

    parsed = docs.withColumn("_parsed", bind(head, parse))
    return computed_once(
        parsed, {"meta": F.col("_parsed.meta"), "body": F.col("_parsed.body")}
    ).drop("_parsed")


def _meta(key: str) -> Column:
    return F.try_element_at(F.col("meta"), F.lit(key))


def article_metadata(docs: DataFrame, alt: Column | None = None) -> DataFrame:
    """Metadata with fallbacks; an empty value counts as missing."""
    return docs.withColumns(
        {
            "title": first_filled(_meta("title")),
            "eyebrow": first_filled(_meta("eyebrow"), _meta("category")),
            "format": first_filled(_meta("format")),
            "pillar": first_filled(_meta("pillar")),
            "deck": first_filled(_meta("deck"), _meta("excerpt")),
            "description": first_filled(_meta("metaDescription"), _meta("excerpt")),
            "image_alt": first_filled(*([alt] if alt is not None else []), _meta("title")),
        }
    )


def with_image_alt(docs: DataFrame, alts: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``image_alt``: the text that a lookup table (``slug, alt``) has for the document, or else its title."""
    known = alts.select("slug", F.col("alt").alias("_alt"))
    return docs.join(known, "slug", "left").withColumn("image_alt", first_filled(F.col("_alt"), F.col(title))).drop("_alt")


def allowed_documents(docs: DataFrame, slugs: DataFrame) -> DataFrame:
    return docs.join(slugs.select("slug"), "slug", "left_semi")


def unknown_documents(docs: DataFrame, slugs: DataFrame) -> DataFrame:
    return docs.join(slugs.select("slug"), "slug", "left_anti")


def resolve_asset(path: Column, prefix: str = "../") -> Column:
    """Absolute references stay; others lose leading dots and slashes and get the prefix."""
    kept = F.rlike(path, F.lit(r"^((?i:https?://)|mailto:|data:)"))
    relative = F.concat(F.lit(prefix), F.regexp_replace(path, r"^(\.\./|\./|/)+", ""))
    return F.when(path.isNull() | (path == "") | kept, path).otherwise(relative)


def audio_type(audio: Column) -> Column:
    present = F.nullif(audio, F.lit("")).isNotNull()
    return F.when(present, F.when(F.endswith(F.lower(audio), F.lit(".m4a")), "audio/mp4").otherwise("audio/mpeg"))


def cta_href(label: Column, href: Column, default: str) -> Column:
    """A call to action exists only with a label; its link falls back to the default."""
    return F.when(F.nullif(label, F.lit("")).isNotNull(), first_filled(href, F.lit(default)))


# ---- Blocks -------------------------------------------------------------------------------------

ORDERED_ITEM = rf"^[0-9]+\.{SPACE}+({LINE_TEXT}+)\z"


def _line_kinds(body: Column) -> Column:
    """Array of ``(kind, item)``, one per line. ``body`` is referred to several times: bind it, or store it."""

    def parse(line: Column) -> Column:
        def is_a(kind: str, item: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), item.alias("item"))

        def after(n: int) -> Column:
            return F.substring(line, F.lit(n + 1), F.length(line))

        def numbered(item: Column) -> Column:
            return F.when(item != "", is_a("ol", item)).otherwise(is_a("p", line))

        # The first character tells most lines apart; the pattern is tried on numbers only.
        return (
            F.when(F.startswith(line, F.lit("- ")), is_a("ul", after(2)))
            .when(F.left(line, F.lit(1)).between("0", "9"), bind(F.regexp_extract(line, ORDERED_ITEM, 1), numbered))
            .when(F.startswith(line, F.lit("### ")), is_a("h3", after(4)))
            .when(F.startswith(line, F.lit("## ")), is_a("h2", after(3)))
            .when(browser_trim(line) == "", is_a("blank", F.lit("")))
            .otherwise(is_a("p", line))
        )

    # A plain line feed is split on without the pattern engine.
    lines = F.when(F.contains(body, F.lit("\r\n")), F.split(body, r"\r?\n", -1)).otherwise(F.split(body, "\n", -1))
    return F.transform(lines, parse)


def _edges(lines: Column) -> Column:
    """Array of ``(kind, item, opens, closes)``: whether the line opens and closes a block.

    Neighbouring items of one list form one block; every other line is a block of its own.
    ``lines`` is referred to several times: bind it, or store it in a column.
    """
    none = F.array(F.lit(None).cast("struct<kind:string,item:string>"))
    before = F.concat(none, F.slice(lines, F.lit(1), F.size(lines) - 1))
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), none)

    def differs(line: Column, other: Column) -> Column:
        return ~line["kind"].isin(*LISTS) | ~line["kind"].eqNullSafe(other["kind"])

    opened = F.zip_with(lines, before, lambda x, b: F.struct(x.alias("line"), differs(x, b).alias("opens")))
    return F.zip_with(
        opened,
        after,
        lambda o, a: F.struct(
            o["line"]["kind"].alias("kind"),
            o["line"]["item"].alias("item"),
            o["opens"].alias("opens"),
            differs(o["line"], a).alias("closes"),
        ),
    )


def markdown_blocks(docs: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Block table: ``keys, block_id, pos, kind, item`` with ``pos`` the item's place in its block.

    The starts of the blocks are listed in the row and the line array is cut there, so gaps and
    islands need neither a window nor a shuffle.
    """
    starts = F.filter(
        F.transform(
            _edges(F.col("_lines")), lambda e, i: F.when(e["opens"] & (e["kind"] != "blank"), i + 1)
        ),
        lambda i: i.isNotNull(),
    )
    staged = docs.select(*keys, _line_kinds(F.col(body)).alias("_lines")).withColumn("_starts", starts)
    ends = F.concat(
        F.slice(F.col("_starts"), F.lit(2), F.size("_starts")), F.array(F.size("_lines") + 1)
    )
    cut = F.zip_with(
        F.col("_starts"),
        ends,
        lambda start, end: F.filter(
            F.slice(F.col("_lines"), start, end - start), lambda x: x["kind"] != "blank"
        ),
    )
    blocks = staged.select(*keys, F.posexplode(cut).alias("block_id", "_items"))
    return blocks.select(*keys, "block_id", F.posexplode("_items").alias("pos", "_item")).select(
        *keys, "block_id", "pos", F.col("_item.kind").alias("kind"), F.col("_item.item").alias("item")
    )


def render_body(body: Column) -> Column:
    """Rendered HTML of a Markdown body, blocks on lines of their own.

    Escaping and emphasis never change what kind of line a line is and never cross its end, so the
    whole body is escaped once, before it is cut into lines.
    """

    def piece(line: Column) -> Column:
        kind, text = line["kind"], line["item"]
        item = F.concat(
            F.when(line["opens"], F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(""),
            F.lit("<li>"),
            text,
            F.lit("</li>"),
            F.when(line["closes"], F.concat(F.lit("</"), kind, F.lit(">\n"))).otherwise(""),
        )
        block = F.concat(F.lit("<"), kind, F.lit(">"), text, F.lit("</"), kind, F.lit(">\n"))
        return F.when(kind == "blank", "").when(kind.isin(*LISTS), item).otherwise(block)

    def joined(lines: Column) -> Column:
        return F.array_join(F.transform(_edges(lines), piece), "")

    html = bind(inline_bold(body), lambda text: bind(_line_kinds(text), joined))
    return F.rtrim(html, F.lit("\n"))


def quoted_replacement(c: Column) -> Column:
    """A column safe as a regular-expression replacement."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def replace_container(html: Column, inner: Column, tag: str = "main") -> Column:
    """The first ``<tag …>…</tag>`` gets a new inside and keeps its opening tag."""
    pattern = rf"\A((?s:.*?)<{tag}\b[^>]*>)[\s\S]*?(</{tag}>)"
    return F.regexp_replace(html, F.lit(pattern), F.concat(F.lit("$1\n"), quoted_replacement(inner), F.lit("\n$2")))


def _done_before() -> Column:
    return F.coalesce(F.contains("html", F.lit(PRERENDERED)), F.lit(False))


def awaited(docs: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Those of the documents that a page waits for which doesn't carry the marker yet; only these need be read and rendered."""
    return docs.join(pages.where(~_done_before()).select(key), key, "left_semi")


def prerender(pages: DataFrame, rendered: DataFrame, key: str, tag: str = "main", drop_script: str | None = None) -> DataFrame:
    """Put rendered bodies (``key, rendered``) into their pages.

    Adds ``html_new`` and ``status``: pages that carry the marker stay as they are, as do pages
    without a body of their own.
    """
    html = F.col("html")
    inner = F.concat(F.lit(PRERENDERED + "\n"), F.col("rendered"))
    new = replace_container(html, inner, tag)
    if drop_script:
        pattern = rf'\s*<script\s+src="[^"]*{quote_pattern(drop_script)}"[^>]*>\s*</script>'
        new = F.regexp_replace(new, pattern, "")
    status = F.when(F.col("rendered").isNull(), "no_body").otherwise("updated")
    # Pages done before need no body, and their text isn't shuffled to find one.
    before = _done_before()
    met = pages.where(~before).join(rendered.select(key, "rendered"), key, "left").withColumn("status", status)
    text = F.when(F.col("status") == "updated", new).otherwise(html)
    done = computed_once(met, {"html_new": text}).drop("rendered")
    kept = pages.where(before).withColumns({"status": F.lit("already"), "html_new": html})
    return done.unionByName(kept)


def render_article(docs: DataFrame, default_cta: str, asset_prefix: str = "../") -> DataFrame:
    """Adds ``rendered``: audio, content image, body and call to action of an article, in that order."""

    def asset(key: str) -> Column:
        return escape_html(resolve_asset(_meta(key), asset_prefix))

    def when_filled(key: str, *parts: Column) -> Column:
        return F.when(F.nullif(_meta(key), F.lit("")).isNotNull(), F.concat(*parts)).otherwise("")

    audio = when_filled(
        "audio",
        F.lit('<div class="insight-audio"><audio controls><source src="'),
        asset("audio"),
        F.lit('" type="'),
        audio_type(_meta("audio")),
        F.lit('"></audio></div>'),
    )
    image = when_filled(
        "contentImage",
        F.lit('<figure class="insight-content-image"><img src="'),
        asset("contentImage"),
        F.lit('" alt="'),
        escape_html(first_filled(_meta("contentImageAlt"))),
        F.lit('"><figcaption>'),
        escape_html(first_filled(_meta("contentImageCaption"))),
        F.lit("</figcaption></figure>"),
    )
    cta = when_filled(
        "ctaLabel",
        F.lit('<div class="insight-article-cta"><a href="'),
        escape_html(cta_href(_meta("ctaLabel"), _meta("ctaHref"), default_cta)),
        F.lit('" class="btn btn-primary">'),
        escape_html(_meta("ctaLabel")),
        F.lit("</a></div>"),
    )
    return docs.withColumn("rendered", F.concat(audio, image, render_body(F.col("body")), cta))


def facet_counts(docs: DataFrame, facet: str) -> DataFrame:
    """Documents per facet value, with the value's form in a link."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(facet), r"[^a-z0-9]+", "-"), r"^-|-\z", "")
    return docs.groupBy(facet).agg(F.count(F.lit(1)).alias("n")).withColumn("slug", slug)


# ---- Article series -----------------------------------------------------------------------------


def series_navigation(
    parts: DataFrame,
    keys: Sequence[str],
    part: str,
    hub_title: str,
    hub_href: str,
    all_title: str,
    labels: tuple[str, str, str],
    chunk: int = 4096,
) -> DataFrame:
    """Previous and next title and link of every part; both ends lead to the hub.

    ``labels``: of the link to the hub, the previous and the next part. Needs columns ``title`` and ``href``. Also adds ``position`` and the series length.
    """
    hub, before, after = labels
    out = with_neighbours(parts, keys, F.floor(F.col(part) / chunk), [part], ["title", "href"])
    return out.withColumns(
        {
            "prev_label": F.when(F.col("previous").isNull(), hub).otherwise(before),
            "prev_title": F.coalesce(F.col("previous.title"), F.lit(hub_title)),
            "prev_href": F.coalesce(F.col("previous.href"), F.lit(hub_href)),
            "next_label": F.when(F.col("next").isNull(), hub).otherwise(after),
            "next_title": F.coalesce(F.col("next.title"), F.lit(all_title)),
            "next_href": F.coalesce(F.col("next.href"), F.lit(hub_href)),
        }
    ).drop("previous", "next")


def series_cards(navigated: DataFrame) -> DataFrame:
    """The ``Part n of m`` line of each card."""
    line = F.concat(F.lit("Part "), F.col("position"), F.lit(" of "), F.col("group_size"))
    return navigated.withColumn("card", line)


def split_series_body(body: Column, lead: int = 5) -> tuple[Column, Column]:
    """The paragraphs before and after the pull quote."""
    return F.slice(body, 1, lead), F.slice(body, F.lit(lead + 1), F.size(body))


@dataclass(frozen=True)
class Aside:
    """A box beside the text: its opening tag and heading."""

    open_tag: str
    heading: str

    def around(self, inner: Column) -> Column:
        return F.concat(F.lit(f"{self.open_tag}<h2>{self.heading}</h2>"), inner, F.lit("</aside>"))


def render_series_part(body: Column, pull: Column, operator: Column, diagnostic: Column, boxes: tuple[Aside, Aside], lead: int = 5) -> Column:
    """A part's body, then a box with its advice and one with the list of what goes wrong."""
    advice, faults = boxes
    listed = F.array_join(F.transform(diagnostic, lambda d: F.concat(F.lit("<li>"), escape_html(d), F.lit("</li>"))), "")
    return F.concat(
        render_series_body(body, pull, lead),
        advice.around(F.concat(F.lit("<p>"), escape_html(operator), F.lit("</p>"))),
        faults.around(F.concat(F.lit("<ul>"), listed, F.lit("</ul>"))),
    )


def render_series_body(body: Column, pull: Column, lead: int = 5) -> Column:
    def paragraphs(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")

    before, after = split_series_body(body, lead)
    quote = F.concat(F.lit("<blockquote>"), escape_html(pull), F.lit("</blockquote>"))
    return F.concat(paragraphs(before), quote, paragraphs(after))
