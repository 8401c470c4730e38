"""Authors, bylines, publication dates and related items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import fold_title, quote_pattern
from sitelode.operators.content import quoted_replacement
from sitelode.operators.jsonld import date_published
from sitelode.operators.ordered import ordered_items
from sitelode.operators.rewrite import EditMatches
from sitelode.operators.stages import computed_once



# An article's block that has a date, and one up to its author.
DATED_ARTICLE = r'"@type":"Article"[\s\S]*?"datePublished"'
ARTICLE_AUTHOR = r'\A((?s:.*?)"@type":"Article",[\s\S]*?)("author":\{)'


@dataclass(frozen=True)
class Markup:
    """How a site marks its articles. Patterns and markup are the site's own, so the caller gives them."""

    page: tuple[str, ...]  # texts that every article page holds
    title: str  # pattern; group 1 is the title
    anchor: str  # pattern of three groups; the byline goes before the third
    byline: str  # the byline's opening tag
    date: str  # what stands between author and date
    dated: str  # text that shows a byline has a date

    @property
    def plain_byline(self) -> str:
        return quote_pattern(self.byline) + "By ([^<]+)</p>"


def author_of(title: Column, authors: Mapping[str, str], default: str) -> Column:
    """Author by folded title; everyone else's work is the default author's."""
    if not authors:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in authors.items() for x in pair])
    return F.coalesce(F.try_element_at(table, fold_title(title)), F.lit(default))


def with_authors(titled: DataFrame, authors: DataFrame, default: str, title: str = "title") -> DataFrame:
    """``titled`` with ``author`` from a table (``title, author``) of any size, met by folded title; others are the default's.

    Of several authors of one title the least by name counts; rows without a title are the default author's.
    """
    table = authors.where(F.col("author").isNotNull()).groupBy(fold_title(F.col("title")).alias("_folded")).agg(F.min("author").alias("_author"))
    met = titled.withColumn("_folded", fold_title(F.col(title))).join(table.where("_folded IS NOT NULL"), "_folded", "left")
    return met.withColumn("author", F.coalesce("_author", F.lit(default))).drop("_folded", "_author")


def byline(author: Column, date: Column, markup: Markup) -> Column:
    """Byline markup, with the date where there is one."""
    dated = F.concat(F.lit(markup.date), F.date_format(date, "MMMM d, yyyy"), F.lit("</span>"))
    return F.concat(F.lit(f"{markup.byline}By "), author, F.coalesce(dated, F.lit("")), F.lit("</p>"))


def path_date(path: Column, year: int = 2026, month: int = 5, days: int = 15) -> Column:
    """A stable date scattered over the first days of a month, from the hash of the path."""
    first_byte = F.conv(F.substring(F.sha2(path, 256), 1, 2), 16, 10).cast("int")
    return F.make_date(F.lit(year), F.lit(month), first_byte % days + 1)


def article_pages(pages: DataFrame, markup: Markup, html: str = "html") -> DataFrame:
    held = [F.contains(html, F.lit(mark)) for mark in markup.page]
    return pages.where(reduce(and_, held)) if held else pages


def article_titles(pages: DataFrame, markup: Markup, html: str = "html") -> DataFrame:
    """Article pages with title (null if it cannot be read) and published date."""
    return article_pages(pages, markup, html).withColumns(
        {
            "title": F.nullif(F.regexp_extract(html, markup.title, 1), F.lit("")),
            "published": date_published(F.col(html)),
        }
    )


def add_bylines(pages: DataFrame, authors: Mapping[str, str], default: str, markup: Markup, html: str = "html") -> DataFrame:
    """Article pages with ``html_new`` and ``status``."""
    titled = article_titles(pages, markup, html)
    author = author_of(F.col("title"), authors, default)
    text = F.col(html)
    line = quoted_replacement(byline(author, F.col("published"), markup))
    new = F.regexp_replace(text, F.lit(rf"\A((?s:.*?)){markup.anchor}"), F.concat(F.lit("$1$2\n      "), line, F.lit("\n$3$4")))
    status = (
        F.when(F.contains(text, F.lit(markup.byline)), "already")
        .when(F.col("title").isNull() | ~F.rlike(text, F.lit(markup.anchor)), "no_match")
        .otherwise("updated")
    )
    marked = titled.withColumn("status", status).withColumn("author", author)
    return computed_once(marked, {"html_new": F.when(F.col("status") == "updated", new).otherwise(text)})


def card_bylines(authors: Mapping[str, str], default: str, card: str, open_tag: str, hint: str) -> EditMatches:
    """Rule that puts an author line between the title of each card and its description.

    ``card``: pattern of the card's head (group 1) with its title (group 2), and what follows it (group 3); a card that
    has an author line already doesn't match. ``open_tag`` begins the line, and every card holds ``hint``.
    """

    def change(match: Column) -> Column:
        author = author_of(F.regexp_extract(match, card, 2), authors, default)
        space = F.lit("\n          ")
        return F.concat(
            F.regexp_extract(match, card, 1), space, F.lit(f"{open_tag}By "), author, F.lit("</p>"), space, F.regexp_extract(match, card, 3)
        )

    return EditMatches(name="card_bylines", pattern=card, change=change, hint=hint)


def backfill_dates(pages: DataFrame, path: str, markup: Markup, legacy: Sequence[str] = (), html: str = "html") -> DataFrame:
    """Date the article pages whose byline has none: ``html_new``, ``status`` and the date used."""
    text, date = F.col(html), path_date(F.col(path))
    iso = F.date_format(date, "yyyy-MM-dd")
    dates = F.concat(F.lit('$1"datePublished":"'), iso, F.lit('","dateModified":"'), iso, F.lit('",$2'))
    with_dates = F.regexp_replace(text, F.lit(ARTICLE_AUTHOR), dates)
    step = F.when(F.rlike(text, F.lit(DATED_ARTICLE)), text).otherwise(with_dates)
    who = F.regexp_extract(text, markup.plain_byline, 1)
    line = quoted_replacement(byline(F.trim(who), date, markup))
    stamped = F.regexp_replace(step, F.lit(rf"\A((?s:.*?)){markup.plain_byline}"), F.concat(F.lit("$1"), line))
    status = (
        F.when(F.col(path).isin(*legacy) if legacy else F.lit(False), "ignored")
        .when(F.contains(text, F.lit(markup.dated)), "already")
        .when(who == "", "no_match")
        .otherwise("updated")
    )
    marked = article_pages(pages, markup, html).where(F.contains(html, F.lit(markup.byline))).withColumn("status", status)
    done = F.col("status") == "updated"
    return computed_once(marked, {"assigned": F.when(done, date), "html_new": F.when(done, stamped).otherwise(text)})


def author_counts(bylines: DataFrame) -> DataFrame:
    return bylines.groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def related_items(pages: DataFrame, catalog: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Ordered related items per page, from an array of catalog keys: ``key, items``.

    An item that half of all pages point to is a skewed key, which adaptive execution splits. An unknown key fails
    the job, or gives a null item when ``strict`` is off.
    """
    wanted = pages.select(key, F.posexplode("related_keys").alias("pos", "item_key"))
    fields = [c for c in catalog.columns if c != "key"]
    found = wanted.join(catalog.withColumnRenamed("key", "item_key").withColumn("_known", F.lit(True)), "item_key", "left")
    item = F.struct("item_key", *fields)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown key: "), F.col("item_key"))).cast("boolean")
        found = found.withColumn("_known", F.coalesce(F.col("_known"), unknown)).where("_known")
    return ordered_items(found, [key], F.col("pos"), item)
