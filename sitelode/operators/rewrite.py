"""Rule-driven rewriting of a page corpus.

``rewrite_pages`` folds an ordered list of rules into column expressions: one narrow stage, no
shuffle, however many rules. Each page carries a ledger with one status per rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitelode.functions.text import (
    as_col,
    at_first,
    at_last,
    bind,
    count_literal,
    counted_segments,
    quote_pattern,
    quote_replacement,
    replace_first,
    replace_outside,
    replace_segments,
)
from sitelode.operators.stages import computed_once

UPDATED, ALREADY, NO_MATCH, UNCHANGED, OUT_OF_SCOPE = "updated", "already", "no_match", "unchanged", "out_of_scope"


@dataclass(frozen=True)
class Edit:
    """What a rule does to a page: the new text and how many replacements make it.

    ``found`` is a cheap test made first. A page passes unmatched if it fails, or if the count is 0.
    """

    html: Column
    found: Column
    count: Column


@dataclass(frozen=True, kw_only=True)
class Rule:
    """``guard``: text whose presence means the rule was applied before. ``scope``: pages it is for."""

    name: str
    guard: str | None = None
    scope: Column | None = None

    def edit(self, html: Column) -> Edit:
        raise NotImplementedError

    def both(self, html: Column) -> Column | None:
        """``struct<html, count>`` from one pass, where a rule has such a form."""
        return None

    def step(self, html: Column) -> Column:
        """``struct<html, status, n_repl>``; the tests run cheap to dear, and stop at the first hit."""
        edit = self.edit(html)
        both = self.both(html)

        def result(text: Column, status: Column | str, count: Column) -> Column:
            return F.struct(text.alias("html"), as_col(status).alias("status"), count.cast("int").alias("n_repl"))

        none = F.lit(0)
        unmatched = result(html, NO_MATCH, none)

        def applied(n: Column, html_new: Column) -> Column:
            changed = bind(
                html_new,
                lambda new: F.when(new.eqNullSafe(html), result(html, UNCHANGED, none)).otherwise(
                    result(new, UPDATED, n)
                ),
            )
            return F.when(n == 0, unmatched).otherwise(changed)

        worked = bind(edit.count, lambda n: applied(n, edit.html)) if both is None else bind(both, lambda b: applied(b["count"], b["html"]))
        out = F.when(~F.coalesce(edit.found, F.lit(False)), unmatched).otherwise(worked)
        if self.guard is not None:
            out = F.when(F.contains(html, F.lit(self.guard)), result(html, ALREADY, none)).otherwise(out)
        if self.scope is not None:
            out = F.when(~F.coalesce(self.scope, F.lit(False)), result(html, OUT_OF_SCOPE, none)).otherwise(out)
        return out


@dataclass(frozen=True, kw_only=True)
class ReplaceText(Rule):
    """Literal replacement of all occurrences, or of the first only. ``strict`` fails if there is none."""

    old: str
    new: Column | str
    first: bool = False
    strict: bool = False

    def edit(self, html: Column) -> Edit:
        found = F.contains(html, F.lit(self.old))
        if self.first:
            new, count = replace_first(html, self.old, self.new), F.lit(1)
        else:
            new, count = F.replace(html, F.lit(self.old), as_col(self.new)), count_literal(html, self.old)
        if self.strict:
            found = F.when(found, F.lit(True)).otherwise(
                F.raise_error(F.lit(f"{self.name}: text to replace not found")).cast("boolean")
            )
        return Edit(new, found, count)


def _first_match(pattern: str, replacement: str) -> tuple[str, str]:
    """Pattern and replacement that act on the first match only; group numbers move up by one."""
    shifted = re.sub(r"(?<!\\)\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)
    return rf"\A((?s:.*?))(?:{pattern})", "$1" + shifted


@dataclass(frozen=True, kw_only=True)
class ReplacePattern(Rule):
    """Regular-expression replacement. ``hint``: literal that must occur, tested before the pattern.

    ``outside``: pattern of regions left alone. Only what lies outside them is counted.
    """

    pattern: str
    replacement: str
    hint: str | None = None
    first: bool = False
    outside: str | None = None

    def edit(self, html: Column) -> Edit:
        hinted = F.contains(html, F.lit(self.hint)) if self.hint else F.lit(True)
        if self.first:
            new = F.regexp_replace(html, *_first_match(self.pattern, self.replacement))
            return Edit(new, hinted & F.rlike(html, F.lit(self.pattern)), F.lit(1))
        if self.outside:
            new = replace_outside(html, self.outside, lambda part: F.regexp_replace(part, self.pattern, self.replacement))
            # Counted before the replacement is made: that may itself match the pattern.
            count = F.aggregate(
                F.split(html, self.outside, -1),
                F.lit(0),
                lambda n, part: n + F.regexp_count(part, F.lit(self.pattern)),
            )
        else:
            new = F.regexp_replace(html, self.pattern, self.replacement)
            count = F.regexp_count(html, F.lit(self.pattern))
        return Edit(new, hinted, count)


@dataclass(frozen=True, kw_only=True)
class Insert(Rule):
    """Insert text at the first of several anchors that occurs. An anchor may stand for its last
    occurrence (``last``)."""

    text: Column | str
    anchors: Sequence[str]
    last: frozenset[str] = field(default_factory=frozenset)
    after: bool = False

    def edit(self, html: Column) -> Edit:
        text, new, found = as_col(self.text), None, F.lit(False)
        for anchor in self.anchors:
            middle = (F.lit(anchor), text) if self.after else (text, F.lit(anchor))
            put = (at_last if anchor in self.last else at_first)(
                html, anchor, lambda before, after, middle=middle: F.concat(before, *middle, after)
            )
            here = F.contains(html, F.lit(anchor))
            found = found | here
            new = F.when(here, put) if new is None else new.when(here, put)
        return Edit(new.otherwise(html), found, F.lit(1))


@dataclass(frozen=True, kw_only=True)
class AllOf(Rule):
    """Several edits that are made together or not at all."""

    parts: Sequence[Rule]

    def edit(self, html: Column) -> Edit:
        def pack(text: Column, found: Column, count: Column) -> Column:
            return F.struct(text.alias("html"), found.alias("found"), count.cast("int").alias("count"))

        def then(part: Rule) -> Callable[[Column], Column]:
            def use(so_far: Column) -> Column:
                step = part.edit(so_far["html"])
                found = so_far["found"] & step.found & (step.count > 0)
                return pack(step.html, found, so_far["count"] + step.count)

            return use

        state = pack(html, F.lit(True), F.lit(0))
        for part in self.parts:
            state = bind(state, then(part))
        return Edit(state["html"], state["found"], state["count"])


@dataclass(frozen=True, kw_only=True)
class ReplaceByKey(Rule):
    """Replace each match by a value looked up under a captured key; unknown keys stay as they are.

    ``values``: a small mapping, or a map column of the page (see ``with_values``).
    """

    pattern: str
    key_group: int
    values: Mapping[str, str] | Column
    build: Callable[[Column, Column], Column]

    def both(self, html: Column) -> Column:
        given = self.values
        table = given if isinstance(given, Column) else F.create_map(*[F.lit(x) for pair in given.items() for x in pair])

        def value(match: Column) -> Column:
            return F.try_element_at(table, F.regexp_extract(match, self.pattern, self.key_group))

        return counted_segments(html, self.pattern, lambda m: bind(value(m), lambda v: F.when(v.isNotNull(), self.build(m, v))))

    def edit(self, html: Column) -> Edit:
        both = self.both(html)
        return Edit(both["html"], F.lit(True), both["count"])


@dataclass(frozen=True, kw_only=True)
class EditMatches(Rule):
    """Replace each match, or only the first, by an expression of it and of the page's other columns.

    Only matches that change are counted.
    """

    pattern: str
    change: Callable[[Column], Column]
    hint: str | None = None
    first: bool = False

    def edit(self, html: Column) -> Edit:
        hinted = F.contains(html, F.lit(self.hint)) if self.hint else F.lit(True)
        if self.first:
            match = F.nullif(F.regexp_extract(html, self.pattern, 0), F.lit(""))
            new = bind(
                F.split(html, self.pattern, 2),
                lambda parts: F.concat(F.get(parts, F.lit(0)), self.change(match), F.get(parts, F.lit(1))),
            )
            return Edit(new, hinted & match.isNotNull(), F.lit(1))
        both = self.both(html)
        return Edit(both["html"], hinted, both["count"])

    def both(self, html: Column) -> Column | None:
        if self.first:
            return None
        return counted_segments(html, self.pattern, lambda m: bind(self.change(m), lambda c: F.when(~c.eqNullSafe(m), c)))


@dataclass(frozen=True, kw_only=True)
class MoveLine(Rule):
    """Move the line holding ``marker`` to just above ``above``, unless it already stands before it."""

    line_pattern: str
    marker: str
    above: str

    def edit(self, html: Column) -> Edit:
        line = F.regexp_extract(html, self.line_pattern, 0)
        without = F.regexp_replace(html, *_first_match(self.line_pattern, ""))
        moved = bind(
            without,
            lambda rest: at_first(
                rest, self.above, lambda before, after: F.concat(before, line, F.lit(self.above), after)
            ),
        )
        found = (F.instr(html, self.marker) > 0) & (F.instr(html, self.above) > 0) & (line != "")
        return Edit(moved, found, F.lit(1))

    def step(self, html: Column) -> Column:
        placed = (F.instr(html, self.marker) > 0) & (F.instr(html, self.marker) < F.instr(html, self.above))
        kept = F.struct(html.alias("html"), F.lit(ALREADY).alias("status"), F.lit(0).alias("n_repl"))
        return F.when(placed, kept).otherwise(super().step(html))


def rewrite_pages(pages: DataFrame, rules: Sequence[Rule], html: str = "html") -> DataFrame:
    """Adds ``html_new`` and ``ledger``: one ``(rule, status, n_repl)`` per rule, in rule order."""
    out = pages.withColumn("html_new", F.col(html))
    entries = []
    for i, rule in enumerate(rules):
        # One projection per rule: the step is computed once and its fields are read from it.
        step = f"_step_{i}"
        out = out.withColumn(step, rule.step(F.col("html_new"))).withColumn("html_new", F.col(f"{step}.html"))
        out = out.withColumn(
            step,
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.col(f"{step}.status").alias("status"),
                F.col(f"{step}.n_repl").alias("n_repl"),
            ),
        )
        entries.append(step)
    done = computed_once(out, {"html_new": F.col("html_new"), "ledger": F.array(*entries)})
    return done.drop(*entries)


def with_values(pages: DataFrame, values: DataFrame, page_key: str, keys: Column, into: str = "values") -> DataFrame:
    """``pages`` with a map column of those ``values`` (``key, value``; of several values the least) that each page asks for.

    ``keys`` is an array of the keys on a page. Only pairs of page and key meet the table, in an equi join that adaptive
    execution splits where a key is on very many pages; the text is shuffled once, to meet its few values, and that of
    pages without keys not at all. ``page_key`` tells the pages apart.
    """
    table = values.where(F.col("key").isNotNull() & F.col("value").isNotNull()).groupBy("key").agg(F.min("value").alias("value"))
    wanted = computed_once(pages, {"_keys": F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))})
    pairs = pages.select(F.col(page_key), F.explode(F.array_distinct(keys)).alias("key"))
    known = pairs.join(table, "key").groupBy(page_key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(into))
    asking = wanted.where(F.size("_keys") > 0).drop("_keys").join(known, page_key, "left")
    others = wanted.where(F.size("_keys") == 0).drop("_keys").withColumn(into, F.lit(None).cast("map<string,string>"))
    return asking.select(*pages.columns, into).unionByName(others)


def replace_by_table(
    pages: DataFrame, values: DataFrame, page_key: str, pattern: str, key_group: int, build: Callable[[Column, Column], Column], name: str = "replace_by_table", html: str = "html"
) -> DataFrame:
    """``ReplaceByKey`` with the values of a table of any size: pages with ``html_new`` and ``ledger``."""
    found = with_values(pages, values, page_key, F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(key_group)), "_values")
    rule = ReplaceByKey(name=name, pattern=pattern, key_group=key_group, values=F.coalesce("_values", F.create_map().cast("map<string,string>")), build=build)
    return rewrite_pages(found, [rule], html).drop("_values")


def changed_only(rewritten: DataFrame, html: str = "html") -> DataFrame:
    return rewritten.where(~F.col("html_new").eqNullSafe(F.col(html)))


def ledger_totals(rewritten: DataFrame) -> DataFrame:
    """Pages and replacements per rule and status."""
    return (
        rewritten.select(F.explode("ledger").alias("e"))
        .groupBy(F.col("e.rule").alias("rule"), F.col("e.status").alias("status"))
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("e.n_repl").alias("n_repl"))
    )


STATUSES = (UPDATED, ALREADY, NO_MATCH, UNCHANGED, OUT_OF_SCOPE)


def observed_totals(rewritten: DataFrame, rules: Sequence[str]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``rewritten``, and what gives its ``ledger_totals`` once an action has run over it: metrics of that job, no second run.

    The metrics are of all rows that pass here, whatever later filters drop. ``rules`` are the names in the ledger's order.
    """
    observation, spark = Observation(), rewritten.sparkSession
    cells = [(i, rule, status) for i, rule in enumerate(rules) for status in STATUSES]

    def metrics() -> Iterator[Column]:
        for i, _, status in cells:
            entry = F.get("ledger", i)
            here = entry["status"] == status
            yield F.count_if(here).alias(f"{i}_{status}_pages")
            yield F.sum(F.when(here, entry["n_repl"]).otherwise(0)).cast("long").alias(f"{i}_{status}_n")

    def totals() -> DataFrame:
        got = observation.get
        rows = [(rule, status, got[f"{i}_{status}_pages"], got[f"{i}_{status}_n"]) for i, rule, status in cells if got[f"{i}_{status}_pages"]]
        return spark.createDataFrame(rows, "rule string, status string, pages long, n_repl long")

    return rewritten.observe(observation, *metrics()), totals


def residual_tokens(pages: DataFrame, tokens: Sequence[str], keys: Sequence[str], html: str = "html") -> DataFrame:
    """Which pages still hold which old tokens. The token list is a parameter, so it stays row-local."""
    held = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.col(html), t))
    return pages.select(*keys, F.explode(held).alias("token"))


def token_coverage(pages: DataFrame, hook: str, marker: str, html: str = "html") -> DataFrame:
    """Per page: ``already`` (marker present), ``to_do`` (only the hook present) or ``no_hook``."""
    text = F.col(html)
    status = (
        F.when(~F.contains(text, F.lit(hook)), "no_hook")
        .when(F.contains(text, F.lit(marker)), ALREADY)
        .otherwise("to_do")
    )
    return pages.withColumn("status", status)


def page_metadata(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Title, description and the two matching Open Graph values of each page; '' where absent."""
    text = F.col(html)
    return pages.select(
        *keys,
        F.regexp_extract(text, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(text, r'<meta name="description" content="([^"]*)"', 1).alias("description"),
        F.regexp_extract(text, r'<meta property="og:title" content="([^"]*)"', 1).alias("og_title"),
        F.regexp_extract(text, r'<meta property="og:description" content="([^"]*)"', 1).alias("og_description"),
    )


# ---- Ready-made rules ---------------------------------------------------------------------------

COMMENTS_AND_STYLES = r"<!--[\s\S]*?-->|<style\b[\s\S]*?</style>"
EAGER = ' fetchpriority="high" loading="eager"'


def word(name: str, old: str, new: str, outside: str | None = None) -> ReplacePattern:
    """Replace a whole word everywhere, or only outside protected regions.

    A word is bounded as in a browser, by ASCII letters and digits; Java's own ``\\b`` knows more letters.
    """
    pattern = rf"(?<![A-Za-z0-9_]){quote_pattern(old)}(?![A-Za-z0-9_])"
    return ReplacePattern(
        name=name, pattern=pattern, replacement=quote_replacement(new), hint=old, outside=outside
    )


def double_slash() -> ReplacePattern:
    """``="//x`` made by a faulty migration becomes ``="/x``; real host references stay."""
    return ReplacePattern(
        name="double_slash", pattern=r'(href|src)="//(?![a-zA-Z0-9-]+\.)', replacement='$1="/', hint='="//'
    )


def root_background(folder: str = "assets/") -> ReplacePattern:
    """Root-anchor ``url('assets/…')`` in inline styles."""
    return ReplacePattern(
        name="root_background",
        pattern=rf"url\((['\"]){quote_pattern(folder)}",
        replacement=f"url($1/{folder}",
        hint=folder,
    )


def asset_version(path: str, version: str) -> ReplacePattern:
    """Set the version query of a style sheet or script link; an existing version is replaced."""
    return ReplacePattern(
        name=f"version {path}",
        pattern=rf'href="{quote_pattern(path)}(?:\?v=[^"]*)?"',
        replacement=f'href="{path}?v={version}"',
        hint=f'href="{path}',
    )


def drop_script(suffix: str) -> ReplacePattern:
    """Remove script includes whose source ends in ``suffix``."""
    return ReplacePattern(
        name=f"drop {suffix}",
        pattern=rf'\s*<script\s+src="[^"]*{quote_pattern(suffix)}"[^>]*>\s*</script>',
        replacement="",
        hint=suffix,
    )


def tidy_void_tags(tag: str = "img") -> EditMatches:
    """Drop a slash that ended up inside a void tag, and fold its white space."""

    def change(match: Column) -> Column:
        inner = F.substring(match, F.lit(len(tag) + 2), F.length(match) - (len(tag) + 2))
        folded = F.regexp_replace(F.regexp_replace(inner, r"\s*/\s+", " "), r"\s+", " ")
        tidy = F.concat(F.lit(f"<{tag} "), F.regexp_replace(folded, r"^\s+|\s+\z", ""), F.lit(">"))
        return F.when(F.rlike(F.left(match, F.length(match) - 1), F.lit(r"/\s")), tidy).otherwise(match)

    return EditMatches(name=f"tidy_{tag}", pattern=rf"<{tag}\b[^>]*>", change=change, hint=f"<{tag}")


def hero_priority(container: str, name: str = "hero_priority") -> EditMatches:
    """The first image of a container loads eagerly and with high priority, once.

    ``container`` is a pattern for the markup up to the image tag.
    """

    def change(match: Column) -> Column:
        tag = F.regexp_extract(match, r"<img\b[^>]*>\z", 0)
        eager = F.regexp_replace(tag, *_first_match(r'\s*loading="lazy"', ""))
        head = F.left(match, F.length(match) - F.length(tag))
        new = F.concat(head, F.left(eager, F.length(eager) - 1), F.lit(EAGER + ">"))
        return F.when(F.contains(tag, F.lit("fetchpriority=")), match).otherwise(new)

    return EditMatches(name=name, pattern=rf"{container}\s*<img\b[^>]*>", change=change, hint="<img")


def prioritise_class(css_class: str) -> EditMatches:
    """Images of one class load eagerly and with high priority, once."""

    def change(match: Column) -> Column:
        new = F.concat(F.left(match, F.length(match) - 1), F.lit(EAGER + ">"))
        return F.when(F.contains(match, F.lit("fetchpriority=")), match).otherwise(new)

    marker = f'class="{css_class}"'
    return EditMatches(
        name=f"prioritise {css_class}", pattern=rf"<img\b[^>]*?{quote_pattern(marker)}[^>]*>", change=change, hint=marker
    )


# ---- Image dimensions ---------------------------------------------------------------------------

IMG_TAG = r"<img\b[^>]*>"


def enrich_images(
    pages: DataFrame, sizes: DataFrame, key: str, html: str = "html", site_origin: str | None = None
) -> DataFrame:
    """Give every ``<img>`` without a width the dimensions of its asset (``sizes``: path, width, height).

    Only ``(page, image path)`` pairs meet the asset table. The page text is shuffled once, to meet
    its own few dimensions again, and pages without images are not shuffled at all.
    """

    def source(tag: Column) -> Column:
        src = F.regexp_extract(tag, r'\bsrc="([^"]+)"', 1)
        if site_origin:
            src = F.when(F.startswith(src, F.lit(site_origin)), F.substring(src, F.lit(len(site_origin) + 1), F.length(src))).otherwise(src)
        return src

    def wanted(tag: Column) -> Column:
        return ~F.rlike(tag, F.lit(r"\bwidth=")) & F.startswith(source(tag), F.lit("/"))

    text = F.col(html)
    with_images = F.coalesce(F.contains(text, F.lit("<img")), F.lit(False))
    tags = F.filter(F.regexp_extract_all(text, F.lit(IMG_TAG), F.lit(0)), wanted)
    pairs = pages.where(with_images).select(
        F.col(key), F.explode(F.array_distinct(F.transform(tags, source))).alias("_src")
    )
    known = (
        pairs.join(sizes.select(F.col("path").alias("_src"), "width", "height"), "_src")
        .groupBy(key)
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("_src", F.struct("width", "height").alias("size")))
            ).alias("_sizes")
        )
    )

    def enriched(tag: Column) -> Column:
        size = F.try_element_at(F.col("_sizes"), source(tag))
        # The attributes go right after the source, in front of whatever follows it.
        attr = F.regexp_extract(tag, r'\bsrc="[^"]+"', 0)
        dims = F.concat(F.lit(' width="'), size["width"], F.lit('" height="'), size["height"], F.lit('"'))
        start = F.instr(tag, attr)
        new = F.concat(
            F.substring(tag, F.lit(1), start - 1 + F.length(attr)),
            dims,
            F.substring(tag, start + F.length(attr), F.length(tag)),
        )
        return F.when(wanted(tag) & size.isNotNull(), new).otherwise(tag)

    met = pages.where(with_images).join(known, key, "left")
    done = F.when(F.col("_sizes").isNull(), text).otherwise(replace_segments(text, IMG_TAG, enriched))
    rewritten = computed_once(met, {"html_new": done}).drop("_sizes")
    untouched = pages.where(~with_images).withColumn("html_new", text)
    return rewritten.select(*pages.columns, "html_new").unionByName(untouched)
