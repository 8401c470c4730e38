"""Text expressions: trimming, escaping, entity decoding, literal and segment-wise replacement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a browser's trim() removes, as a pattern class and as characters.
# SQL trim without a list removes only the space.
BROWSER_SPACE = (
    r"\t\n\x0B\f\r\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Entities decoded for structured data; the ampersand comes last so that an escaped
# entity is decoded once only.
FAQ_ENTITIES = (
    ("&mdash;", "—"),
    ("&rsquo;", "’"),
    ("&lsquo;", "‘"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
)

# The shorter list used for question-and-answer blocks of section pages.
SECTION_ENTITIES = (("&mdash;", "—"), ("&rsquo;", "’"), ("&amp;", "&"))

# Spellings folded together before titles are compared.
TITLE_FOLDS = (
    ("&amp;", "&"),
    ("&lsquo;|&rsquo;|&#8216;|&#8217;|‘|’", "'"),
    ("&ldquo;|&rdquo;|&#8220;|&#8221;|“|”", '"'),
    ("&mdash;|&#8212;|—", "—"),
)


def as_col(value: Column | str) -> Column:
    """A Python string is literal text; a Column is used as it is."""
    return value if isinstance(value, Column) else F.lit(value)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def browser_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def escape_html(c: Column) -> Column:
    # The ampersand goes first, or the entities written for the others would be escaped again.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def inline_bold(c: Column) -> Column:
    """Escaped text with ``**x**`` as strong emphasis; a pair never spans lines."""
    pattern = r"\*\*([^\n\r\x{2028}\x{2029}]+?)\*\*"
    return bind(
        escape_html(c),
        lambda e: F.when(F.contains(e, F.lit("**")), F.regexp_replace(e, pattern, "<strong>$1</strong>")).otherwise(e),
    )


def decode_entities(c: Column, entities: tuple[tuple[str, str], ...] = FAQ_ENTITIES) -> Column:
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def fold_title(c: Column) -> Column:
    for pattern, plain in TITLE_FOLDS:
        c = F.regexp_replace(c, pattern, plain)
    return browser_trim(c)


def quote_replacement(text: str) -> str:
    """Text safe as a regular-expression replacement, where ``$`` and ``\\`` have a meaning."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def quote_pattern(text: str) -> str:
    """Text as a pattern that matches itself, in both Java's and RE2's syntax."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def count_literal(haystack: Column, needle: str) -> Column:
    """How often ``needle`` occurs, counted without overlap."""
    removed = F.replace(haystack, F.lit(needle), F.lit(""))
    return ((F.length(haystack) - F.length(removed)) / F.lit(len(needle))).cast("int")


def at_first(text: Column, anchor: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use(before, after)`` with the text around the first ``anchor``; only meaningful where it occurs."""
    return bind(
        F.substring_index(text, anchor, 1),
        lambda before: use(before, F.substring(text, F.length(before) + len(anchor) + 1, F.length(text))),
    )


def at_last(text: Column, anchor: str, use: Callable[[Column, Column], Column]) -> Column:
    return bind(
        F.substring_index(text, anchor, -1),
        lambda after: use(F.left(text, F.length(text) - F.length(after) - len(anchor)), after),
    )


def replace_first(text: Column, old: str, new: Column | str) -> Column:
    def replaced(t: Column) -> Column:
        put = at_first(t, old, lambda before, after: F.concat(before, as_col(new), after))
        return F.when(F.contains(t, F.lit(old)), put).otherwise(t)

    return bind(text, replaced)


def replace_segments(
    text: Column, pattern: str, edit: Callable[[Column], Column], hint: str | None = None
) -> Column:
    """Replace every match of ``pattern`` by ``edit(match)`` and keep the rest as it is.

    Splitting drops the separators, so they are extracted and zipped back in. Row-local: no shuffle.
    ``hint``: literal in every match; text without it is not scanned.
    """
    if hint:
        return bind(
            text,
            lambda t: F.when(F.contains(t, F.lit(hint)), replace_segments(t, pattern, edit)).otherwise(t),
        )
    rest = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(
        rest, found, lambda kept, m: F.concat(kept, F.when(m.isNull(), F.lit("")).otherwise(edit(m)))
    )
    return F.array_join(joined, "")


def counted_segments(text: Column, pattern: str, edit: Callable[[Column], Column]) -> Column:
    """``struct<html, count>``: matches replaced by ``edit(match)``, where that isn't null, and how many were.

    The pattern is looked for once, and each match is edited once.
    """

    def put(found: Column) -> Column:
        def joined(new: Column) -> Column:
            kept = F.zip_with(found, new, lambda m, e: F.coalesce(e, m))
            whole = F.zip_with(F.split(text, pattern, -1), kept, lambda rest, m: F.concat(rest, F.coalesce(m, F.lit(""))))
            return F.struct(F.array_join(whole, "").alias("html"), F.size(F.array_compact(new)).alias("count"))

        return bind(F.transform(found, edit), joined)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), put)


def replace_outside(text: Column, protected: str, edit: Callable[[Column], Column]) -> Column:
    """Apply ``edit`` everywhere except inside matches of ``protected``."""
    rest = F.split(text, protected, -1)
    found = F.regexp_extract_all(text, F.lit(protected), F.lit(0))
    joined = F.zip_with(rest, found, lambda part, kept: F.concat(edit(part), F.coalesce(kept, F.lit(""))))
    return F.array_join(joined, "")


def js_json(c: Column) -> Column:
    """A string as a JSON literal."""
    # to_json has no form for a bare string, so a one-element array is written and unwrapped.
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)
