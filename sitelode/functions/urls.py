"""URL expressions: parts, resolution against a page, clean folder form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelode.functions.text import bind, browser_trim

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"

# References that are never resolved against the page.
FOREIGN = r"https?:|mailto:|tel:|data:|javascript:"
SPECIAL_REF = rf"^({FOREIGN}|#|/)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def url_host(url: Column) -> Column:
    """Host with port as a browser shows it: lower case, no user part, no default port; '' if none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#\\@]*@)*([^/?#\\]*)", 1)
    return bind(
        F.lower(authority),
        lambda host: F.when(F.endswith(host, F.lit(":80")) & (url_scheme(url) == "http"), F.left(host, F.length(host) - 3))
        .when(F.endswith(host, F.lit(":443")) & (url_scheme(url) == "https"), F.left(host, F.length(host) - 4))
        .otherwise(host),
    )


def url_path(url: Column) -> Column:
    """Path part, ``/`` when empty; works on absolute URLs and on root-anchored paths."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, percent-decoded; null when the parameter is absent."""
    hit = F.regexp_extract(url, rf"^[^?#]*\?((?:[^#]*?&)??{name}=[^&#]*)", 1)
    raw = F.regexp_extract(hit, rf"(?:^|&){name}=([^&]*)\z", 1)
    return F.when(hit != "", F.coalesce(F.try_url_decode(raw), raw))


def acquisition_source(url: Column) -> Column:
    return F.coalesce(F.nullif(query_value(url, "utm_source"), F.lit("")), F.lit("direct"))


def is_external(href: Column, page_url: Column) -> Column:
    """True when the link, resolved against its page, is http(s) on another host."""

    def other_host(url: Column) -> Column:
        return bind(url_host(url), lambda host: (host != "") & (host != url_host(page_url)))

    page_scheme = url_scheme(page_url)
    ref = browser_trim(href)
    return F.coalesce(
        # Most links stay on the site, and are told by their first characters.
        F.when(
            F.startswith(ref, F.lit("//")),
            page_scheme.isin("http", "https") & other_host(F.concat(page_scheme, F.lit(":"), ref)),
        )
        .when(F.lower(F.left(ref, F.lit(8))).rlike("^https?://"), other_host(ref))
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def fold_segments(path: Column) -> Column:
    """Root-anchored path with ``.``, ``..`` and empty segments folded; a final slash stays."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return bind(
        joined,
        lambda out: F.when(F.endswith(path, F.lit("/")) & (out != "/"), F.concat(out, F.lit("/"))).otherwise(out),
    )


def resolve_ref(page_path: Column, ref: Column) -> Column:
    """A relative reference as a root-anchored path; null for absolute, special and ``#`` references.

    The result always starts with one slash, whether or not the page path itself is root-anchored.
    """
    file = F.substring_index(page_path, "/", -1)
    folder = F.left(page_path, F.length(page_path) - F.length(file))
    return F.when(~F.rlike(ref, F.lit(SPECIAL_REF)), fold_segments(F.concat(folder, ref)))


def clean_url(path: Column, suffix: Column) -> Column:
    """``/x.html`` as ``/x/``, the index page as ``/``, anything else unchanged; fragment or query kept."""
    bare = F.ltrim(path, F.lit("/"))
    clean = (
        F.when(bare.isin("index.html", ""), F.lit("/"))
        .when(F.endswith(bare, F.lit(".html")), F.concat(F.lit("/"), F.left(bare, F.length(bare) - 5), F.lit("/")))
        .otherwise(path)
    )
    return F.concat(clean, F.coalesce(suffix, F.lit("")))
