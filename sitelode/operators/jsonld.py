"""JSON-LD blocks: extraction from pages, generation, insertion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import FAQ_ENTITIES, as_col, decode_entities, first_filled, quote_pattern, replace_first
from sitelode.operators.content import quoted_replacement
from sitelode.operators.ordered import ordered_items

SCHEMA_ORG = "https://schema.org"
OPEN_TAG = '<script type="application/ld+json">'
CLOSE_TAG = "</script>"
BLOCK = r'<script type="application/ld\+json">([\s\S]*?)</script>'


@dataclass(frozen=True)
class Organization:
    name: str
    url: str
    logo: str | None = None

    def ref(self) -> Column:
        return _node("Organization", name=self.name, url=self.url)

    def full(self) -> Column:
        return _node("Organization", name=self.name, url=self.url, logo=self.logo)


def _node(type_: str | None, **fields: Column | str | None) -> Column:
    """A JSON node; fields that are null at run time are left out when it is written."""
    head = [F.lit(type_).alias("@type")] if type_ else []
    return F.struct(*head, *[as_col(v).alias(k) for k, v in fields.items() if v is not None])


def _root(type_: str, **fields: Column | str | None) -> Column:
    parts = [F.lit(SCHEMA_ORG).alias("@context"), F.lit(type_).alias("@type")]
    return F.to_json(F.struct(*parts, *[as_col(v).alias(k) for k, v in fields.items() if v is not None]))


def json_text(text: str) -> str:
    return dumps(text, ensure_ascii=False)


# ---- Extraction ---------------------------------------------------------------------------------


def json_blocks(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """One row per block: position, root type, JSON text. A malformed block has a null type."""
    blocks = pages.where(F.contains(html, F.lit(OPEN_TAG))).select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(1))).alias("pos", "json")
    )
    return blocks.select(*keys, "pos", F.get_json_object("json", "$['@type']").alias("type"), "json")


def json_nodes(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """One row per block, node and type: ``keys, pos, node, type, json``; ``node`` counts a block's nodes from 0.

    A block's nodes are the objects it holds: its root, the members of a top-level array, and those of ``@graph`` in any of
    them; an object that is only a container of a graph is none. A node of several types has a row for each, one without
    a type has a null. A block that is broken, or holds no object, stays as one row of null node and type.
    """
    blocks = pages.where(F.contains(html, F.lit(OPEN_TAG))).select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(1))).alias("pos", "block")
    )
    parsed = F.try_parse_json("block")

    def members(node: Column, path: str) -> Column:
        return F.try_variant_get(node, path, "array<variant>")

    def is_object(node: Column) -> Column:
        return F.startswith(F.schema_of_variant(node), F.lit("OBJECT"))

    roots = F.filter(F.coalesce(members(parsed, "$"), F.array(parsed)), lambda n: n.isNotNull() & is_object(n))

    def with_graph(root: Column) -> Column:
        graph = members(root, "$['@graph']")
        own = F.when(graph.isNotNull() & F.try_variant_get(root, "$['@type']", "variant").isNull(), F.array().cast("array<variant>")).otherwise(F.array(root))
        return F.concat(own, F.filter(F.coalesce(graph, F.array().cast("array<variant>")), lambda n: n.isNotNull() & is_object(n)))

    nodes = blocks.select(*keys, "pos", "block", F.posexplode_outer(F.flatten(F.transform(roots, with_graph))).alias("node", "value"))
    type_of = F.col("value")
    types = F.coalesce(F.try_variant_get(type_of, "$['@type']", "array<string>"), F.array(F.try_variant_get(type_of, "$['@type']", "string")))
    return nodes.select(*keys, "pos", "node", F.explode_outer(types).alias("type"), F.coalesce(F.to_json("value"), F.col("block")).alias("json"))


def has_type(html: Column, type_: str) -> Column:
    """Whether a block declares the type at its root."""
    return F.contains(html, F.lit(f'"@context":"{SCHEMA_ORG}","@type":"{type_}"'))


def pages_lacking(pages: DataFrame, type_: str, html: str = "html") -> DataFrame:
    return pages.where(~F.coalesce(has_type(F.col(html), type_), F.lit(False)))


def date_published(html: Column) -> Column:
    """ISO date of the first block that has one, also where the block is malformed."""
    iso = F.regexp_extract(html, r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})"', 1)
    return F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd")


# ---- Generation ---------------------------------------------------------------------------------


def breadcrumb_list(trail: Column) -> Column:
    """``trail``: array of ``(name, url)`` from the home page down."""
    items = F.transform(
        trail, lambda t, i: _node("ListItem", position=i + 1, name=t["name"], item=t["url"])
    )
    return _root("BreadcrumbList", itemListElement=items)


def item_list(name: Column | str, items: Column, start: Column | int = 1, description: str | None = None) -> Column:
    """``items``: array of names, or of ``(name, url)``."""
    first = start if isinstance(start, Column) else F.lit(start)
    return _root(
        "ItemList",
        name=name,
        description=description,
        itemListElement=F.transform(items, lambda t, i: _node("ListItem", position=i + first, name=t)),
    )


def linked_item_list(name: Column | str, items: Column, description: str | None = None) -> Column:
    return _root(
        "ItemList",
        name=name,
        description=description,
        itemListElement=F.transform(
            items, lambda t, i: _node("ListItem", position=i + 1, name=t["name"], url=t["url"])
        ),
    )


def faq_page(questions: Column, entities: tuple[tuple[str, str], ...] = FAQ_ENTITIES) -> Column:
    """``questions``: array of ``(q, a)``; entities become characters."""
    entry = lambda t: _node(
        "Question",
        name=decode_entities(t["q"], entities),
        acceptedAnswer=_node("Answer", text=decode_entities(t["a"], entities)),
    )
    return _root("FAQPage", mainEntity=F.transform(questions, entry))


def faq_blocks(rows: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """One FAQ block per page from a long table with columns ``q`` and ``a``: ``keys, json``."""
    grouped = ordered_items(rows, keys, position, F.struct("q", "a"))
    return grouped.select(*keys, faq_page(F.col("items")).alias("json"))


def service(
    organization: Organization,
    service_type: str,
    name: Column,
    audience: Column,
    audience_type: Column,
    description: Column,
    output: Column,
    url: Column,
    area: str,
) -> Column:
    return _root(
        "Service",
        serviceType=service_type,
        name=F.concat(F.lit(organization.name + " for "), name),
        provider=organization.full(),
        areaServed=area,
        audience=_node(
            "BusinessAudience", name=audience, audienceType=audience_type
        ),
        description=description,
        serviceOutput=output,
        url=url,
    )


def person(organization: Organization, name: Column, job_title: Column, description: Column, image: Column, profile: Column, topics: Column) -> Column:
    return _root(
        "Person",
        name=name,
        jobTitle=job_title,
        description=description,
        image=image,
        url=profile,
        sameAs=F.array(profile),
        worksFor=organization.ref(),
        knowsAbout=topics,
    )


def author_node(organization: Organization, author: Column) -> Column:
    """The organisation itself or a person of it: one struct whose unused fields stay null."""
    own = author == organization.name
    return F.struct(
        F.when(own, "Organization").otherwise("Person").alias("@type"),
        author.alias("name"),
        F.when(own, organization.url).alias("url"),
        F.when(own, organization.logo).alias("logo"),
        F.when(~own, organization.ref()).alias("worksFor"),
    )


def article_blocks(articles: DataFrame, documents: DataFrame, organization: Organization, site_url: str) -> DataFrame:
    """Article block per page: ``path, json``.

    ``articles``: path, slug, section, and explicit headline, description, image, author that go
    before the front matter in ``documents`` (slug, meta).
    """

    def meta(key: str) -> Column:
        return F.try_element_at(F.col("meta"), F.lit(key))

    def pick(*cols: Column) -> Column:
        return F.nullif(first_filled(*cols), F.lit(""))

    image = F.concat(F.lit(site_url), F.regexp_replace(F.nullif(meta("image"), F.lit("")), r"^\.\./", "/"))
    author = first_filled(F.col("author"), meta("author"), F.lit(organization.name))
    joined = articles.join(documents.select("slug", "meta"), "slug", "left")
    block = _root(
        "Article",
        headline=pick(F.col("headline"), meta("title")),
        description=pick(F.col("description"), meta("metaDescription"), meta("excerpt"), meta("deck")),
        image=pick(F.col("image"), image),
        author=author_node(organization, author),
        publisher=organization.full(),
        mainEntityOfPage=F.struct(
            F.lit("WebPage").alias("@type"), F.concat(F.lit(site_url + "/"), F.col("path")).alias("@id")
        ),
        articleSection=F.col("section"),
        inLanguage="en",
    )
    return joined.select("path", block.alias("json"))


# ---- Insertion ----------------------------------------------------------------------------------


def block_tag(json: Column) -> Column:
    return F.concat(F.lit(OPEN_TAG), json, F.lit(CLOSE_TAG))


def insert_block(html: Column, json: Column) -> Column:
    """Put a block in front of the first ``</head>``."""
    return replace_first(html, "</head>", F.concat(block_tag(json), F.lit("\n</head>")))


def insert_block_after(html: Column, type_: str, name: str, json: Column) -> Column:
    """Put a block on the line after the one of this type and name; the page is unchanged without it."""
    start = f'{{"@context":"{SCHEMA_ORG}","@type":"{type_}","name":{json_text(name)}'
    pattern = rf"\A((?s:.*?){quote_pattern(OPEN_TAG + start)}[\s\S]*?</script>)"
    return F.regexp_replace(html, F.lit(pattern), F.concat(F.lit("$1\n"), quoted_replacement(block_tag(json))))


def upsert_block(html: Column, type_: str, json: Column) -> Column:
    """Replace the page's first block of this root type, or insert one."""
    old = rf'\A((?s:.*?))<script type="application/ld\+json">\{{"@context":"{SCHEMA_ORG}","@type":"{type_}"[\s\S]*?</script>'
    replaced = F.regexp_replace(html, F.lit(old), F.concat(F.lit("$1"), quoted_replacement(block_tag(json))))
    return F.when(F.contains(html, F.lit(f'"@type":"{type_}"')), replaced).otherwise(insert_block(html, json))
