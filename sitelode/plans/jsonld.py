"""Queries over JSON-LD blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators import content, jsonld
from sitelode.operators.attribution import path_date
from sitelode.plans.derived import MARKDOWN_SQL, SITE_URL, markdown, with_sql
from sitelode.plans.registry import Plan, table

COMPANY = jsonld.Organization("Example Co", SITE_URL + "/", SITE_URL + "/logo.png")
OLD_FAQ = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[]}</script>'


def trail() -> Column:
    """Home page and one entry per segment of the page's path."""
    segments = F.filter(F.split(F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1), "/"), lambda s: s != "")
    home = F.struct(F.lit("Home").alias("name"), F.lit(SITE_URL + "/").alias("url"))
    steps = F.transform(
        segments,
        lambda s, i: F.struct(
            s.alias("name"), F.concat(F.lit(SITE_URL + "/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"), F.lit("/")).alias("url")
        ),
    )
    return F.concat(F.array(home), steps)


def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", jsonld.breadcrumb_list(trail()).alias("json"))


def nav_names() -> Column:
    return F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)">'), F.lit(1))


def item_lists(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("Links of "), "url")
    return table(spark, folder, "pages").select("page_id", jsonld.item_list(name, nav_names()).alias("json"))


def linked_item_lists(spark: SparkSession, folder: str) -> DataFrame:
    items = F.transform(nav_names(), lambda n: F.struct(n.alias("name"), F.concat(F.lit(SITE_URL + "/"), n).alias("url")))
    return table(spark, folder, "pages").select(
        "page_id", jsonld.linked_item_list("Links", items, description="All links").alias("json")
    )


def pages_with_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its breadcrumbs, every third with a list as well, every fifth with a broken block."""
    html = jsonld.insert_block(F.col("html"), jsonld.breadcrumb_list(trail()))
    html = F.when(F.col("page_id") % 3 == 0, jsonld.insert_block(html, jsonld.item_list("Links", nav_names()))).otherwise(html)
    html = F.when(F.col("page_id") % 5 == 0, jsonld.insert_block(html, F.lit('{"@type":'))).otherwise(html)
    return table(spark, folder, "pages").select("page_id", html.alias("html"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return jsonld.json_blocks(pages_with_blocks(spark, folder), ["page_id"])


def block_types(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def graph_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose blocks hold one node, an array of nodes, a graph, and nodes of several types; some are broken."""
    n, url = F.col("page_id"), F.to_json(F.struct(F.col("url").alias("url")))
    single = F.concat(F.lit('{"@context":"https://schema.org","@type":"WebPage","of":'), url, F.lit("}"))
    listed = F.concat(F.lit('[{"@type":["Article","NewsArticle"],"n":'), n, F.lit('}, {"name":"none"}, "text", {"@type":"Person"}]'))
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":[{"@type":"Organization","of":'), url, F.lit('},{"@type":["Person","Author"]}]}'))
    typed = F.lit('{"@type":"Thing","@graph":[{"@type":"Place"}]}')
    broken = F.lit('{"@type":"Article",')
    some = F.array(single, F.when(n % 2 == 0, listed), F.when(n % 3 == 0, graph), F.when(n % 5 == 0, broken), F.when(n % 7 == 0, typed), F.when(n % 11 == 0, F.lit("[]")))
    blocks = F.transform(F.array_compact(some), lambda b: F.concat(F.lit(jsonld.OPEN_TAG), b, F.lit(jsonld.CLOSE_TAG)))
    html = F.concat(F.lit("<head>"), F.array_join(blocks, "\n"), F.lit("</head>"), "html")
    return table(spark, folder, "pages").select("page_id", html.alias("html"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return jsonld.json_nodes(graph_pages(spark, folder), ["page_id"]).select("page_id", "pos", "node", "type")


def lacking(spark: SparkSession, folder: str) -> DataFrame:
    return jsonld.pages_lacking(pages_with_blocks(spark, folder), "ItemList").select("page_id")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    docs = content.front_matter(markdown(spark, folder))
    none = F.lit(None).cast("string")
    n = F.col("doc_id")
    pages = table(spark, folder, "documents").select(
        F.concat(F.lit("insights/doc-"), n, F.lit(".html")).alias("path"),
        F.concat(F.lit("doc-"), n).alias("slug"),
        F.col("source").alias("section"),
        F.when(n % 2 == 0, F.concat(F.lit("Headline “"), n, F.lit("”"))).alias("headline"),
        none.alias("description"),
        F.when(n % 5 == 0, "/a.png").alias("image"),
        F.when(n % 3 == 0, "Ann Author").alias("author"),
    )
    return jsonld.article_blocks(pages, docs, COMPANY, SITE_URL)


def faq(spark: SparkSession, folder: str) -> DataFrame:
    """What a user says is a question, the next turn its answer, if there is one."""
    turns = table(spark, folder, "conversations").withColumn("said", F.concat("text", F.lit(" &mdash; &amp;rsquo; &rsquo;s")))
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("a"))
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("said").alias("q"))
    pairs = asked.join(answers, ["conv_id", "turn"], "left").withColumn("a", F.coalesce("a", F.lit("")))
    return jsonld.faq_blocks(pairs, ["conv_id"], F.col("turn"))


NAMED = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Person","name":"Ann"}</script>'


def inserted_after(spark: SparkSession, folder: str) -> DataFrame:
    """A person's block after the one of another person, which half of the pages have."""
    had = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<title>"), F.lit(NAMED + "<title>"))).otherwise(F.col("html"))
    json = F.concat(F.lit('{"@context":"https://schema.org","@type":"Person","name":"$1 '), "page_id", F.lit('"}'))
    return table(spark, folder, "pages").select("page_id", jsonld.insert_block_after(had, "Person", "Ann", json).alias("html"))


def faq_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the pages have a FAQ block to replace."""
    had = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<title>"), F.lit(OLD_FAQ + "<title>"))).otherwise(F.col("html"))
    qa = F.transform(nav_names(), lambda n: F.struct(F.concat(n, F.lit("?")).alias("q"), F.concat(F.lit("$1 "), n).alias("a")))
    pages = table(spark, folder, "pages").select("page_id", had.alias("html"), jsonld.faq_page(qa).alias("json"))
    return pages.select("page_id", jsonld.upsert_block(F.col("html"), "FAQPage", F.col("json")).alias("html"))


def services(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey",
        jsonld.service(
            COMPANY,
            "Advisory",
            name,
            F.col("c_name"),
            F.concat(F.lit("Teams in "), name),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("For "), name)),
            F.lit("Plan"),
            F.concat(F.lit(SITE_URL + "/"), F.lower(name)),
            area="Everywhere",
        ).alias("json"),
    )


def people(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        n,
        jsonld.person(
            COMPANY,
            F.col("c_name"),
            F.lit("Partner"),
            F.concat(F.lit("Knows "), "c_mktsegment"),
            F.concat(F.lit(SITE_URL + "/"), n, F.lit(".webp")),
            F.concat(F.lit("https://profiles.example/"), n),
            F.array(F.col("c_mktsegment"), F.lit("AI & data")),
        ).alias("json"),
    )


def published(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.date_format(path_date(F.col("url")), "yyyy-MM-dd")
    block = F.concat(F.lit('{"@type":"Article","datePublished" : "'), stamp, F.lit('","x":1'))
    html = F.when(F.col("page_id") % 3 > 0, jsonld.insert_block(F.col("html"), block)).otherwise(F.col("html"))
    pages = table(spark, folder, "pages").select("page_id", html.alias("html"))
    return pages.select("page_id", F.date_format(jsonld.date_published(F.col("html")), "yyyy-MM-dd").alias("published"))


TRAIL_SQL = r"""
segs AS (SELECT page_id, html, url, list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM pages),
crumbs AS (SELECT page_id, html, url,
  '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"https://site.example/"}'
  || array_to_string(list_transform(range(1, len(s) + 1), lambda i: ',{"@type":"ListItem","position":' || (i + 1) || ',"name":"' || s[i]
       || '","item":"https://site.example/' || array_to_string(s[1:i], '/') || '/"}'), '') || ']}' AS crumb FROM segs),
names AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">', 1) AS n FROM pages),
lists AS (SELECT page_id, n, array_to_string(list_transform(range(1, len(n) + 1), lambda i: '{"@type":"ListItem","position":' || i || ',"name":"' || n[i] || '"}'), ',') AS items FROM names)
"""
_TAG = """'<script type="application/ld+json">' || {0} || '</script>'"""
_LIST = """'{"@context":"https://schema.org","@type":"ItemList","name":"Links","itemListElement":[' || items || ']}'"""
_ORG = '{"@type":"Organization","name":"Example Co","url":"https://site.example/","logo":"https://site.example/logo.png"}'
_REF = '{"@type":"Organization","name":"Example Co","url":"https://site.example/"}'

PLANS = {
    "json_ld_nodes": Plan(
        nodes,
        """WITH b AS (SELECT page_id, unnest(k) AS k, unnest(range(len(k))) AS pos FROM (SELECT page_id, [x FOR x IN ['single',
             CASE WHEN page_id % 2 = 0 THEN 'listed' END, CASE WHEN page_id % 3 = 0 THEN 'graph' END, CASE WHEN page_id % 5 = 0 THEN 'broken' END,
             CASE WHEN page_id % 7 = 0 THEN 'typed' END, CASE WHEN page_id % 11 = 0 THEN 'empty' END] IF x IS NOT NULL] AS k FROM pages)),
           n(k, node, type) AS (VALUES ('single', 0, 'WebPage'), ('listed', 0, 'Article'), ('listed', 0, 'NewsArticle'), ('listed', 1, NULL), ('listed', 2, 'Person'),
             ('graph', 0, 'Organization'), ('graph', 1, 'Person'), ('graph', 1, 'Author'), ('broken', NULL, NULL), ('typed', 0, 'Thing'), ('typed', 1, 'Place'), ('empty', NULL, NULL))
           SELECT page_id, CAST(pos AS INTEGER) AS pos, node, type FROM b JOIN n USING (k)""",
    ),
    "breadcrumb_blocks": Plan(breadcrumbs, with_sql(TRAIL_SQL, select="SELECT page_id, crumb AS json FROM crumbs")),
    "item_list_blocks": Plan(
        item_lists,
        with_sql(
            TRAIL_SQL,
            select="""SELECT page_id, '{"@context":"https://schema.org","@type":"ItemList","name":"Links of ' || url || '","itemListElement":[' || items || ']}' AS json
              FROM lists JOIN pages USING (page_id)""",
        ),
    ),
    "linked_item_list_blocks": Plan(
        linked_item_lists,
        with_sql(
            TRAIL_SQL,
            select="""SELECT page_id, '{"@context":"https://schema.org","@type":"ItemList","name":"Links","description":"All links","itemListElement":['
              || array_to_string(list_transform(range(1, len(n) + 1), lambda i: '{"@type":"ListItem","position":' || i || ',"name":"' || n[i] || '","url":"https://site.example/' || n[i] || '"}'), ',')
              || ']}' AS json FROM lists""",
        ),
    ),
    "json_blocks": Plan(
        blocks,
        with_sql(
            TRAIL_SQL,
            f"""every AS (
              SELECT page_id, 0 AS pos, 'BreadcrumbList' AS type, crumb AS json FROM crumbs
              UNION ALL SELECT page_id, 1, 'ItemList', {_LIST} FROM lists WHERE page_id % 3 = 0
              UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END, NULL, '{{"@type":' FROM pages WHERE page_id % 5 = 0)""",
            select="SELECT page_id, pos, type, json FROM every",
        ),
    ),
    "json_block_types": Plan(
        block_types,
        """SELECT type, n FROM (SELECT 'BreadcrumbList' AS type, count(*) AS n FROM pages
           UNION ALL SELECT 'ItemList', count(*) FROM pages WHERE page_id % 3 = 0
           UNION ALL SELECT NULL, count(*) FROM pages WHERE page_id % 5 = 0)""",
    ),
    "pages_lacking_type": Plan(lacking, "SELECT page_id FROM pages WHERE page_id % 3 <> 0"),
    "article_blocks": Plan(
        articles,
        with_sql(
            MARKDOWN_SQL,
            f"""f AS (SELECT doc_id, source, lang,
                CASE WHEN doc_id % 2 = 0 THEN 'Headline “' || doc_id || '”' ELSE replace(title, '"', '\\"') END AS headline,
                CASE WHEN lang NOT IN ('de', 'en') THEN 'Short' END AS description FROM docs)""",
            select=f"""SELECT 'insights/doc-' || doc_id || '.html' AS path,
              '{{"@context":"https://schema.org","@type":"Article",'
              || coalesce('"headline":"' || headline || '",', '') || coalesce('"description":"' || description || '",', '')
              || CASE WHEN doc_id % 5 = 0 THEN '"image":"/a.png",' ELSE '' END
              || '"author":' || CASE WHEN doc_id % 3 = 0 THEN '{{"@type":"Person","name":"Ann Author","worksFor":{_REF}}}' ELSE '{_ORG}' END
              || ',"publisher":{_ORG},"mainEntityOfPage":{{"@type":"WebPage","@id":"https://site.example/insights/doc-' || doc_id
              || '.html"}},"articleSection":"' || source || '","inLanguage":"en"}}' AS json FROM f""",
        ),
    ),
    "faq_blocks": Plan(
        faq,
        r"""
        WITH t AS (SELECT conv_id, turn, role, text || ' — &rsquo; ’s' AS said FROM conversations),
        j AS (SELECT q.conv_id, q.turn, '{"@type":"Question","name":' || CAST(to_json(q.said) AS VARCHAR)
          || ',"acceptedAnswer":{"@type":"Answer","text":' || CAST(to_json(coalesce(a.said, '')) AS VARCHAR) || '}}' AS e
          FROM t q LEFT JOIN t a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user')
        SELECT conv_id, '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || string_agg(e, ',' ORDER BY turn) || ']}' AS json
        FROM j GROUP BY conv_id""",
    ),
    "inserted_after": Plan(
        inserted_after,
        f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '<title>', '{NAMED}' || chr(10)
          || '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Person","name":"$1 ' || page_id || '"}}</script><title>') ELSE html END AS html FROM pages""",
    ),
    "faq_upserts": Plan(
        faq_upserts,
        with_sql(
            TRAIL_SQL,
            f"""b AS (SELECT page_id, {_TAG.format('''
                '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || array_to_string(list_transform(n, lambda x:
                '{"@type":"Question","name":"' || x || '?","acceptedAnswer":{"@type":"Answer","text":"$1 ' || x || '"}}'), ',') || ']}'
                ''')} AS tag FROM lists)""",
            select="""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '<title>', tag || '<title>')
              ELSE replace(html, '</head>', tag || chr(10) || '</head>') END AS html FROM pages JOIN b USING (page_id)""",
        ),
    ),
    "service_blocks": Plan(
        services,
        f"""SELECT c_custkey, '{{"@context":"https://schema.org","@type":"Service","serviceType":"Advisory","name":"Example Co for ' || c_mktsegment
          || '","provider":{_ORG},"areaServed":"Everywhere","audience":{{"@type":"BusinessAudience","name":"' || c_name
          || '","audienceType":"Teams in ' || c_mktsegment || '"}},' || CASE WHEN c_custkey % 2 = 0 THEN '"description":"For ' || c_mktsegment || '",' ELSE '' END
          || '"serviceOutput":"Plan","url":"https://site.example/' || lower(c_mktsegment) || '"}}' AS json FROM customer""",
    ),
    "person_blocks": Plan(
        people,
        f"""SELECT c_custkey, '{{"@context":"https://schema.org","@type":"Person","name":"' || c_name || '","jobTitle":"Partner","description":"Knows ' || c_mktsegment
          || '","image":"https://site.example/' || c_custkey || '.webp","url":"https://profiles.example/' || c_custkey || '","sameAs":["https://profiles.example/' || c_custkey
          || '"],"worksFor":{_REF},"knowsAbout":["' || c_mktsegment || '","AI & data"]}}' AS json FROM customer""",
    ),
    "published_dates": Plan(
        published,
        """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '2026-05-' || lpad(CAST(('0x' || substr(sha256(url), 1, 2))::INT % 15 + 1 AS VARCHAR), 2, '0') END AS published FROM pages""",
    ),
}
