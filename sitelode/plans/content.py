"""Queries over Markdown documents and article series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.text import escape_html
from sitelode.operators import content
from sitelode.plans.derived import MARKDOWN_SQL, markdown, with_sql
from sitelode.plans.registry import Plan, table

HUB = dict(hub_title="All conversations", hub_href="series.html", all_title="Explore the Full Series")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return content.front_matter(markdown(spark, folder))


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark, folder).select(
        "doc_id",
        F.size("meta").alias("n_keys"),
        F.try_element_at("meta", F.lit("title")).alias("title"),
        F.try_element_at("meta", F.lit("category")).alias("category"),
        "body",
    )


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    alts = table(spark, folder, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.concat(F.lit("Picture "), "doc_id").alias("alt"))
    out = content.with_image_alt(content.article_metadata(parsed(spark, folder)), alts)
    return out.select("doc_id", "title", "eyebrow", "format", "deck", "description", "image_alt")


def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose slug is on the list of good ones, and those that are not found."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("slug"))
    slugs = table(spark, folder, "labels").where("quality = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("slug"))
    found = content.allowed_documents(docs, slugs).withColumn("status", F.lit("found"))
    return found.unionByName(content.unknown_documents(docs, slugs).withColumn("status", F.lit("not_found")))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return content.markdown_blocks(parsed(spark, folder), ["doc_id"])


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark, folder).select("doc_id", content.render_body(F.col("body")).alias("html"))


def escaped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


def article_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Asset path, audio type and call to action, from the parts of each page's address."""
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    ref = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit(".././"), path))
        .when(F.col("page_id") % 4 == 2, path)
    )
    audio = F.when(F.col("page_id") % 3 == 0, F.concat(path, F.lit(".M4A"))).when(F.col("page_id") % 3 == 1, path).otherwise("")
    label = F.when(F.col("page_id") % 2 == 0, "Talk").otherwise("")
    href = F.when(F.col("page_id") % 6 == 0, "")
    return table(spark, folder, "pages").select(
        "page_id",
        content.resolve_asset(ref).alias("asset"),
        content.audio_type(audio).alias("audio_type"),
        content.cta_href(label, F.coalesce(href, path), "mailto:team@site.example").alias("cta"),
    )


def series(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("title"),
        F.concat_ws("-", F.lit("part"), "conv_id", F.concat("turn", F.lit(".html"))).alias("href"),
    )
    # Short chunks, so that small tables have neighbours across chunks.
    return content.series_navigation(parts, ["conv_id"], "turn", labels=("Series", "Before", "After"), chunk=3, **HUB)


def navigation(spark: SparkSession, folder: str) -> DataFrame:
    return series(spark, folder).select(
        "conv_id", "turn", "prev_label", "prev_title", "prev_href", "next_label", "next_title", "next_href"
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return content.series_cards(series(spark, folder)).select("conv_id", "turn", "title", "card")


def series_bodies(spark: SparkSession, folder: str) -> DataFrame:
    body = F.split("text", "\n", -1)
    return table(spark, folder, "documents").select(
        "doc_id", content.render_series_body(body, F.col("source")).alias("html")
    )


def series_parts(spark: SparkSession, folder: str) -> DataFrame:
    body = F.split("text", "\n", -1)
    boxes = content.Aside('<aside class="advice">', "What to do"), content.Aside('<aside class="faults">', "What goes wrong")
    diagnostic = F.array("lang", F.concat(F.lit("<"), "source"))
    return table(spark, folder, "documents").select(
        "doc_id", content.render_series_part(body, F.col("source"), F.concat("lang", F.lit(" & more")), diagnostic, boxes).alias("html")
    )


def prerendered(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the rendered document of the same number as their article; some were done before."""
    marked = F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<article>"), F.lit("<article><!--PRERENDERED-->")))
    pages = table(spark, folder, "pages").select("page_id", F.coalesce(marked, "html").alias("html"))
    # Every other page has no document.
    docs = content.awaited(markdown(spark, folder).withColumn("page_id", F.col("doc_id") * 2), pages, "page_id")
    bodies = content.front_matter(docs).select("page_id", content.render_body(F.col("body")).alias("rendered"))
    return content.prerender(pages, bodies, "page_id", tag="article").select("page_id", "status", "html_new")


def facets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("Field "), "source", F.lit(" & "), F.upper("lang")).alias("facet")
    )
    return content.facet_counts(docs, "facet")


# Lines, their kind and their text.
LINES_SQL = r"""
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
          FROM (SELECT doc_id, regexp_split_to_array(body, '\r?\n') AS l FROM docs)),
kinds AS (
  SELECT doc_id, i, line,
    CASE WHEN line LIKE '- %' THEN 'ul'
      WHEN regexp_matches(line, '^\d+\.[\s\x{A0}]+[^\n\r]+$') THEN 'ol'
      WHEN regexp_matches(line, '^[\s\x{A0}]*$') THEN 'blank'
      WHEN line LIKE '### %' THEN 'h3' WHEN line LIKE '## %' THEN 'h2' ELSE 'p' END AS kind
  FROM lines),
items AS (
  SELECT doc_id, i, kind,
    CASE kind WHEN 'ul' THEN substr(line, 3) WHEN 'ol' THEN regexp_extract(line, '^\d+\.[\s\x{A0}]+(.+)$', 1)
      WHEN 'h3' THEN substr(line, 5) WHEN 'h2' THEN substr(line, 4) ELSE line END AS item,
    CASE WHEN kind IN ('ul', 'ol') AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS starts
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
blocks AS (
  SELECT doc_id, kind, item, i,
    CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_id
  FROM items WHERE kind <> 'blank'),
html AS (
  SELECT doc_id, coalesce(string_agg(b, chr(10) ORDER BY block_id), '') AS html FROM (
    SELECT doc_id, block_id,
      CASE WHEN kind IN ('ul', 'ol') THEN '<' || kind || '>' || string_agg('<li>' || t || '</li>', '' ORDER BY i) || '</' || kind || '>'
        ELSE '<' || kind || '>' || string_agg(t, '') || '</' || kind || '>' END AS b
    FROM (SELECT *, regexp_replace(replace(replace(replace(replace(replace(item, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
            '"', '&quot;'), '''', '&#039;'), '\*\*([^\n\r]+?)\*\*', '<strong>\1</strong>', 'g') AS t FROM blocks)
    GROUP BY doc_id, block_id, kind) GROUP BY doc_id)
"""

ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"

_SERIES = """
w AS (SELECT conv_id, turn, text AS title, 'part-' || conv_id || '-' || turn || '.html' AS href FROM conversations),
nav AS (SELECT conv_id, turn, title,
  lag(title) OVER o AS pt, lag(href) OVER o AS ph, lead(title) OVER o AS nt, lead(href) OVER o AS nh,
  row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
"""

PLANS = {
    "front_matter": Plan(
        front_matter,
        with_sql(
            MARKDOWN_SQL,
            select="""SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 3 ELSE 5 END AS n_keys, title,
              CASE WHEN lang <> 'de' THEN source END AS category, body FROM docs""",
        ),
    ),
    "article_metadata": Plan(
        metadata,
        with_sql(
            MARKDOWN_SQL,
            select="""SELECT doc_id, coalesce(title, '') AS title, CASE WHEN lang = 'de' THEN '' ELSE source END AS eyebrow, '' AS format,
              CASE WHEN lang IN ('de', 'en') THEN '' ELSE 'Short' END AS deck,
              CASE WHEN lang IN ('de', 'en') THEN '' ELSE 'Short' END AS description,
              CASE WHEN l.doc_id IS NOT NULL THEN 'Picture ' || l.doc_id ELSE coalesce(title, '') END AS image_alt
              FROM docs LEFT JOIN labels l USING (doc_id)""",
        ),
    ),
    "document_status": Plan(
        document_status,
        """SELECT doc_id, 'doc-' || doc_id AS slug, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
             THEN 'found' ELSE 'not_found' END AS status FROM documents""",
    ),
    "markdown_blocks": Plan(
        blocks,
        with_sql(
            MARKDOWN_SQL,
            LINES_SQL,
            select="""SELECT doc_id, block_id,
              CAST(row_number() OVER (PARTITION BY doc_id, block_id ORDER BY i) - 1 AS INTEGER) AS pos, kind, item FROM blocks""",
        ),
    ),
    "rendered_bodies": Plan(
        rendered,
        with_sql(
            MARKDOWN_SQL,
            LINES_SQL,
            select="SELECT doc_id, coalesce(html, '') AS html FROM docs LEFT JOIN html USING (doc_id)",
        ),
    ),
    "escaped_pages": Plan(escaped, f"SELECT page_id, {ESCAPE.format('html')} AS escaped FROM pages"),
    "article_parts": Plan(
        article_parts,
        r"""
        WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        SELECT page_id,
          CASE page_id % 4 WHEN 0 THEN url WHEN 3 THEN NULL ELSE '../' || ltrim(path, '/') END AS asset,
          CASE page_id % 3 WHEN 0 THEN 'audio/mp4' WHEN 1 THEN CASE WHEN path <> '' THEN 'audio/mpeg' END END AS audio_type,
          CASE WHEN page_id % 6 = 0 THEN 'mailto:team@site.example' WHEN page_id % 2 = 0 THEN path END AS cta
        FROM p""",
    ),
    "series_navigation": Plan(
        navigation,
        with_sql(
            _SERIES,
            select="""SELECT conv_id, turn,
              CASE WHEN pos = 1 THEN 'Series' ELSE 'Before' END AS prev_label,
              CASE WHEN pos = 1 THEN 'All conversations' ELSE pt END AS prev_title,
              CASE WHEN pos = 1 THEN 'series.html' ELSE ph END AS prev_href,
              CASE WHEN pos = n THEN 'Series' ELSE 'After' END AS next_label,
              CASE WHEN pos = n THEN 'Explore the Full Series' ELSE nt END AS next_title,
              CASE WHEN pos = n THEN 'series.html' ELSE nh END AS next_href FROM nav""",
        ),
    ),
    "series_cards": Plan(
        cards, with_sql(_SERIES, select="SELECT conv_id, turn, title, 'Part ' || pos || ' of ' || n AS card FROM nav")
    ),
    "series_bodies": Plan(
        series_bodies,
        f"""
        WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents),
        e AS (SELECT doc_id, '<blockquote>' || source || '</blockquote>' AS q,
          list_transform(p, lambda x: '<p>' || {ESCAPE.format('x')} || '</p>') AS p FROM l)
        SELECT doc_id, array_to_string(p[1:5], '') || q || array_to_string(p[6:], '') AS html FROM e""",
    ),
    "series_parts": Plan(
        series_parts,
        f"""
        WITH l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents),
        e AS (SELECT doc_id, '<blockquote>' || source || '</blockquote>' AS q, lang, source,
          list_transform(p, lambda x: '<p>' || {ESCAPE.format('x')} || '</p>') AS p FROM l)
        SELECT doc_id, array_to_string(p[1:5], '') || q || array_to_string(p[6:], '')
          || '<aside class="advice"><h2>What to do</h2><p>' || lang || ' &amp; more</p></aside>'
          || '<aside class="faults"><h2>What goes wrong</h2><ul><li>' || lang || '</li><li>&lt;' || source || '</li></ul></aside>' AS html FROM e""",
    ),
    "prerendered_pages": Plan(
        prerendered,
        with_sql(
            MARKDOWN_SQL,
            LINES_SQL,
            """pg AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<article>', '<article><!--PRERENDERED-->') ELSE html END AS html FROM pages),
            ren AS (SELECT doc_id, coalesce(html, '') AS body FROM docs LEFT JOIN html USING (doc_id))""",
            select="""SELECT page_id,
              CASE WHEN page_id % 5 = 0 THEN 'already' WHEN body IS NULL THEN 'no_body' ELSE 'updated' END AS status,
              CASE WHEN page_id % 5 = 0 OR body IS NULL THEN pg.html
                ELSE substr(pg.html, 1, strpos(pg.html, '<article>') + 8) || chr(10) || '<!--PRERENDERED-->' || chr(10) || body || chr(10)
                  || substr(pg.html, strpos(pg.html, '</article>')) END AS html_new
              FROM pg LEFT JOIN ren ON doc_id * 2 = page_id""",
        ),
    ),
    "facet_counts": Plan(
        facets,
        """SELECT 'Field ' || source || ' & ' || upper(lang) AS facet, count(*) AS n,
             'field-' || source || '-' || lang AS slug FROM documents GROUP BY source, lang""",
    ),
}
