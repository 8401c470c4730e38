"""Inputs derived from the given tables: each as a Spark expression and as the same SQL text.

The tables hold no submissions, clicks or Markdown, so these are computed row by row from what they
do hold. The SQL twins are common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.plans.registry import table

SITE = "site.example"
SITE_URL = "https://site.example"


def minutes_after(day: str, minutes: Column) -> Column:
    """A local time of day, whatever the session's zone."""
    zero = F.lit(0)
    start = F.expr(f"timestamp_ntz'{day} 00:00:00'")
    return (start + F.make_dt_interval(zero, zero, minutes.cast("int"), zero)).cast("timestamp")


def submission_columns(customers: DataFrame) -> DataFrame:
    """One submission per customer; every seventeenth key has a wrong set of answers."""
    answers = F.expr(
        "transform(sequence(0, 10), i -> cast(least(3, "
        "(((c_custkey * (i + 7) * (i + 3) + c_custkey div 7) % 7) * (c_custkey % 3 + 1)) div 4) as int))"
    )
    c = F.col("c_custkey")
    spoiled = (
        F.when((c % 17 == 0) & (c % 2 == 0), F.slice(answers, 1, 10))
        .when(c % 17 == 0, F.transform(answers, lambda x, i: F.when(i != 5, x)))
        .otherwise(answers)
    )
    return customers.select(
        c.cast("string").alias("idempotency_id"),
        F.expr(
            "case when c_custkey % 7 = 0 then concat('no-at-', c_custkey) "
            "when c_custkey % 11 = 0 then ' u@x.y ' "
            "else concat(' u', c_custkey, '@', lower(c_mktsegment), '.example\\n') end"
        ).alias("email"),
        minutes_after("2026-01-01", c).alias("submitted_at"),
        spoiled.alias("answers"),
        F.expr("if(c_custkey % 19 = 0, '', element_at(array('A','B','C','D','E'), cast(c_custkey % 5 + 1 as int)))").alias(
            "q12_governance"
        ),
        F.expr("element_at(array('A','B','C','D'), cast(c_custkey % 4 + 1 as int))").alias("personal_use"),
        F.expr("element_at(array('A','B','C','D','E'), c_nationkey % 5 + 1)").alias("next_goal"),
        F.expr(
            "concat('https://site.example/assessment/', case c_custkey % 4 when 0 then '' "
            "when 1 then concat('?utm_source=', lower(c_mktsegment), '&x=1') "
            "when 2 then '?x=1&utm_source=a%20b+c' else '?utm_source=#utm_source=no' end)"
        ).alias("landing_url"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    return submission_columns(table(spark, folder, "customer"))


SUBMISSIONS_SQL = r"""
submissions_all AS (
  SELECT c_custkey AS c,
    CAST(c_custkey AS VARCHAR) AS idempotency_id,
    CASE WHEN c_custkey % 7 = 0 THEN 'no-at-' || c_custkey
         WHEN c_custkey % 11 = 0 THEN ' u@x.y '
         ELSE ' u' || c_custkey || '@' || lower(c_mktsegment) || '.example' || chr(10) END AS email,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(c_custkey) AS submitted_at,
    list_transform(range(0, CASE WHEN c_custkey % 34 = 0 THEN 10 ELSE 11 END), lambda i:
      CASE WHEN c_custkey % 17 = 0 AND c_custkey % 2 = 1 AND i = 5 THEN NULL
      ELSE CAST(least(3, (((c_custkey * (i + 7) * (i + 3) + c_custkey // 7) % 7) * (c_custkey % 3 + 1)) // 4) AS INTEGER) END) AS a,
    CASE WHEN c_custkey % 19 = 0 THEN '' ELSE substr('ABCDE', CAST(c_custkey % 5 + 1 AS BIGINT), 1) END AS q12_governance,
    substr('ABCD', CAST(c_custkey % 4 + 1 AS BIGINT), 1) AS personal_use,
    substr('ABCDE', CAST(c_nationkey % 5 + 1 AS BIGINT), 1) AS next_goal,
    CASE c_custkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'a b c' ELSE 'direct' END AS source
  FROM customer),
submissions AS (SELECT * FROM submissions_all WHERE c % 17 <> 0),
scored AS (
  SELECT *, CAST(list_sum(a) AS INTEGER) AS total_score,
    CASE WHEN list_sum(a) <= 7 THEN 'Observer' WHEN list_sum(a) <= 16 THEN 'Explorer'
         WHEN list_sum(a) <= 25 THEN 'Operator' ELSE 'Integrator' END AS tier_public,
    a[10] = 3 AND (a[6] >= 2 OR a[7] = 3) AS builder_signal,
    a[6] = 3 AS connected_automation, a[7] = 3 AS team_leverage, a[10] = 3 AS high_systematization,
    q12_governance IN ('B','C','D') AS governance_opportunity
  FROM submissions)
"""

def event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("visitor_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )


# What a click holds, from its kind and number.
CLICK_TEXTS = {
    "href": "case k % 6 when 0 then 'mailto:team@site.example' when 1 then concat('https://partner.example/p', k) "
    "when 2 then concat('/local/', k) when 3 then 'https://SITE.example/x' when 4 then '//cdn.example:8080/y' else '' end",
    "link_text": "concat('  \\nRead  more ', k, repeat('xy', k), '\\t ')",
    "is_link": "event_type = 'click'",
    "is_primary": "value > 10",
    "section_id": "case k % 3 when 0 then 'hero' when 1 then '' end",
}


def click_columns(events: DataFrame) -> DataFrame:
    """Clicks of every kind: mail, foreign host, own host, no link at all."""
    k = F.col("k")
    return events.where(F.col("event_type").isin("click", "error")).select(
        "visitor_id",
        "ts",
        *[F.expr(text).alias(name) for name, text in CLICK_TEXTS.items()],
        F.concat(F.lit(SITE_URL + "/p/"), k % 10, F.lit("?a=1")).alias("page_url"),
        F.concat(F.lit("P"), k % 10).alias("page_title"),
    )


def consent_columns(events: DataFrame) -> DataFrame:
    """Consent records, some of them unreadable."""
    return events.where(F.col("event_type") == "signup").select(
        "visitor_id",
        "ts",
        F.expr(
            """case k % 4 when 0 then '{"necessary":true,"analytics":true}' when 1 then '{"analytics":false}'
               when 2 then 'not json' else '{"analytics":true,"updatedAt":"2024-01-01T00:00:00Z"}' end"""
        ).alias("raw"),
    )


def submit_columns(events: DataFrame) -> DataFrame:
    """Form submits; half of the forms are subscribe forms."""
    k = F.col("k")
    return events.where(F.col("event_type") == "purchase").select(
        "visitor_id",
        "ts",
        (k % 2 == 0).alias("is_subscribe_form"),
        F.expr("case when k % 3 = 0 then concat('v', k, '@mail') else concat(' v', k, '@mail.example ') end").alias("email"),
        F.concat(F.lit(SITE_URL + "/p/"), k % 10).alias("page_url"),
        F.concat(F.lit("P"), k % 10).alias("page_title"),
    )


def interaction_columns(events: DataFrame) -> DataFrame:
    """Clicks and submits in one table, from one pass over the events."""
    k, submit = F.col("k"), F.col("event_type") == "purchase"
    shown = events.where(F.col("event_type").isin("click", "error", "purchase"))
    page = F.concat(F.lit(SITE_URL + "/p/"), k % 10)
    return shown.select(
        "visitor_id",
        "ts",
        *[F.when(~submit, F.expr(text)).alias(name) for name, text in CLICK_TEXTS.items()],
        F.when(submit, k % 2 == 0).alias("is_subscribe_form"),
        F.when(submit, page).otherwise(F.concat(page, F.lit("?a=1"))).alias("page_url"),
        F.concat(F.lit("P"), k % 10).alias("page_title"),
    )


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return click_columns(event_columns(table(spark, folder, "events")))


def consents(spark: SparkSession, folder: str) -> DataFrame:
    return consent_columns(event_columns(table(spark, folder, "events")))


def submits(spark: SparkSession, folder: str) -> DataFrame:
    return submit_columns(event_columns(table(spark, folder, "events")))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    return interaction_columns(event_columns(table(spark, folder, "events")))


EVENTS_SQL = r"""
ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS visitor_id, ts, event_type, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events),
consents AS (SELECT visitor_id, ts, k % 4 IN (0, 3) AS analytics FROM ev WHERE event_type = 'signup'),
clicks AS (
  SELECT visitor_id, ts, k, event_type = 'click' AS is_link, value > 10 AS is_primary,
    CASE k % 6 WHEN 0 THEN 'mailto:team@site.example' WHEN 1 THEN 'https://partner.example/p' || k
      WHEN 2 THEN '/local/' || k WHEN 3 THEN 'https://SITE.example/x' WHEN 4 THEN '//cdn.example:8080/y' ELSE '' END AS href,
    substr('Read  more ' || k || repeat('xy', k), 1, 100) AS link_text,
    CASE WHEN k % 3 = 0 THEN 'hero' ELSE 'unknown' END AS section,
    '/p/' || (k % 10) AS page_path, 'P' || (k % 10) AS page_title
  FROM ev WHERE event_type IN ('click', 'error')),
click_events AS (
  SELECT visitor_id, ts, CASE WHEN k % 6 = 0 THEN 'email_click' ELSE 'outbound_link_click' END AS name,
    href AS link_url, link_text, page_path, page_title, CAST(NULL AS VARCHAR) AS cta_location
  FROM clicks WHERE is_link AND k % 6 IN (0, 1, 4)
  UNION ALL
  SELECT visitor_id, ts, 'cta_click', CASE WHEN is_link THEN href END, link_text, page_path, page_title, section
  FROM clicks WHERE is_primary),
gated AS (
  SELECT e.* FROM click_events e ASOF JOIN consents c ON e.visitor_id = c.visitor_id AND e.ts >= c.ts
  WHERE c.analytics),
all_events AS (
  SELECT * FROM click_events
  UNION ALL
  SELECT visitor_id, ts, 'subscribe_submit', NULL, NULL, '/p/' || (k % 10), 'P' || (k % 10), NULL
  FROM ev WHERE event_type = 'purchase' AND k % 2 = 0),
gated_all AS (
  SELECT e.* FROM all_events e ASOF JOIN consents c ON e.visitor_id = c.visitor_id AND e.ts >= c.ts
  WHERE c.analytics)
"""


# Line starts that become list and heading marks.
MARKS = (("A", "-"), ("T", "1."), ("L", "##"), ("S", "###"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: some line starts become list and heading marks, and each gets front matter."""
    body = F.col("text")
    for letter, mark in MARKS:
        body = F.replace(body, F.lit("\n" + letter), F.lit(f"\n{mark} {letter}"))
    body = F.when(F.contains("text", F.lit("!!")), F.regexp_replace(body, r"([A-Za-z]+)!!", "**$1**")).otherwise(body)
    head = F.concat(
        F.lit('---\ntitle: "Doc: '),
        F.col("doc_id"),
        F.lit('"\ncategory: '),
        F.col("source"),
        F.lit(" \nlang: "),
        F.col("lang"),
        F.lit('\ntitle: "Document & "'),
        F.col("doc_id"),
        F.lit('" "\n'),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.lit('eyebrow: ""\nexcerpt: "Short"\n')),
        F.lit("---\n\n"),
    )
    whole = F.when(F.col("lang") == "de", body).otherwise(F.concat(head, body))
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("slug"), "lang", "source", whole.alias("text")
    )


def _marked_sql() -> str:
    out = "text"
    for letter, mark in MARKS:
        out = f"replace({out}, chr(10) || '{letter}', chr(10) || '{mark} {letter}')"
    return out


MARKDOWN_SQL = rf"""
md AS (
  SELECT doc_id, lang, source, regexp_replace({_marked_sql()}, '([A-Za-z]+)!!', '**\1**', 'g') AS marked
  FROM documents),
docs AS (
  SELECT doc_id, lang, source,
    CASE WHEN lang = 'de' THEN marked
      ELSE regexp_replace(marked, '^[\t\n\v\f\r\x{{20}}\x{{A0}}]+|[\t\n\v\f\r\x{{20}}\x{{A0}}]+\z', '', 'g') END AS body,
    CASE WHEN lang <> 'de' THEN 'Document & "' || doc_id || '"' END AS title
  FROM md)
"""


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one site: file-like paths, and navigation links of several relative and absolute forms."""
    html = F.col("html")
    for letters, target in (
        ("A-M", "../$1.html#top"),
        ("N-Za-f", "./sub/../$1.html?q=1"),
        ("g-m", f"https://{SITE}/$1.html"),
        ("n-s", "$1/"),
    ):
        html = F.regexp_replace(html, f'href="/([{letters}][^"]*)"', f'href="{target}"')
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1), r"(\.html|/)?\z", "")
    return table(spark, folder, "pages").select("page_id", F.concat(path, F.lit(".html")).alias("path"), html.alias("html"))


SITE_PAGES_SQL = r"""
site AS (
  SELECT page_id, url, html AS raw,
    regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '(\.html|/)$', '') || '.html' AS path,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      'href="/([A-M][^"]*)"', 'href="../\1.html#top"', 'g'),
      'href="/([N-Za-f][^"]*)"', 'href="./sub/../\1.html?q=1"', 'g'),
      'href="/([g-m][^"]*)"', 'href="https://site.example/\1.html"', 'g'),
      'href="/([n-s][^"]*)"', 'href="\1/"', 'g') AS html
  FROM pages),
folders AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder FROM site)
"""

IMG = '<li><img src="/assets/$1.png" alt="$1" loading="lazy"><a href="/$1">'


def image_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with an image in front of every navigation link."""
    html = F.regexp_replace("html", r'<li><a href="/([^"]*)">', IMG)
    return table(spark, folder, "pages").select("page_id", "url", html.alias("html"))


IMAGE_PAGES_SQL = r"""
image_pages AS (
  SELECT page_id, url, html AS raw,
    regexp_replace(html, '<li><a href="/([^"]*)">', '<li><img src="/assets/\1.png" alt="\1" loading="lazy"><a href="/\1">', 'g') AS html
  FROM pages)
"""


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Assets on disk: most of the names that links use, by a hash of the name, and one no page refers to per host."""
    names = F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"')), lambda n: F.left(F.md5(n), F.lit(1)) < "b")
    linked = F.transform(names, lambda n: F.concat(F.lit("/assets/"), n, F.lit(".png")))
    spare = F.concat(F.lit("/assets/insights/"), F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("-card.png"))
    found = table(spark, folder, "pages").select(F.explode(F.concat(linked, F.array(spare))).alias("path"), F.length("html").cast("bigint").alias("size"))
    return (
        found.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg((F.max("size") * 170).alias("length"))
        .withColumn("width", (F.col("length") % 1900 + 1).cast("int"))
        .withColumn("height", (F.col("length") % 1000 + 1).cast("int"))
    )


INVENTORY_SQL = r"""
inventory AS (
  SELECT path, max(size) * 170 AS length, CAST(max(size) * 170 % 1900 + 1 AS INTEGER) AS width,
    CAST(max(size) * 170 % 1000 + 1 AS INTEGER) AS height
  FROM (
    SELECT '/assets/' || name || '.png' AS path, size
      FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name, length(html) AS size FROM pages) WHERE left(md5(name), 1) < 'b'
    UNION ALL
    SELECT '/assets/insights/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '-card.png', length(html) FROM pages)
  WHERE path IS NOT NULL GROUP BY path)
"""


def with_sql(*parts: str, select: str) -> str:
    """A query over some of the common table expressions above."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
