"""Queries over clicks, submits and consent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators import events
from sitelode.plans.derived import EVENTS_SQL, clicks, consents, interactions, submits, with_sql
from sitelode.plans.registry import Plan, table

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
ANCHOR = r'<a\b[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", MICROS))


def consent_records(spark: SparkSession, folder: str) -> DataFrame:
    out = events.normalise_consent(consents(spark, folder))
    return stamped(out).select("visitor_id", "ts", "necessary", "analytics")


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    return stamped(events.classify_clicks(clicks(spark, folder)))


def page_link_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Every anchor of every page, as if it had been clicked."""
    anchors = table(spark, folder, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("pos", "_a")
    )
    href = F.regexp_extract("_a", ANCHOR, 1)
    # Every other page is taken as hosted elsewhere, which makes its rooted links foreign.
    absolute = F.when(F.col("page_id") % 2 == 0, href).otherwise(F.concat(F.lit("https://www.thther.example.org"), href))
    return anchors.select(
        "page_id",
        "pos",
        F.coalesce(events.link_kind(absolute, F.col("url")), F.lit("internal")).alias("kind"),
        events.link_text(F.regexp_extract("_a", ANCHOR, 2)).alias("link_text"),
    )


def gated_events(spark: SparkSession, folder: str) -> DataFrame:
    allowed = events.normalise_consent(consents(spark, folder))
    return stamped(events.gate_by_consent(events.classify_clicks(clicks(spark, folder)), allowed))


def event_totals(spark: SparkSession, folder: str) -> DataFrame:
    allowed = events.normalise_consent(consents(spark, folder))
    gated = events.event_job(interactions(spark, folder), allowed)
    return gated.groupBy("name", "page_path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("visitor_id").alias("visitors")
    )


def subscribe_submits(spark: SparkSession, folder: str) -> DataFrame:
    out = events.classify_submits(submits(spark, folder))
    return stamped(out).select("visitor_id", "ts", "name", "page_path", "page_title")


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return stamped(events.subscription_requests(submits(spark, folder)))


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"
_COLS = "name, link_url, link_text, page_path, page_title, cta_location"

PLANS = {
    "consent_records": Plan(
        consent_records,
        with_sql(EVENTS_SQL, select=f"SELECT visitor_id, {_TS}, true AS necessary, analytics FROM consents"),
    ),
    "click_events": Plan(
        click_events, with_sql(EVENTS_SQL, select=f"SELECT visitor_id, {_TS}, {_COLS} FROM click_events")
    ),
    "page_link_clicks": Plan(
        page_link_clicks,
        r"""
        SELECT page_id, CAST(pos AS INTEGER) AS pos,
          CASE WHEN page_id % 2 = 1 AND regexp_extract(url, '^https?://([^/]+)', 1) <> 'www.thther.example.org'
            THEN 'outbound_link_click' ELSE 'internal' END AS kind,
          trim(regexp_extract(a, '>([^<]*)<', 1)) AS link_text
        FROM (SELECT page_id, url, unnest(l) AS a, unnest(range(len(l))) AS pos
              FROM (SELECT page_id, url, regexp_extract_all(html, '<a\b[^>]*href="[^"]*"[^>]*>[^<]*</a>') AS l FROM pages))""",
    ),
    "gated_events": Plan(
        gated_events, with_sql(EVENTS_SQL, select=f"SELECT visitor_id, {_TS}, {_COLS} FROM gated")
    ),
    "event_totals": Plan(
        event_totals,
        with_sql(
            EVENTS_SQL,
            select="SELECT name, page_path, count(*) AS n, count(DISTINCT visitor_id) AS visitors FROM gated_all GROUP BY 1, 2",
        ),
    ),
    "subscribe_submits": Plan(
        subscribe_submits,
        with_sql(
            EVENTS_SQL,
            select=f"""SELECT visitor_id, {_TS}, 'subscribe_submit' AS name, '/p/' || (k % 10) AS page_path,
              'P' || (k % 10) AS page_title FROM ev WHERE event_type = 'purchase' AND k % 2 = 0""",
        ),
    ),
    "subscription_requests": Plan(
        subscriptions,
        with_sql(
            EVENTS_SQL,
            select=f"""SELECT visitor_id, {_TS}, 'v' || k || '@mail.example' AS email
              FROM ev WHERE event_type = 'purchase' AND k % 2 = 0 AND k % 3 <> 0""",
        ),
    ),
}
