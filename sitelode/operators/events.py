"""Consent-gated web events: classification of clicks and submits, and the consent gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import browser_trim
from sitelode.functions.urls import is_external, url_path
from sitelode.operators.scoring import email_valid
from sitelode.operators.timeline import filled_forward
from sitelode.schemas import CONSENT_BODY

MAX_LINK_TEXT = 100

EVENT_FIELDS = ("name", "link_url", "link_text", "page_path", "page_title", "cta_location")


def link_text(c: Column) -> Column:
    return F.substring(browser_trim(F.coalesce(c, F.lit(""))), 1, MAX_LINK_TEXT)


def cta_location(section_id: Column) -> Column:
    return F.coalesce(F.nullif(section_id, F.lit("")), F.lit("unknown"))


def normalise_consent(consents: DataFrame) -> DataFrame:
    """``necessary`` is always true, ``analytics`` where the record holds a value that counts as true.

    As in a browser that is any value but false, zero, an empty text and null; a text that says false or zero counts as
    false, too. Unreadable JSON is no consent.
    """
    said = F.from_json("raw", CONSENT_BODY)["analytics"]
    given = ~F.rlike(said, F.lit(r"^(false|-?0+(\.0*)?([eE].*)?|)\z"))
    return consents.select(
        "visitor_id",
        "ts",
        F.lit(True).alias("necessary"),
        F.coalesce(given, F.lit(False)).alias("analytics"),
        F.col("ts").alias("updated_at"),
    )


def link_kind(href: Column, page_url: Column) -> Column:
    """``email_click``, ``outbound_link_click`` or null."""
    return F.when(F.startswith(href, F.lit("mailto:")), "email_click").when(
        is_external(href, page_url), "outbound_link_click"
    )


def classify_clicks(clicks: DataFrame) -> DataFrame:
    """Zero, one or two events per click: the kind of link, and a call to action on a primary button.

    Row-local, so it runs unchanged on a stream.
    """
    is_link = F.coalesce(F.col("is_link"), F.lit(False))
    href = F.coalesce(F.col("href"), F.lit(""))
    names = F.array(
        F.when(is_link, link_kind(href, F.col("page_url"))),
        F.when(F.col("is_primary"), "cta_click"),
    )
    return clicks.select("*", F.explode(F.array_compact(names)).alias("name")).select(
        "visitor_id",
        "ts",
        "name",
        F.when(is_link, href).alias("link_url"),
        link_text(F.col("link_text")).alias("link_text"),
        url_path(F.col("page_url")).alias("page_path"),
        "page_title",
        F.when(F.col("name") == "cta_click", cta_location(F.col("section_id"))).alias("cta_location"),
    )


def classify_submits(submits: DataFrame) -> DataFrame:
    """``subscribe_submit`` for forms marked as subscribe forms."""
    none = F.lit(None).cast("string")
    return submits.where(F.coalesce(F.col("is_subscribe_form"), F.lit(False))).select(
        "visitor_id",
        "ts",
        F.lit("subscribe_submit").alias("name"),
        none.alias("link_url"),
        none.alias("link_text"),
        url_path(F.col("page_url")).alias("page_path"),
        "page_title",
        none.alias("cta_location"),
    )


def subscription_requests(submits: DataFrame) -> DataFrame:
    """A request row for each subscribe form sent with a valid e-mail address."""
    return submits.where(F.coalesce(F.col("is_subscribe_form"), F.lit(False)) & email_valid(F.col("email"))).select(
        "visitor_id", "ts", browser_trim(F.col("email")).alias("email")
    )


def gate_by_consent(events: DataFrame, consents: DataFrame) -> DataFrame:
    """Events whose visitor's latest consent at that time allows analytics.

    A consent counts from its own instant on; of two at one instant the refusal counts. Consents and events are one
    timeline, sorted by visitor and time over all partitions, and each partition takes over the last state of its first
    visitor from those before it: one shuffle of the rows, whatever a visitor holds. Equal events are told apart by a hash, so
    that even one instant may be cut. Rows without a visitor or a time are not let through.
    """
    own = F.struct(*events.columns)
    none = F.lit(None)
    known = F.col("visitor_id").isNotNull() & F.col("ts").isNotNull()
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    # At one instant: allowed, refused, then the events.
    rank = F.when(F.coalesce(F.col("analytics"), F.lit(False)), 0).otherwise(1)
    given = consents.where(known).select(
        "visitor_id", at, rank.alias("rank"), F.lit(0).cast("long").alias("tie"), F.coalesce("analytics", F.lit(False)).alias("allowed"), none.cast(events.select(own.alias("e")).schema["e"].dataType).alias("event")
    )
    shown = events.where(known).select("visitor_id", at, F.lit(2).alias("rank"), F.xxhash64(*events.columns).alias("tie"), none.cast("boolean").alias("allowed"), own.alias("event"))
    timeline = filled_forward(shown.unionByName(given), "visitor_id", ["at", "rank", "tie"], "allowed")
    return timeline.where("event IS NOT NULL AND allowed").select("event.*")


def classify(interactions: DataFrame) -> DataFrame:
    """Events of clicks and submits in one table, as ``classify_clicks`` and ``classify_submits`` find them in two.

    A submit has a value in ``is_subscribe_form``, a click has none.
    """
    submit = F.col("is_subscribe_form").isNotNull()
    is_link = F.coalesce(F.col("is_link"), F.lit(False))
    href = F.coalesce(F.col("href"), F.lit(""))
    clicked = F.array(F.when(is_link, link_kind(href, F.col("page_url"))), F.when(F.col("is_primary"), "cta_click"))
    names = F.when(submit, F.array(F.when(F.col("is_subscribe_form"), F.lit("subscribe_submit")))).otherwise(clicked)
    return interactions.select("*", F.explode(F.array_compact(names)).alias("name")).select(
        "visitor_id",
        "ts",
        "name",
        F.when(~submit & is_link, href).alias("link_url"),
        F.when(~submit, link_text(F.col("link_text"))).alias("link_text"),
        url_path(F.col("page_url")).alias("page_path"),
        "page_title",
        F.when(F.col("name") == "cta_click", cta_location(F.col("section_id"))).alias("cta_location"),
    )


def event_job(interactions: DataFrame, consents: DataFrame) -> DataFrame:
    """All events of clicks and submits that consent allows."""
    return gate_by_consent(classify(interactions), consents)
