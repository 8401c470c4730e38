"""Queries over submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.fixed_values import GOALS, QUESTIONS, TIER_COPY
from sitelode.functions.urls import acquisition_source
from sitelode.operators import scoring
from sitelode.plans.derived import SITE_URL, SUBMISSIONS_SQL, submissions, with_sql
from sitelode.plans.registry import Plan, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def sql_text(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else sql_text(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {columns}"


QUESTION_ROWS = sql_values([(i, d, label, *opts) for i, (d, label, opts) in enumerate(QUESTIONS)], "q(q_idx, dim, label, o0, o1, o2, o3)")
TIER_ROWS = sql_values([(i, *t) for i, t in enumerate(TIER_COPY)], "t(ord, tier, definition, description, next_step, cta, path)")
GOAL_ROWS = sql_values(list(GOALS), "g(letter, phrase)")

FLAGS = ("builder_signal", "connected_automation", "team_leverage", "high_systematization", "governance_opportunity")


def _stamp(c: str) -> Column:
    return F.date_format(c, STAMP).alias(c)


def validated(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("answers")
    return submissions(spark, folder).select(
        "idempotency_id",
        scoring.answers_valid(a).alias("is_valid"),
        scoring.answers_valid(a, null_is_zero=True).alias("is_valid_null_as_zero"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.score_submissions(submissions(spark, folder))
    return out.select(
        "idempotency_id", "total_score", "tier_public", "flags.*", "q12_governance", "next_goal", "quiz_version"
    )


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.completeness(submissions(spark, folder))
    return out.select(
        "idempotency_id",
        F.col("answered"),
        F.array_join(F.transform("unanswered", lambda i: i.cast("string")), ",").alias("unanswered"),
        "first_missing",
    )


def payload(spark: SparkSession, folder: str) -> DataFrame:
    return payload_columns(scoring.submission_payload(submissions(spark, folder)))


def payload_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "idempotency_id",
        "email",
        _stamp("submitted_at"),
        F.array_join(F.transform("answers", lambda x: x.cast("string")), ",").alias("answers"),
        F.array_join("answer_labels", "|").alias("answer_labels"),
        "q12_governance",
        "personal_use",
        "blocked_potential",
        "next_goal",
        "total_score",
        "tier_public",
        "flags.*",
        "quiz_version",
        "source",
    )


def emails(spark: SparkSession, folder: str) -> DataFrame:
    return submissions(spark, folder).select(
        "idempotency_id", scoring.email_valid(F.col("email")).alias("email_valid")
    )


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.dimension_profile(scoring.score_submissions(submissions(spark, folder)))


def tier_results(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.tier_result(scoring.score_submissions(submissions(spark, folder)), SITE_URL)
    return out.select(
        "idempotency_id", "tier_public", "tier_position", "definition", "description", "next_step", "cta", "url"
    )


def goal_sentences(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.goal_reflection(scoring.score_submissions(submissions(spark, folder)))
    return out.select("idempotency_id", "next_goal", "reflection")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", acquisition_source(F.col("url")).alias("source"))


def post_columns(events: DataFrame) -> DataFrame:
    """Every event is a post; user and type make the key, so most posts are repeats."""
    return events.select(
        F.concat_ws("-", "user_id", "event_type").alias("idempotency_id"),
        F.col("ts").cast("timestamp").alias("submitted_at"),
        "event_id",
        "value",
    )


def first_posts(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.first_submissions(post_columns(table(spark, folder, "events"))).select("idempotency_id", "event_id", "value")


def quarantine_columns(rows: DataFrame) -> DataFrame:
    return rows.select("idempotency_id", F.array_join(F.transform("answers", lambda x: x.cast("string")), ",", "-").alias("answers"))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine_columns(scoring.split_valid(submissions(spark, folder))[1])


def update_columns(events: DataFrame) -> DataFrame:
    """Every event is an update of the submission of its user's number; there are blank ones and ones of another kind."""
    text = F.concat(F.lit(" "), "event_type", F.lit(" "), "props", F.lit("\n"))
    return events.select(
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("idempotency_id"),
        F.when(F.col("event_type") == "error", "  \n ").otherwise(text).alias("pain_point_text"),
        F.when(F.col("event_type") == "view", "other").otherwise("pain_point").alias("update"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def pain_points(spark: SparkSession, folder: str) -> DataFrame:
    updates = update_columns(table(spark, folder, "events"))
    return scoring.attach_pain_points(submissions(spark, folder), updates).select("idempotency_id", "pain_point_text")


def unmatched_columns(rows: DataFrame) -> DataFrame:
    return rows.select("idempotency_id", "pain_point_text", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("received_at"))


def unmatched_updates(spark: SparkSession, folder: str) -> DataFrame:
    updates = update_columns(table(spark, folder, "events"))
    return unmatched_columns(scoring.unmatched_updates(submissions(spark, folder), updates))


_OPTION = "CASE a[q_idx + 1] WHEN 0 THEN o0 WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END"
_FLAG_LIST = ", ".join(FLAGS)

_LATEST = """latest AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || user_id AS id,
    arg_max(event_type || ' ' || props, ts) AS txt, max(ts) AS seen FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1)"""

PLANS = {
    "answers_validated": Plan(
        validated,
        with_sql(
            SUBMISSIONS_SQL,
            select="SELECT idempotency_id, c % 17 <> 0 AS is_valid, c % 34 <> 0 AS is_valid_null_as_zero FROM submissions_all",
        ),
    ),
    "submissions_scored": Plan(
        scored,
        with_sql(
            SUBMISSIONS_SQL,
            select=f"SELECT idempotency_id, total_score, tier_public, {_FLAG_LIST}, q12_governance, next_goal, 'v2.1' AS quiz_version FROM scored",
        ),
    ),
    "submissions_completeness": Plan(
        completeness,
        with_sql(
            SUBMISSIONS_SQL,
            select="""
            SELECT idempotency_id,
              CAST(14 - (c % 17 = 0)::INT - (c % 19 = 0)::INT AS INTEGER) AS answered,
              concat_ws(',', CASE WHEN c % 34 = 0 THEN '10' WHEN c % 17 = 0 THEN '5' END, CASE WHEN c % 19 = 0 THEN '11' END) AS unanswered,
              CASE WHEN c % 34 = 0 THEN 10 WHEN c % 17 = 0 THEN 5 WHEN c % 19 = 0 THEN 11 END AS first_missing
            FROM submissions_all""",
        ),
    ),
    "submissions_payload": Plan(
        payload,
        with_sql(
            SUBMISSIONS_SQL,
            f"""labels AS (SELECT idempotency_id, string_agg(dim || ': ' || {_OPTION}, '|' ORDER BY q_idx) AS answer_labels
                FROM submissions CROSS JOIN {QUESTION_ROWS} GROUP BY 1)""",
            select=f"""
            SELECT idempotency_id, email, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at,
              array_to_string(a, ',') AS answers, answer_labels, q12_governance, personal_use,
              personal_use IN ('C', 'D') AND tier_public IN ('Observer', 'Explorer') AS blocked_potential,
              next_goal, total_score, tier_public, {_FLAG_LIST}, 'v2.1' AS quiz_version, source
            FROM scored JOIN labels USING (idempotency_id)""",
        ),
    ),
    "emails_validated": Plan(
        emails,
        with_sql(
            SUBMISSIONS_SQL,
            select=r"""SELECT idempotency_id,
              regexp_matches(trim(email, ' ' || chr(10)), '^[^\s@]+@[^\s@]+\.[^\s@]{2,}$') AS email_valid FROM submissions_all""",
        ),
    ),
    "dimension_profile": Plan(
        profile,
        with_sql(
            SUBMISSIONS_SQL,
            select=f"""
            SELECT idempotency_id, q_idx, label, v AS filled,
              CASE v WHEN 3 THEN 'hi' WHEN 2 THEN 'mid' ELSE 'lo' END AS band,
              CASE WHEN v = 3 THEN 'Strength' WHEN v <= 1 THEN 'Focus' END AS tag
            FROM (SELECT idempotency_id, q_idx, label, a[q_idx + 1] AS v FROM submissions CROSS JOIN {QUESTION_ROWS})""",
        ),
    ),
    "tier_results": Plan(
        tier_results,
        with_sql(
            SUBMISSIONS_SQL,
            select=f"""
            SELECT idempotency_id, tier_public, ord AS tier_position, definition, description, next_step, cta,
              '{SITE_URL}' || path AS url
            FROM scored JOIN {TIER_ROWS} ON tier = tier_public""",
        ),
    ),
    "goal_sentences": Plan(
        goal_sentences,
        with_sql(
            SUBMISSIONS_SQL,
            select=f"""
            SELECT idempotency_id, next_goal, 'You’re currently an <b>' || tier_public || '</b>, and your next goal is <b>' || phrase
              || '</b>. That’s exactly the right kind of gap to work on.' AS reflection
            FROM scored LEFT JOIN {GOAL_ROWS} ON letter = next_goal""",
        ),
    ),
    "acquisition_sources": Plan(
        sources,
        r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), ''), 'direct') AS source FROM pages""",
    ),
    "first_posts": Plan(
        first_posts,
        """SELECT idempotency_id, event_id, value FROM (
             SELECT user_id || '-' || event_type AS idempotency_id, event_id, value,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS rn FROM events) WHERE rn = 1""",
    ),
    "quarantined_submissions": Plan(
        quarantined,
        with_sql(
            SUBMISSIONS_SQL,
            select="SELECT idempotency_id, array_to_string([coalesce(CAST(x AS VARCHAR), '-') FOR x IN a], ',') AS answers FROM submissions_all WHERE c % 17 = 0",
        ),
    ),
    "pain_points": Plan(
        pain_points,
        with_sql(
            SUBMISSIONS_SQL,
            _LATEST,
            select="SELECT idempotency_id, txt AS pain_point_text FROM submissions_all LEFT JOIN latest ON id = idempotency_id",
        ),
    ),
    "unmatched_updates": Plan(
        unmatched_updates,
        with_sql(
            SUBMISSIONS_SQL,
            _LATEST,
            select="""SELECT id AS idempotency_id, txt AS pain_point_text, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS received_at
              FROM latest WHERE id NOT IN (SELECT idempotency_id FROM submissions_all)""",
        ),
    ),
}
