"""Scoring and segmenting of questionnaire submissions. Everything but deduplication is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.fixed_values import GOAL_SENTENCE, MAX_ANSWER, N_QUESTIONS, QUESTIONS, QUIZ_VERSION, TIERS
from sitelode.functions.text import BROWSER_SPACE, browser_trim
from sitelode.functions.urls import acquisition_source
from sitelode.sources import dimensions

EMAIL_PATTERN = rf"^[^{BROWSER_SPACE}@]+@[^{BROWSER_SPACE}@]+\.[^{BROWSER_SPACE}@]{{2,}}\z"


def answers_valid(answers: Column, null_is_zero: bool = False) -> Column:
    """Eleven answers, each 0 to 3. A null answer is invalid unless it is to count as 0."""
    in_range = F.forall(answers, lambda x: F.coalesce(x.between(0, MAX_ANSWER), F.lit(null_is_zero)))
    return F.coalesce((F.size(answers) == N_QUESTIONS) & in_range, F.lit(False))


def total_score(answers: Column) -> Column:
    return F.aggregate(answers, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))


def tier_of(total: Column) -> Column:
    tier = F.when(total <= TIERS[0][1], TIERS[0][0])
    for name, top in TIERS[1:-1]:
        tier = tier.when(total <= top, name)
    return tier.when(total.isNotNull(), TIERS[-1][0])


def tier_position(tier: Column) -> Column:
    """Position in the tier order, -1 for an unknown tier."""
    order = F.array(*[F.lit(name) for name, _ in TIERS])
    return (F.coalesce(F.array_position(order, tier), F.lit(0)) - 1).cast("int")


def segment_flags(answers: Column, governance: Column) -> Column:
    q6, q7, q10 = (F.get(answers, i) for i in (5, 6, 9))

    def flag(condition: Column, name: str) -> Column:
        return F.coalesce(condition, F.lit(False)).alias(name)

    return F.struct(
        flag((q10 == 3) & (F.coalesce(q6 >= 2, F.lit(False)) | F.coalesce(q7 == 3, F.lit(False))), "builder_signal"),
        flag(q6 == 3, "connected_automation"),
        flag(q7 == 3, "team_leverage"),
        flag(q10 == 3, "high_systematization"),
        flag(governance.isin("B", "C", "D"), "governance_opportunity"),
    )


def blocked_potential(personal_use: Column, tier: Column) -> Column:
    return F.coalesce(personal_use.isin("C", "D") & tier.isin("Observer", "Explorer"), F.lit(False))


def email_valid(email: Column) -> Column:
    return F.coalesce(F.rlike(browser_trim(email), F.lit(EMAIL_PATTERN)), F.lit(False))


def answer_labels(answers: Column) -> Column:
    """``"dimension: chosen option"`` per question, in question order.

    The question table is small and fixed, so it is a literal in the expression rather than a join.
    """
    table = F.array(
        *[
            F.struct(F.lit(dim).alias("dim"), F.array(*[F.lit(o) for o in opts]).alias("opts"))
            for dim, _, opts in QUESTIONS
        ]
    )
    return F.zip_with(
        table, answers, lambda q, a: F.concat(q["dim"], F.lit(": "), F.coalesce(F.get(q["opts"], a), F.lit("undefined")))
    )


def split_valid(submissions: DataFrame, null_is_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid submissions, and the rest for quarantine."""
    ok = answers_valid(F.col("answers"), null_is_zero)
    return submissions.where(ok), submissions.where(~ok)


def require_valid(submissions: DataFrame, null_is_zero: bool = False) -> DataFrame:
    """Fail the job on the first invalid submission."""
    a = F.col("answers")
    wrong_shape = F.coalesce(F.size(a) != N_QUESTIONS, F.lit(True))
    checked = (
        F.when(wrong_shape, F.raise_error(F.lit(f"expected {N_QUESTIONS} scored answers")))
        .when(~answers_valid(a, null_is_zero), F.raise_error(F.lit(f"answers must be integers 0 to {MAX_ANSWER}")))
        .otherwise(a)
    )
    return submissions.withColumn("answers", checked)


def score_submissions(submissions: DataFrame, null_is_zero: bool = False) -> DataFrame:
    """Score record of every valid submission. Invalid ones are left to ``split_valid``."""
    valid, _ = split_valid(submissions, null_is_zero)
    a = F.col("answers")
    return (
        valid.withColumn("total_score", total_score(a))
        .withColumn("tier_public", tier_of(F.col("total_score")))
        .withColumn("flags", segment_flags(a, F.col("q12_governance")))
        .withColumn("quiz_version", F.lit(QUIZ_VERSION))
    )


def submission_payload(submissions: DataFrame) -> DataFrame:
    """The full stored record: scores, labels, segmentation and acquisition source."""
    return score_submissions(submissions).select(
        "idempotency_id",
        "email",
        "submitted_at",
        "answers",
        answer_labels(F.col("answers")).alias("answer_labels"),
        "q12_governance",
        "personal_use",
        blocked_potential(F.col("personal_use"), F.col("tier_public")).alias("blocked_potential"),
        "next_goal",
        "total_score",
        "tier_public",
        "flags",
        "quiz_version",
        acquisition_source(F.col("landing_url")).alias("source"),
    )


def completeness(submissions: DataFrame) -> DataFrame:
    """Answered count, open question indexes and the first open one, over all fourteen questions.

    Each answer has its place, so a short or null array leaves the places behind it open.
    """
    places = F.sequence(F.lit(0), F.lit(N_QUESTIONS - 1))
    answers = F.transform(places, lambda i: F.get("answers", i).cast("string"))
    letters = F.array(*[F.nullif(F.col(c), F.lit("")) for c in ("q12_governance", "personal_use", "next_goal")])
    slots = F.concat(answers, letters)
    open_idx = F.filter(
        F.transform(slots, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull()
    )
    return submissions.withColumns(
        {
            "answered": F.size(F.filter(slots, lambda x: x.isNotNull())),
            "unanswered": open_idx,
            "first_missing": F.array_min(open_idx),
        }
    )


def dimension_profile(scored: DataFrame) -> DataFrame:
    """One row per submission and question: label, filled cells, band and tag."""
    spark = scored.sparkSession
    v = F.col("value")
    cells = scored.select("idempotency_id", F.posexplode("answers").alias("q_idx", "value"))
    return cells.join(F.broadcast(dimensions.questions(spark)), "q_idx", "left").select(
        "idempotency_id",
        "q_idx",
        F.coalesce("label", "dim").alias("label"),
        v.alias("filled"),
        F.when(v == 3, "hi").when(v == 2, "mid").otherwise("lo").alias("band"),
        F.when(v == 3, "Strength").when(v <= 1, "Focus").alias("tag"),
    )


def tier_result(scored: DataFrame, site_origin: str = "") -> DataFrame:
    """Result copy and position of the tier."""
    copy = dimensions.tiers(scored.sparkSession, site_origin).withColumnRenamed("tier", "tier_public")
    return scored.join(F.broadcast(copy.drop("max_total", "ord")), "tier_public", "left").withColumn(
        "tier_position", tier_position(F.col("tier_public"))
    )


def goal_reflection(scored: DataFrame) -> DataFrame:
    """Sentence naming tier and next goal; null where the goal has no phrase."""
    phrases = dimensions.goals(scored.sparkSession).withColumnRenamed("letter", "next_goal")
    sentence = F.concat(
        F.lit(GOAL_SENTENCE[0]),
        F.col("tier_public"),
        F.lit(GOAL_SENTENCE[1]),
        F.col("phrase"),
        F.lit(GOAL_SENTENCE[2]),
    )
    return scored.join(F.broadcast(phrases), "next_goal", "left").withColumn("reflection", sentence)


def first_submissions(submissions: DataFrame, order: tuple[str, ...] = ("submitted_at",)) -> DataFrame:
    """One record per idempotency key: the earliest.

    An aggregate, not a ranking window: partial results are merged before the shuffle, so a key
    retried without end costs one row per task.
    """
    whole = F.struct(*submissions.columns)
    ordering = F.struct(*[F.col(c) for c in order], F.xxhash64(*submissions.columns))
    return (
        submissions.groupBy("idempotency_id")
        .agg(F.min_by(whole, ordering).alias("first"))
        .select("first.*")
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """``idempotency_id, pain_point_text, received_at``: the latest non-blank partial update of each key."""
    text = browser_trim(F.col("pain_point_text"))
    filled = updates.where((F.col("update") == "pain_point") & (text != ""))
    latest = filled.groupBy("idempotency_id").agg(F.max(F.struct("received_at", text.alias("text"))).alias("u"))
    return latest.select("idempotency_id", F.col("u.text").alias("pain_point_text"), "u.received_at")


def attach_pain_points(submissions: DataFrame, updates: DataFrame) -> DataFrame:
    """Left join of the latest non-blank partial update to its submission."""
    return submissions.join(latest_updates(updates).drop("received_at"), "idempotency_id", "left")


def unmatched_updates(submissions: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest update of each key that no submission has."""
    return latest_updates(updates).join(submissions.select("idempotency_id"), "idempotency_id", "left_anti")
