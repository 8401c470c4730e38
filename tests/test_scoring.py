from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelode.operators import scoring
from sitelode.schemas import SUBMISSION


def rows(spark, *answers, q12="B"):
    data = [(str(i), "a@b.cd", None, a, q12, "C", "A", None) for i, a in enumerate(answers)]
    return spark.createDataFrame(data, SUBMISSION)


def spread_total(total):
    return [min(3, max(0, total - 3 * i)) for i in range(11)]


@pytest.mark.parametrize(
    "total,tier",
    [(0, "Observer"), (7, "Observer"), (8, "Explorer"), (16, "Explorer"), (17, "Operator"), (25, "Operator"), (26, "Integrator"), (33, "Integrator")],
)
def test_tier_boundaries(spark, total, tier):
    row = scoring.score_submissions(rows(spark, spread_total(total))).first()
    assert (row.total_score, row.tier_public) == (total, tier)


def test_invalid_answers_are_set_apart(spark):
    good = [1] * 11
    bad = [[1] * 10, [1] * 12, [1] * 10 + [4], [1] * 10 + [-1], [1] * 10 + [None], None]
    valid, invalid = scoring.split_valid(rows(spark, good, *bad))
    assert (valid.count(), invalid.count()) == (1, len(bad))
    assert scoring.split_valid(rows(spark, [1] * 10 + [None]), null_is_zero=True)[0].count() == 1
    assert scoring.score_submissions(rows(spark, [1] * 10 + [None]), null_is_zero=True).first().total_score == 10


def test_strict_validation_fails_the_job(spark):
    with pytest.raises(Exception, match="expected 11"):
        scoring.require_valid(rows(spark, [1] * 10)).collect()
    with pytest.raises(Exception, match="0 to 3"):
        scoring.require_valid(rows(spark, [1] * 10 + [4])).collect()
    assert scoring.require_valid(rows(spark, [1] * 11)).count() == 1


def test_flags(spark):
    def flags(q6, q7, q10, q12="B"):
        a = [0] * 11
        a[5], a[6], a[9] = q6, q7, q10
        return scoring.score_submissions(rows(spark, a, q12=q12)).first().flags.asDict()

    assert flags(2, 0, 3)["builder_signal"]
    assert flags(0, 3, 3)["builder_signal"]
    assert not flags(1, 2, 3)["builder_signal"]
    assert not flags(3, 3, 2)["builder_signal"]
    assert flags(3, 0, 0)["connected_automation"] and flags(0, 3, 0)["team_leverage"]
    assert flags(0, 0, 3)["high_systematization"]
    assert [flags(0, 0, 0, q)["governance_opportunity"] for q in ("A", "B", "C", "D", "E", None)] == [False, True, True, True, False, False]


def test_email(spark):
    cases = {" a@b.cd ": True, "a@b.c": False, "a b@c.de": False, "a b@c.de": False, "a@b@c.de": False, "@b.cd": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    got = {r.e: r.ok for r in df.select("e", scoring.email_valid(F.col("e")).alias("ok")).collect()}
    assert got == cases


def test_labels_and_profile(spark):
    scored = scoring.score_submissions(rows(spark, [0, 1, 2, 3] + [0] * 7))
    labels = scored.select(scoring.answer_labels(F.col("answers")).alias("l")).first().l
    assert labels[0] == "Frequency: Rarely or never" and labels[1].startswith("Breadth: Mostly one kind") and len(labels) == 11
    profile = {r.q_idx: r for r in scoring.dimension_profile(scored).collect()}
    assert [profile[i].tag for i in range(4)] == ["Focus", "Focus", None, "Strength"]
    assert [profile[i].band for i in range(4)] == ["lo", "lo", "mid", "hi"]


def test_goal_without_phrase_has_no_sentence(spark):
    scored = scoring.score_submissions(rows(spark, [1] * 11)).withColumn("next_goal", F.lit("E"))
    assert scoring.goal_reflection(scored).first().reflection is None


def test_first_submission_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("idempotency_id"),
        F.timestamp_seconds(5000 - F.col("id")).alias("submitted_at"),
        "id",
    )
    out = scoring.first_submissions(df)
    assert out.count() == 5000 - 1667 + 1
    assert out.where("idempotency_id = 'hot'").first().id == 4998


def test_pain_point_takes_the_latest_filled_update(spark):
    subs = rows(spark, [1] * 11, [2] * 11)
    sent = [("0", " one ", "pain_point", 3), ("0", "two", "pain_point", 2), ("0", "  ", "pain_point", 4), ("0", "x", "other", 5), ("9", "late", "pain_point", 1)]
    updates = spark.createDataFrame(sent, "idempotency_id string, pain_point_text string, update string, s long").select("idempotency_id", "pain_point_text", "update", F.timestamp_seconds("s").alias("received_at"))
    got = {r.idempotency_id: r.pain_point_text for r in scoring.attach_pain_points(subs, updates).collect()}
    assert got == {"0": "one", "1": None}
    assert [(r.idempotency_id, r.pain_point_text) for r in scoring.unmatched_updates(subs, updates).collect()] == [("9", "late")]


def test_completeness_of_short_and_null_answers(spark):
    df = rows(spark, [1] * 10, [1] * 11, None).withColumns({"q12_governance": F.lit(""), "personal_use": F.lit("A"), "next_goal": F.lit("A")})
    got = {r.idempotency_id: (r.answered, r.unanswered) for r in scoring.completeness(df).collect()}
    assert got == {"0": (12, [10, 11]), "1": (13, [11]), "2": (2, list(range(12)))}
