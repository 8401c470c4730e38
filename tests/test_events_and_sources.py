"""Events, streams and file sources."""

from __future__ import annotations

import bisect
import datetime as dt
import json
import os
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelode.operators import events, scoring
from sitelode.operators.timeline import filled_forward
from sitelode.schemas import CLICK, CONSENT, SITEMAP_URL, SUBMISSION, SUBMISSION_UPDATE
from sitelode.session import work_dir
from sitelode.sources import corpus, records
from sitelode.streaming import closing, upsert
from sitelode.streaming import gate as stream_events
from sitelode.streaming import submissions as stream_submissions

T0 = dt.datetime(2026, 1, 1)


def at(minutes, us=0):
    return T0 + dt.timedelta(minutes=minutes, microseconds=us)


def click(visitor="v", minute=0, href="", text="t", is_link=True, primary=False, section=None):
    return (visitor, at(minute), href, text, is_link, primary, section, "https://own.ex/p?x=1", "Title")


def clicks(spark, *rows):
    return spark.createDataFrame(list(rows), CLICK)


def names(df):
    return sorted(r.name for r in df.collect())


@pytest.mark.parametrize(
    "kwargs,want",
    [
        (dict(href="mailto:a@b.cd"), ["email_click"]),
        (dict(href="mailto:a@b.cd", primary=True), ["cta_click", "email_click"]),
        (dict(href="https://else.ex/"), ["outbound_link_click"]),
        (dict(href="/x"), []),
        (dict(href="/x", primary=True), ["cta_click"]),
        (dict(href=None, primary=True, is_link=False), ["cta_click"]),
        (dict(href="https://else.ex", is_link=False), []),
    ],
)
def test_click_kinds(spark, kwargs, want):
    assert names(events.classify_clicks(clicks(spark, click(**kwargs)))) == want


def test_click_fields(spark):
    row = events.classify_clicks(clicks(spark, click(href="/x", primary=True, text=" " + "ab" * 80 + " ", section=""))).first()
    assert (row.link_url, row.link_text, row.page_path, row.page_title, row.cta_location) == ("/x", "ab" * 50, "/p", "Title", "unknown")
    row = events.classify_clicks(clicks(spark, click(href=None, is_link=False, primary=True, section="hero"))).first()
    assert (row.link_url, row.cta_location) == (None, "hero")


def consents(spark, *rows):
    data = [(v, at(m), raw if isinstance(raw, str) else json.dumps({"analytics": raw})) for v, m, raw in rows]
    return events.normalise_consent(spark.createDataFrame(data, "visitor_id string, ts timestamp, raw string"))


def test_consent_records(spark):
    got = [r.analytics for r in consents(spark, ("v", 0, True), ("v", 1, False), ("v", 2, "oops"), ("v", 3, "{}"), ("v", 4, None)).orderBy("ts").collect()]
    assert got == [True, False, False, False, False]


def test_gate_is_as_of(spark):
    allowed = consents(spark, ("v", 10, True), ("v", 200, False), ("v", 400, True), ("w", 0, False), ("t", 5, True), ("t", 5, False))
    shown = clicks(
        spark,
        *[click("v", m, "mailto:x@y.zz", text=str(m)) for m in (9, 10, 11, 199, 200, 300, 400, 900)],
        click("w", 5, "mailto:x@y.zz"),
        click("none", 5, "mailto:x@y.zz"),
        click(None, 5, "mailto:x@y.zz"),
        click("t", 6, "mailto:x@y.zz"),
    )
    got = events.gate_by_consent(events.classify_clicks(shown), allowed)
    assert sorted(int(r.link_text) for r in got.collect()) == [10, 11, 199, 400, 900]


def test_gate_over_days_and_a_busy_visitor(spark):
    day = 24 * 60
    allowed = consents(spark, ("v", 5, True), ("v", 3 * day, False), ("v", 3 * day + 2, True), ("v", 9 * day, False))
    shown = clicks(spark, *[click("v", m, "mailto:x@y.zz", text=str(m)) for m in (4, 6, day, 3 * day - 1, 3 * day + 1, 3 * day + 3, 8 * day, 10 * day)])
    got = events.gate_by_consent(events.classify_clicks(shown), allowed)
    assert sorted(int(r.link_text) for r in got.collect()) == sorted([6, day, 3 * day - 1, 3 * day + 3, 8 * day])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_gate_of_a_busy_visitor(spark):
    """Half of all rows are one visitor's, some in steps of a microsecond, and others around 1970 and later."""
    micros = sorted({i * 10_007 for i in range(5000)} | set(range(30_000_000, 30_001_500)) | {-(10**15), -(10**13), 10**12, 4 * 10**13})
    start = 1_767_225_600_000_000
    allowed = spark.createDataFrame([("v", start + m, (m // 7) % 3 == 0) for m in micros], "visitor_id string, at long, analytics boolean")
    allowed = allowed.select("visitor_id", F.timestamp_micros("at").alias("ts"), "analytics")
    shown = [-(10**16), -(10**15), -(10**14), 0, 10**11, 10**13, 10**14, *range(-3, 60_000_000, 29_989), *range(29_999_990, 30_001_600, 7)]
    clicked = spark.createDataFrame([("v", start + m, m) for m in shown], "visitor_id string, at long, m long")
    clicked = clicked.select("visitor_id", F.timestamp_micros("at").alias("ts"), "m")
    got = events.gate_by_consent(clicked, allowed)
    want = [m for m in shown if (k := bisect.bisect_right(micros, m)) and (micros[k - 1] // 7) % 3 == 0]
    assert sorted(r.m for r in got.collect()) == sorted(want)


def test_gate_splits_a_visitor_and_an_instant(spark):
    """The one shuffle deals a hot visitor's rows, also those of one instant, over all partitions."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    timeline = session.range(40_000).select(F.lit("v").alias("k"), F.lit(1).alias("at"), F.xxhash64("id").alias("tie"), F.when(F.col("id") == 5, "x").alias("value"))
    filled = filled_forward(timeline.repartition(4), "k", ["at", "tie"], "value").cache()
    sizes = [r["count"] for r in filled.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000
    first = timeline.where("value = 'x'").first().tie
    assert filled.where(F.col("value").isNotNull()).count() == timeline.where(F.col("tie") >= first).count()


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_filled_forward_equals_a_window(spark, parts):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"),
        ((F.col("id") * 7919) % 3001).alias("at"),
        F.when(F.xxhash64("id") % 50 == 0, F.col("id")).alias("value"),
    )
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", parts)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    want = rows.select("k", "at", F.last("value", True).over(Window.partitionBy("k").orderBy("at")).alias("value")).where("k IS NOT NULL")
    source = session.createDataFrame(rows.collect(), rows.schema)
    got = filled_forward(source, "k", ["at"], "value")
    assert Counter(map(tuple, got.where("k IS NOT NULL").collect())) == Counter(map(tuple, want.collect()))
    assert got.where("k IS NULL").count() == rows.where("k IS NULL").count()
    assert filled_forward(source.limit(0), "k", ["at"], "value").count() == 0


def test_submits(spark):
    data = [("v", at(0), True, " a@b.cd ", "https://own.ex/p", "T"), ("v", at(1), False, "a@b.cd", "https://own.ex/p", "T"), ("v", at(2), True, "bad", "https://own.ex/p", "T")]
    df = spark.createDataFrame(data, "visitor_id string, ts timestamp, is_subscribe_form boolean, email string, page_url string, page_title string")
    assert events.classify_submits(df).count() == 2
    assert [r.email for r in events.subscription_requests(df).collect()] == ["a@b.cd"]


def feed(spark, folder, df, parts=3):
    """A table as a stream of several files, dealt out regardless of time, one file to a trigger."""
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def streamed(spark, tmp_path, build):
    """All rows of the stream that ``build`` makes from end marks, run to the end of its input."""
    work = str(tmp_path / "work")
    stream = build(closing.end_marks(spark, work))
    return spark.read.schema(stream.schema).parquet(closing.run_to_end(stream, work)).collect()


def test_streamed_gate_equals_the_batch_gate(spark, tmp_path):
    shown = events.classify_clicks(clicks(spark, *[click(v, m, "mailto:x@y.zz", text=f"{v}{m}") for v in "ab" for m in range(0, 300, 7)]))
    allowed = consents(spark, *[(v, m, (m // 20 + ord(v)) % 2 == 0) for v in "ab" for m in range(3, 300, 20)]).select("visitor_id", "ts", "analytics")
    want = {r.link_text for r in events.gate_by_consent(shown, allowed).collect()}
    sources = feed(spark, tmp_path / "e", shown), feed(spark, tmp_path / "c", allowed, 2)
    got = [r.link_text for r in streamed(spark, tmp_path, lambda marks: stream_events.gate_stream(*sources, "10 days", marks, shards=3))]
    assert len(got) == len(set(got)) and set(got) == want


def in_order(spark, folder, *slices):
    """Slices of rows as a stream, one to a trigger."""
    for some in slices:
        some.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("shards", [1, 3])
def test_streamed_gate_releases_between_triggers(spark, tmp_path, shards):
    """With a delay of hours, over days: what is released early and late together equals the batch gate."""
    hour = 60
    shown = events.classify_clicks(clicks(spark, *[click(v, m, "mailto:x@y.zz", text=f"{v}{m}") for v in "ab" for m in range(0, 96 * hour, 41)]))
    allowed = consents(spark, *[(v, m, (m // 500 + ord(v)) % 3 > 0) for v in "abc" for m in range(3, 96 * hour, 250)]).select("visitor_id", "ts", "analytics")

    def slices(rows):
        late = rows.withColumn("_at", F.col("ts") + F.make_dt_interval(mins=F.pmod(F.xxhash64(*rows.columns), F.lit(3 * hour)).cast("int")))
        return [late.where((F.col("_at") >= F.lit(at(a))) & (F.col("_at") < F.lit(at(a + 20 * hour)))).drop("_at") for a in range(0, 100 * hour, 20 * hour)]

    want = {r.link_text for r in events.gate_by_consent(shown, allowed).collect()}
    sources = in_order(spark, tmp_path / "e", *slices(shown)), in_order(spark, tmp_path / "c", *slices(allowed))
    work = str(tmp_path / "work")
    stream = stream_events.gate_stream(*sources, "3 hours", closing.end_marks(spark, work), shards, slot_seconds=7200)
    early = [r.link_text for r in spark.read.schema(stream.schema).parquet(closing.run_once(stream, work)).collect()]
    got = [r.link_text for r in spark.read.schema(stream.schema).parquet(closing.run_to_end(stream, work)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and set(early) < want and len(early) > len(want) / 2


def test_streamed_gate_state_grows_with_buckets(spark, tmp_path):
    """Hundreds of visitors are a few keys of state, and each has consents of its own."""
    many = [f"v{i}" for i in range(300)]
    shown = events.classify_clicks(clicks(spark, *[click(v, m, "mailto:x@y.zz", text=f"{v} {m}") for v in many for m in (1, 50, 200)]))
    allowed = consents(spark, *[(v, 10, i % 3 > 0) for i, v in enumerate(many)], *[(v, 100, i % 2 > 0) for i, v in enumerate(many)]).select("visitor_id", "ts", "analytics")
    sources = feed(spark, tmp_path / "e", shown), feed(spark, tmp_path / "c", allowed, 2)
    got = [r.link_text for r in streamed(spark, tmp_path, lambda marks: stream_events.gate_stream(*sources, "10 days", marks, buckets=3))]
    assert sorted(got) == sorted([f"v{i} 50" for i in range(300) if i % 3 > 0] + [f"v{i} 200" for i in range(300) if i % 2 > 0])
    held = spark.read.format("statestore").option("path", f"{tmp_path}/work/checkpoint").option("stateVarName", "allowed").load()
    assert held.count() == 6


def test_streamed_gate_drops_late_rows_and_forgets(spark, tmp_path):
    day = 24 * 60

    def shown(*rows):
        return events.classify_clicks(clicks(spark, *[click(v, m, "mailto:x@y.zz", text=f"{v}{m}") for v, m in rows]))

    sent = in_order(spark, tmp_path / "e", shown(("a", 60), ("b", 61)), shown(("z", 5 * day)), shown(("a", 90), ("a", 5 * day + 60), ("c", 5 * day + 60)), shown(("z", 9 * day)))
    told = [("a", 5, True), ("b", 5, True), ("b", 100, False), ("c", 4 * day, True)]
    allowed = consents(spark, *told).select("visitor_id", "ts", "analytics").coalesce(1)
    work = str(tmp_path / "work")
    stream = stream_events.gate_stream(sent, in_order(spark, tmp_path / "c", allowed), "1 hour", closing.end_marks(spark, work), 1, slot_seconds=1800, remember_seconds=2 * day * 60)
    got = sorted(r.link_text for r in spark.read.schema(stream.schema).parquet(closing.run_to_end(stream, work)).collect())
    # a90 comes five days late; a's consent has lapsed by day five, c's of day four has not.
    assert got == ["a60", "b61", "c7260"]
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").option("path", f"{work}/checkpoint").option("stateVarName", "allowed").load()
    assert held.count() == 0


def test_streamed_deduplication_keeps_the_earliest(spark, tmp_path):
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("idempotency_id"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + (F.col("id") * 7919) % 401 * 1001).alias("submitted_at"),
        F.array(F.col("id"), F.lit(None).cast("long")).alias("more"),
        F.concat(F.lit('"\n'), "id").alias("text"),
    )
    source = feed(spark, tmp_path / "s", rows)
    got = streamed(spark, tmp_path, lambda marks: stream_submissions.deduplicate(source, "10 days", marks))
    assert sorted(map(tuple, got)) == sorted(map(tuple, scoring.first_submissions(rows).collect()))


def posts_of(spark, *rows):
    """(id, minute, answers)"""
    data = [(i, "a@b.cd", at(m), a, "A", "A", "A", "https://x.y/") for i, m, a in rows]
    return spark.createDataFrame(data, SUBMISSION)


def test_an_invalid_post_does_not_hide_its_retry(spark, tmp_path):
    posts = posts_of(spark, ("k", 0, [1] * 10), ("k", 5, [1] * 11), ("k", 9, [2] * 11), ("z", 1, [4] * 11))
    source = feed(spark, tmp_path / "p", posts)
    got = streamed(spark, tmp_path, lambda marks: stream_submissions.score_stream(source, "10 days", marks))
    assert [(r.idempotency_id, r.total_score) for r in got] == [("k", 11)]
    bad = stream_submissions.quarantine_stream(feed(spark, tmp_path / "q", posts))
    kept = spark.read.schema(bad.schema).parquet(closing.run_once(bad, work_dir(spark, "bad"))).collect()
    assert sorted((r.idempotency_id, len(r.answers)) for r in kept) == [("k", 10), ("z", 11)]


def test_streamed_updates(spark, tmp_path):
    posts = posts_of(spark, ("a", 0, [1] * 11), ("a", 3, [2] * 11), ("b", 1, [1] * 11), ("c", 600, [1] * 11))
    sent = [("a", " t ", "pain_point", at(2)), ("a", "u", "pain_point", at(4)), ("a", "t", "pain_point", at(3)), ("b", " ", "pain_point", at(5)), ("b", "no", "other", at(6)), ("z", "x", "pain_point", at(601)), ("z", "y", "pain_point", at(600))]
    updates = spark.createDataFrame(sent, SUBMISSION_UPDATE)
    sources = feed(spark, tmp_path / "p", posts), feed(spark, tmp_path / "u", updates, 2)
    got = streamed(spark, tmp_path, lambda marks: stream_submissions.attach_updates(*sources, "10 days", 86_400, marks))
    assert sorted(((r.update_id, r.pain_point_text, r.matched) for r in got), key=str) == [("a", "u", True), ("b", None, True), ("c", None, True), ("z", "x", False)]
    assert [r.answers[0] for r in got if r.update_id == "a"] == [1]


def test_an_update_after_the_window_is_a_row_of_its_own(spark, tmp_path):
    """In order, with a short delay: the key closes between the triggers."""
    folder = tmp_path / "u"
    rows = posts_of(spark, ("a", 0, [1] * 11))
    late = spark.createDataFrame([("a", "in time", "pain_point", at(1)), ("z", "moves the time", "pain_point", at(500)), ("a", "late", "pain_point", at(501))], SUBMISSION_UPDATE)
    for part in (late.where("pain_point_text = 'in time'"), late.where("pain_point_text = 'moves the time'"), late.where("pain_point_text = 'late'")):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    updates = spark.readStream.schema(SUBMISSION_UPDATE).option("maxFilesPerTrigger", 1).parquet(str(folder))
    source = feed(spark, tmp_path / "p", rows, 1)
    got = streamed(spark, tmp_path, lambda marks: stream_submissions.attach_updates(source, updates, "1 minute", 3600, marks))
    assert sorted((r.update_id, r.pain_point_text, r.matched) for r in got) == [("a", "in time", True), ("a", "late", False), ("z", "moves the time", False)]


def test_consent_is_what_a_browser_takes_for_true(spark):
    said = {"1": True, "0": False, "true": True, "false": False, '"yes"': True, '""': False, "null": False, "-0.0": False, "0.5": True, "{}": True}
    df = spark.createDataFrame([(k, at(0), '{"analytics":%s}' % k) for k in said] + [("none", at(0), "{}"), ("bad", at(0), "no json")], CONSENT)
    assert {r.visitor_id: r.analytics for r in events.normalise_consent(df).collect()} == said | {"none": False, "bad": False}


def test_equal_retries_are_dropped_without_python(spark, tmp_path):
    posts = posts_of(spark, *[(f"k{i}", i, [1] * 11) for i in range(30)])
    source = in_order(spark, tmp_path / "p", posts, posts.where("idempotency_id < 'k2'"), posts_of(spark, ("k0", 0, [1] * 11), (None, 1, [1] * 11), ("new", 700, [1] * 11)), posts_of(spark, ("new", 700, [1] * 11)))
    work = str(tmp_path / "work")
    stream = stream_submissions.retries_dropped(source, "1 hour", closing.end_marks(spark, work))
    got = [r.idempotency_id for r in spark.read.schema(stream.schema).parquet(closing.run_to_end(stream, work)).collect()]
    assert sorted(got) == sorted([f"k{i}" for i in range(30)] + ["new"])
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{work}/other").trigger(availableNow=True).start()
    query.awaitTermination()
    assert "Python" not in query._jsq.explainInternal(True) and "Pandas" not in query._jsq.explainInternal(True)


def test_json_streams_set_broken_lines_apart(spark, tmp_path):
    """Several files out of order; a batch that is tried again replaces what it left."""
    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"idempotency_id":"k%d","pain_point_text":"t%d","update":"pain_point","received_at":"2026-01-01T00:00:%02d.000001Z"}'
    for name, numbers in (("c", (5, 6)), ("a", (1, 2)), ("b", (3,))):
        (folder / f"{name}.json").write_text("\n".join([line % (i % 2, i, i) for i in numbers] + ['{"idempotency_id": "cut', "", "no json"]))
    stream = records.read_updates(spark, str(folder), stream=True, files=1)
    sink = records.write_apart(str(tmp_path / "out"))
    for _ in range(2):
        upsert.run_batches(stream, str(tmp_path / "run"), sink)
    kept, broken = records.read_apart(spark, str(tmp_path / "out"), SUBMISSION_UPDATE)
    assert sorted(r.pain_point_text for r in kept.collect()) == ["t1", "t2", "t3", "t5", "t6"]
    assert sorted(r.value for r in broken.collect()) == sorted(['{"idempotency_id": "cut', "no json"] * 3)
    again = records.write_apart(str(tmp_path / "twice"))
    for name in ("a.json", "c.json", "c.json"):
        again(records.read_updates(spark, str(folder / name)), 0)
    kept, broken = records.read_apart(spark, str(tmp_path / "twice"), SUBMISSION_UPDATE)
    assert (sorted(r.pain_point_text for r in kept.collect()), broken.count()) == (["t5", "t6"], 2)
    held = stream_submissions.submission_table(str(tmp_path / "t"), stream_submissions.submission_changes(None, stream)).create(spark)
    upsert.run_batches(stream_submissions.submission_changes(None, stream), str(tmp_path / "again"), held.upsert)
    assert sorted((r.idempotency_id, r.text) for r in held.read(spark).collect()) == [("k0", "t6"), ("k1", "t5")]


def change_rows(held, spark):
    return sorted(((r.idempotency_id, r.record and r.record.answers[0], r.text) for r in held.read(spark).collect()), key=str)


def test_upserts_in_any_order_and_twice(spark, tmp_path):
    """Updates before, with and after their submission; a batch given twice, also as its first try broke off."""
    posts = [posts_of(spark, ("a", 3, [2] * 11)), posts_of(spark, ("b", 1, [1] * 11)), posts_of(spark, ("a", 0, [1] * 11), ("d", 5, [3] * 11))]
    sent = [[("c", "early", "pain_point", at(1)), ("b", " t ", "pain_point", at(2))], [("b", "u", "pain_point", at(9)), ("b", " ", "pain_point", at(10))], [("b", "old", "pain_point", at(1)), ("a", "x", "other", at(6)), (None, "n", "pain_point", at(1))]]
    batches = [stream_submissions.submission_changes(p, spark.createDataFrame(u, SUBMISSION_UPDATE)) for p, u in zip(posts, sent, strict=True)]
    held = stream_submissions.submission_table(str(tmp_path / "t"), batches[0], buckets=3).create(spark)
    assert held.read(spark).count() == 0
    held.upsert(batches[0], 0)
    first = change_rows(held, spark)
    assert first == [("a", 2, None), ("b", None, "t"), ("c", None, "early")]
    held.upsert(batches[1], 0)
    assert change_rows(held, spark) == first
    # A try that wrote its rows, but no manifest.
    batches[1].withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t" / "batches" / "1"))
    assert change_rows(held, spark) == first
    for i in (1, 1, 2, 1, 0, 2):
        held.upsert(batches[i], i)
    assert change_rows(held, spark) == sorted([("a", 1, None), ("b", 1, "u"), ("c", None, "early"), ("d", 3, None), (None, None, "n")], key=str)
    again = stream_submissions.submission_table(str(tmp_path / "s"), batches[0]).create(spark)
    for i in (2, 0, 1):
        again.upsert(batches[i], [1, 2, 0][i])
    assert change_rows(again, spark) == change_rows(held, spark)


@pytest.fixture()
def site(tmp_path):
    files = {
        "index.html": "<p>é</p>",
        "sub dir/a+b.html": "x\ny",
        "scripts/no.html": "no",
        "node_modules/m/no.html": "no",
        ".gitx/no.html": "no",
        "content/one.md": '---\ntitle: "One"\n---\nText',
        "assets/i.png": "12345",
        "notes.txt": "see (https://own.ex/a.html) and https://own.ex/b/c.html, https://else.ex/d.html",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf8")
    return str(tmp_path)


def test_corpus_scan(spark, site):
    pages = {r.path: r.html for r in corpus.scan_text(spark, site).collect()}
    assert pages == {"index.html": "<p>é</p>", "sub dir/a+b.html": "x\ny"}
    assert {r.path for r in corpus.scan_public_pages(spark, site).collect()} == {"index.html", "sub dir/a+b.html"}
    texts = {r.path for r in corpus.scan_referring_text(spark, site).collect()}
    assert texts == {"index.html", "sub dir/a+b.html", "scripts/no.html", "content/one.md", "notes.txt"}
    docs = corpus.scan_markdown(spark, site).collect()
    assert [(d.slug, d.meta, d.body) for d in docs] == [("one", {"title": "One"}, "Text")]
    urls = corpus.own_page_urls(corpus.scan_text(spark, site, ("txt",), column="text"), ["path"], "own.ex")
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://own.ex/a.html", "https://own.ex/b/c.html"]


def test_inventory_reads_no_contents(spark, site):
    files = corpus.scan_inventory(spark, site, "*.png")
    assert [tuple(r) for r in files.collect()] == [("/assets/i.png", 5)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split(">")[0]
    assert [bytes(r.content) for r in corpus.scan_images(spark, site).collect()] == [b"12345"]


ODD_NAMES = ["a b", "100%", "%25", "a+b", "a=b:c", "x/y", "ñ#?", "[z]{1}"]


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"<p>{i}\n</p>\n") for i, n in enumerate(ODD_NAMES)] + [("empty", ""), ("null", None)], "name string, html string")
    for folder in ("in 50%/a+b", "scripts", "deep/node_modules/x"):
        corpus.write_files(rows, f"{tmp_path}/{folder}", F.col("name"), F.col("html"))
    back = [tuple(r) for r in corpus.scan_files(spark, str(tmp_path)).collect()]
    assert sorted(back) == sorted([("in 50%/a+b", n, f"<p>{i}\n</p>\n") for i, n in enumerate(ODD_NAMES)] + [("in 50%/a+b", n, "") for n in ("empty", "null")])


def test_written_bytes_come_back(spark, tmp_path):
    contents = [bytes(range(256)), b"\xff\n\n", b""]
    rows = spark.createDataFrame(list(zip(ODD_NAMES, map(bytearray, contents), strict=False)), "name string, content binary")
    corpus.write_files(rows, f"{tmp_path}/b", F.col("name"), F.col("content"))
    images = corpus.written_paths(corpus.scan_images(spark, str(tmp_path), pattern="*.txt"))
    assert {r.name: bytes(r.content) for r in images.collect()} == {n: c + b"\n" for n, c in zip(ODD_NAMES, contents, strict=False)}
    lengths = corpus.written_paths(corpus.scan_inventory(spark, str(tmp_path), "*.txt"))
    assert {r.name: r.length for r in lengths.collect()} == {n: len(c) + 1 for n, c in zip(ODD_NAMES, contents, strict=False)}
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split(">")[0]


def test_written_files_share_folders(spark, tmp_path):
    """Few folders for many files; a name's rows of one task are one file; what broken attempts leave is not read."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("concat('n', id) AS name", "concat('t', id) AS html")
    odd = spark.createDataFrame([("__HIVE_DEFAULT_PARTITION__", "a"), (None, "b"), ("n0", "c")], "name string, html string").coalesce(1)
    corpus.write_files(rows.union(odd).union(odd.where("name = 'n0'").coalesce(1)), f"{tmp_path}/b", F.col("name"), F.col("html"))
    hidden = tmp_path / "b" / "_part-00000.9" / "00000"
    hidden.mkdir(parents=True)
    (hidden / "=n1.txt").write_text("half")
    assert sum(p.is_dir() for p in (tmp_path / "b").rglob("*")) < 20
    back = [tuple(r) for r in corpus.scan_files(spark, str(tmp_path)).collect()]
    none = "__HIVE_DEFAULT_PARTITION__"
    assert sorted(back) == sorted([("b", f"n{i}", f"t{i}") for i in range(3000)] + [("b", none, "a"), ("b", none, "b"), ("b", "n0", "c"), ("b", "n0", "c")])
    twice = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "name string, html string").coalesce(1)
    corpus.write_files(twice, f"{tmp_path}/c", F.col("name"), F.col("html"))
    assert sorted(r.html.split("\n") for r in corpus.scan_files(spark, f"{tmp_path}/c").collect()) in ([["1", "3"], ["2"]], [["2"], ["3", "1"]])


def test_tasks_list_and_read_files(spark, tmp_path):
    """The driver holds no list of files, and one folder's files are dealt out to all tasks."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("concat('n', id) AS name", "concat('t', id) AS html")
    corpus.write_files(rows, f"{tmp_path}/b", F.col("name"), F.col("html"))
    files = corpus.scan_files(spark, str(tmp_path))
    assert "FileScan" not in files._jdf.queryExecution().sparkPlan().toString()
    counts = files.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in counts) < 1.5 * 3000 / len(counts)
    assert sorted(tuple(r) for r in files.collect()) == sorted(("b", f"n{i}", f"t{i}") for i in range(3000))


def test_tasks_find_the_files_that_sparks_reader_finds(spark, tmp_path, monkeypatch):
    files = {
        "a.html": b"x", "_h.html": b"h", ".d.html": b"d", "_p=1.html": b"p", "_x/q.html": b"q", "_x=1/q.html": b"q", ".git/q.html": b"g",
        "_metadata/z.html": b"z", "_metadata.html": b"z", "c.html._COPYING_": b"c", "c._COPYING_/k.html": b"k", "empty.html": b"",
        "bad.html": b"\xff\xfe\x00z\xc3", "crlf.html": b"a\r\nb\r", "bom.html": b"\xef\xbb\xbfq", "d/node_modules/a.html": b"n", "UP.HTML": b"u",
        "q?#%41 {z}[y]+ñ'\"\\.html": b"q", "deep/" * 30 + "f.html": b"f", "dir.html/in.html": b"i", "big.html": b"y" * 3_000_000, "m.html.md": b"m",
    }
    root = tmp_path / "odd 50%" / "a+b"
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "link.html").symlink_to(root / "a.html")
    (root / "below").symlink_to(root / "deep")
    (root / "gone.html").symlink_to(root / "nowhere")

    def found() -> list[tuple[str, bytes]]:
        texts = corpus.scan_text(spark, str(root)).select("path", F.col("html").cast("binary"))
        return sorted((r.path, bytes(r.html)) for r in texts.collect())

    by_tasks = found()
    monkeypatch.setattr(corpus, "_mounted", lambda spark, root: None)
    assert by_tasks == found()
    assert ("bad.html", files["bad.html"]) in by_tasks and ("below/" + "deep/" * 29 + "f.html", b"f") in by_tasks


def test_few_folders_are_named_on_the_driver(tmp_path):
    for i in range(40):
        (tmp_path / f"{i}" / "x" / "y").mkdir(parents=True)
    root = os.fsencode(tmp_path)
    assert corpus._top_folders(root, 1) == [(root, True)]
    names = corpus._top_folders(root, 40)
    assert names[0] == (root, False) and len(names) == 41 and all(whole for _, whole in names[1:])
    assert len(corpus._top_folders(root)) == 121 and not any(whole for _, whole in corpus._top_folders(root))


def test_sitemap_round_trip(spark, tmp_path):
    rows = [("https://own.ex/?a=1&b=<2>", "2026-05-01", "weekly", 0.8)]
    records.write_sitemap(spark.createDataFrame(rows, SITEMAP_URL), str(tmp_path / "map"))
    assert [tuple(r) for r in records.read_sitemap(spark, str(tmp_path / "map")).collect()] == rows


def test_work_dir_uses_the_shared_folder(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")
