"""Queries run as streams over all data there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators.events import normalise_consent
from sitelode.operators.scoring import split_valid, submission_payload
from sitelode.plans.derived import (
    EVENTS_SQL,
    SUBMISSIONS_SQL,
    consent_columns,
    event_columns,
    interaction_columns,
    submission_columns,
    with_sql,
)
from sitelode.plans.events import stamped
from sitelode.plans.registry import Plan, table
from sitelode.plans.scoring import PLANS as SCORING
from sitelode.plans.scoring import payload_columns, post_columns, quarantine_columns, unmatched_columns, update_columns
from sitelode.plans.sources import PLANS as SOURCES
from sitelode.schemas import SUBMISSION
from sitelode.session import RECOMMENDED_CONF, work_dir
from sitelode.sources import records
from sitelode.streaming import events, submissions
from sitelode.streaming.closing import JSON, end_marks, run_once, run_to_end
from sitelode.streaming.upsert import run_batches


# Rows come in the order of their time, but up to so much late; the delay covers just that.
DISORDER_HOURS = 6
DELAY = f"{DISORDER_HOURS} hours"
FILES = 4


def stream_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state in one partition per core, and beyond the heap.

    The number is fixed for the life of a checkpoint, and adaptive execution does not change it.
    """
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", RECOMMENDED_CONF["spark.sql.streaming.stateStore.providerClass"])
    return session


def written_slices(spark: SparkSession, work: str, lines: bool = False, **tables: tuple[DataFrame, Column]) -> int:
    """Tables, each with its time, written by slices of time below ``work``, as Parquet or (their ``value``) as lines of text.

    A row arrives some hours after its time, by a hash, so that slices overlap by ``DISORDER_HOURS``. Each slice is
    so many files, which is returned.
    """
    parts = spark.sparkContext.defaultParallelism
    placed = {}
    for name, (rows, at) in tables.items():
        late = F.pmod(F.xxhash64(*rows.columns), F.lit(DISORDER_HOURS * 3_600_000_000))
        placed[name] = rows.withColumn("_arrived", F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(0)) + late)
    bounds = [rows.agg(F.min("_arrived"), F.max("_arrived")).first() for rows in placed.values()]
    low, high = (f((b[i] for b in bounds if b[i] is not None), default=0) for i, f in enumerate((min, max)))
    span = (high - low) // FILES + 1
    for name, rows in placed.items():
        for i in range(FILES):
            some = rows.where((F.col("_arrived") - low >= i * span) & (F.col("_arrived") - low < (i + 1) * span)).drop("_arrived")
            some = (some.select("value") if lines else some).repartition(parts).write.mode("append")
            some.text(f"{work}/{name}") if lines else some.parquet(f"{work}/{name}")
    return parts


def arrivals(spark: SparkSession, work: str, **tables: tuple[DataFrame, Column]) -> dict[str, DataFrame]:
    """The same as streams that go on together, a slice to a trigger."""
    files = written_slices(spark, work, **tables)
    return {name: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{work}/{name}") for name, (rows, _) in tables.items()}


def finished(spark: SparkSession, stream: DataFrame, work: str) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(run_to_end(stream, work))


def gated(spark: SparkSession, folder: str) -> DataFrame:
    session, work = stream_session(spark), work_dir(spark, "gated")
    source = event_columns(arrivals(session, work, events=(table(session, folder, "events"), F.col("ts")))["events"])
    allowed = normalise_consent(consent_columns(source)).select("visitor_id", "ts", "analytics")
    stream = events.event_stream(interaction_columns(source), allowed, DELAY, end_marks(session, work), slot_seconds=DISORDER_HOURS * 3600)
    return stamped(finished(spark, stream, work))


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of a key that differ, in any order: a keyed table has the earliest after each batch."""
    session, work = stream_session(spark), work_dir(spark, "deduplicated")
    posts = post_columns(arrivals(session, work, events=(table(session, folder, "events"), F.col("ts")))["events"])
    return kept(spark, submissions.submission_changes(posts, None), work).select("record.idempotency_id", "record.event_id", "record.value")


def kept(spark: SparkSession, changes: DataFrame, work: str) -> DataFrame:
    """The keyed table that a stream of changes leaves."""
    held = submissions.submission_table(f"{work}/table", changes).create(spark)
    run_batches(changes, work, held.upsert)
    return held.read(spark)


def retries(spark: SparkSession, folder: str) -> DataFrame:
    """Every submission is sent once, twice or three times, some hours apart."""
    session, work = stream_session(spark), work_dir(spark, "retries")
    once = submission_columns(table(session, folder, "customer"))
    tries = F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("idempotency_id"), F.lit(3)).cast("int"))).alias("try")
    sent = once.select("*", tries)
    sent = arrivals(session, work, posts=(sent, F.col("submitted_at")))["posts"].drop("try")
    stream = submissions.retries_dropped(sent, DELAY, end_marks(session, work))
    return finished(spark, stream, work).select("idempotency_id", "email", F.size("answers").alias("n_answers"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    session, work = stream_session(spark), work_dir(spark, "scored")
    source = submission_columns(table(session, folder, "customer"))
    posts = arrivals(session, work, posts=(source, F.col("submitted_at")))["posts"]
    # Invalid posts go first, so that they don't take the place of a valid retry.
    valid, _ = split_valid(posts)
    return payload_columns(submission_payload(kept(spark, submissions.submission_changes(valid, None), work).select("record.*")))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    session, work = stream_session(spark), work_dir(spark, "quarantined")
    source = submission_columns(table(session, folder, "customer"))
    stream = submissions.quarantine_stream(arrivals(session, work, posts=(source, F.col("submitted_at")))["posts"])
    return quarantine_columns(spark.read.schema(stream.schema).parquet(run_once(stream, work)))


def updated(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions with their latest update, and updates that match none; updates come long before their submissions."""
    session, work = stream_session(spark), work_dir(spark, "updated")
    posts, late = submission_columns(table(session, folder, "customer")), update_columns(table(session, folder, "events"))
    streams = arrivals(session, work, posts=(posts, F.col("submitted_at")), updates=(late, F.col("received_at")))
    return kept(spark, submissions.submission_changes(streams["posts"], streams["updates"]), work)


def pain_points(spark: SparkSession, folder: str) -> DataFrame:
    return updated(spark, folder).where("record IS NOT NULL").select("idempotency_id", F.col("text").alias("pain_point_text"))


def unmatched(spark: SparkSession, folder: str) -> DataFrame:
    lone = updated(spark, folder).where("record IS NULL")
    return unmatched_columns(lone.select("idempotency_id", F.col("text").alias("pain_point_text"), F.timestamp_micros("text_us").alias("received_at")))


def json_lines(rows: DataFrame, broken: Column) -> Column:
    """Each row as a line of JSON; broken ones are cut off."""
    line = F.to_json(F.struct(*rows.columns), JSON)
    return F.when(broken, F.left(line, F.length(line) - 2)).otherwise(line).alias("value")


def submission_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines, every thirteenth of them cut off, in files out of order; records and broken lines go to two outputs."""
    session, work = stream_session(spark), work_dir(spark, "lines")
    rows = submission_columns(table(session, folder, "customer"))
    lines = rows.select(json_lines(rows, F.col("idempotency_id").cast("bigint") % 13 == 0), "submitted_at")
    files = written_slices(session, work, lines=True, posts=(lines, F.col("submitted_at")))
    run_batches(records.read_submissions(session, f"{work}/posts", stream=True, files=files), work, records.write_apart(work))
    good, broken = records.read_apart(spark, work, SUBMISSION)
    none = F.lit(None)
    return good.select("idempotency_id", "email", F.size("answers").alias("n_answers"), F.lit(False).alias("is_broken")).unionByName(
        broken.select(none.cast("string").alias("idempotency_id"), none.cast("string").alias("email"), none.cast("int").alias("n_answers"), F.lit(True).alias("is_broken"))
    )


def update_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of updates, about every eleventh cut off; a table holds the latest of each key after each batch."""
    session, work = stream_session(spark), work_dir(spark, "update-lines")
    rows = update_columns(table(session, folder, "events"))
    lines = rows.select(json_lines(rows, F.unix_micros("received_at") % 11 == 0), "received_at")
    files = written_slices(session, work, lines=True, updates=(lines, F.col("received_at")))
    sent = records.read_updates(session, f"{work}/updates", stream=True, files=files)
    return kept(spark, submissions.submission_changes(None, sent), work).select("idempotency_id", F.col("text").alias("pain_point_text"))


PLANS = {
    "stream_gated_events": Plan(
        gated,
        with_sql(
            EVENTS_SQL,
            select="""SELECT visitor_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, name, link_url, link_text, page_path, page_title, cta_location
              FROM gated_all""",
        ),
    ),
    "stream_first_posts": Plan(deduplicated, SCORING["first_posts"].sql),
    "stream_retries": Plan(
        retries,
        with_sql(SUBMISSIONS_SQL, select="SELECT idempotency_id, email, CAST(len(a) AS INTEGER) AS n_answers FROM submissions_all"),
    ),
    "stream_scored_submissions": Plan(scored, SCORING["submissions_payload"].sql),
    "stream_submission_lines": Plan(submission_lines, SOURCES["submission_lines"].sql),
    "stream_update_lines": Plan(
        update_lines,
        """SELECT CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || user_id AS idempotency_id, arg_max(event_type || ' ' || props, ts) AS pain_point_text
           FROM events WHERE event_type NOT IN ('error', 'view') AND epoch_us(ts) % 11 <> 0 GROUP BY 1""",
    ),
    "stream_quarantine": Plan(quarantined, SCORING["quarantined_submissions"].sql),
    "stream_pain_points": Plan(pain_points, SCORING["pain_points"].sql),
    "stream_unmatched_updates": Plan(unmatched, SCORING["unmatched_updates"].sql),
}
