"""Submission streams: the earliest record per key, quarantine, and late partial updates.

Two forms: keys that close on the watermark and are given once (``deduplicate``, ``attach_updates``), and a keyed table
that is right after every batch, however late a record is (``submission_table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.functions.text import browser_trim
from sitelode.operators.scoring import split_valid, submission_payload
from sitelode.streaming.closing import closed, marked, records, texts
from sitelode.streaming.upsert import KeyedTable


def deduplicate(submissions: DataFrame, delay: str = "1 hour", marks: DataFrame | None = None, remember_seconds: int = 86_400) -> DataFrame:
    """The earliest record per idempotency key, as ``first_submissions`` finds it.

    It is given once the watermark has reached it, as only then no earlier one can come. Retries are known for
    ``remember_seconds`` more; then the key's state is removed.
    """
    found = closed(records(submissions, "idempotency_id", "submitted_at"), submissions.schema, delay, marks, 0, remember_seconds)
    return found.select("record.*")


def score_stream(submissions: DataFrame, delay: str = "1 hour", marks: DataFrame | None = None) -> DataFrame:
    """Valid records scored, the earliest of each key. Invalid ones are left to ``quarantine_stream``.

    They go first, so that an invalid post doesn't take the place of its valid retry.
    """
    valid, _ = split_valid(submissions)
    return submission_payload(deduplicate(valid, delay, marks))


def quarantine_stream(submissions: DataFrame) -> DataFrame:
    """The invalid records; without state."""
    return split_valid(submissions)[1]


def attach_updates(
    submissions: DataFrame, updates: DataFrame, delay: str = "1 hour", window_seconds: int = 86_400, marks: DataFrame | None = None
) -> DataFrame:
    """Each submission with its latest non-blank update, and the updates that match none, told apart by ``matched``.

    A submission is given ``window_seconds`` after it was sent. An update without one, or one that comes after that, is a
    row of its own with null submission columns, its key and time in ``update_id`` and ``received_at``.
    """
    text = browser_trim(F.col("pain_point_text"))
    filled = updates.where((F.col("update") == "pain_point") & (text != ""))
    rows = records(submissions, "idempotency_id", "submitted_at").unionByName(texts(filled, "idempotency_id", "received_at", text))
    found = closed(rows, submissions.schema, delay, marks, window_seconds, window_seconds)
    return found.select(
        "record.*",
        F.col("text").alias("pain_point_text"),
        F.timestamp_micros("text_us").alias("received_at"),
        F.col("key").alias("update_id"),
        F.col("record").isNotNull().alias("matched"),
    )


def retries_dropped(submissions: DataFrame, delay: str = "1 hour", marks: DataFrame | None = None, at: str = "submitted_at") -> DataFrame:
    """Each post once, where the posts of a key are equal, as tries of one post are; given at once.

    Tries of a key lie within ``delay`` of each other. For posts of one key that differ, see ``deduplicate``. Posts
    without a key or a time are dropped.
    """
    timed = submissions.withColumn("ts", F.col(at).cast("timestamp"))
    return marked(timed, marks, delay, "idempotency_id").dropDuplicatesWithinWatermark(["idempotency_id"]).drop("ts")


def _latest_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = F.struct("first_us", "first_rank")
    last = F.when(F.col("text").isNotNull(), F.struct("text_us", "text"))
    merged = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("record").isNotNull(), first)).alias("first"),
        F.min_by("record", F.when(F.col("record").isNotNull(), first)).alias("record"),
        F.max(last).alias("last"),
    )
    return merged.select(*keys, "first.*", "record", "last.*")


def submission_changes(submissions: DataFrame | None, updates: DataFrame | None, at: str = "submitted_at") -> DataFrame:
    """Posts and non-blank partial updates, batch or stream, as rows of a ``submission_table``."""
    none = F.lit(None)
    parts = []
    if submissions is not None:
        posted = F.unix_micros(F.col(at).cast("timestamp"))
        parts.append(
            submissions.select(
                "idempotency_id", posted.alias("first_us"), F.xxhash64(*submissions.columns).alias("first_rank"), F.struct(*submissions.columns).alias("record"), none.cast("long").alias("text_us"), none.cast("string").alias("text")
            )
        )
    if updates is not None:
        text = browser_trim(F.col("pain_point_text"))
        filled = updates.where((F.col("update") == "pain_point") & (text != ""))
        received = F.unix_micros(F.col("received_at").cast("timestamp"))
        kind = parts[0].schema["record"].dataType if parts else T.StringType()
        parts.append(filled.select("idempotency_id", none.cast("long").alias("first_us"), none.cast("long").alias("first_rank"), none.cast(kind).alias("record"), received.alias("text_us"), text.alias("text")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def submission_table(path: str, changes: DataFrame, buckets: int = 16) -> KeyedTable:
    """The earliest record of each key and its latest update text, kept up to date by batches of ``changes``.

    A key of which only an update has come has a null record. Records and updates count alike in any order: before,
    with or after each other.
    """
    return KeyedTable(path, changes.schema, "idempotency_id", _latest_of_key, buckets)
