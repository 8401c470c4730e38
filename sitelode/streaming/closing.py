"""Keys that close on the watermark, and streams run to the end of their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Instants keep their microseconds in JSON.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
# Later than any event: once a stream has seen it, all keys close.
END = "9999-12-31 00:00:00"

_STATE = "first_us long, first_rank long, first string, last_us long, last string, emitted boolean"


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of end marks (``ts``) below ``folder``; it is empty until ``run_to_end`` writes one."""
    spark.createDataFrame([], "ts timestamp").write.parquet(f"{folder}/marks")
    return spark.readStream.schema("ts timestamp").parquet(f"{folder}/marks")


def marked(rows: DataFrame, marks: DataFrame | None, delay: str, key: str) -> DataFrame:
    """``rows`` that have a ``key``, with a watermark on ``ts`` that end marks move, too. Marks have no key.

    ``delay`` has to cover the disorder of the input: what comes later than that is dropped by Spark.
    """
    both = rows if marks is None else rows.unionByName(marks, allowMissingColumns=True)
    # A condition that names the time isn't moved below the watermark, which has to see the marks.
    return both.withWatermark("ts", delay).where(F.when(F.col("ts").isNotNull(), F.col(key).isNotNull()))


def _ran(stream: DataFrame, folder: str) -> str:
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/output")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{folder}/output"


def run_once(stream: DataFrame, folder: str) -> str:
    """Run a stream over all data there is into Parquet below ``folder``; what waits stays in its state."""
    return _ran(stream, folder)


def run_to_end(stream: DataFrame, folder: str) -> str:
    """The same, and then an end mark, which lets everything out that waits. ``folder`` is that of the marks."""
    _ran(stream, folder)
    stream.sparkSession.range(1).select(F.expr(f"timestamp'{END}'").alias("ts")).write.mode("append").parquet(f"{folder}/marks")
    return _ran(stream, folder)


def _closer(wait_us: int, remember_us: int) -> Callable:
    """The state processor, as a closure: it is shipped whole, so executors need not have the package."""

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Hold the earliest record and the latest text until the watermark is ``wait`` past the record."""
        first_us, first_rank, first, last_us, last, emitted = state.get if state.exists else (None, None, None, None, None, False)
        out: list[tuple] = []
        line = state.getCurrentWatermarkMs() * 1000
        begun = last_us if first_us is None else first_us
        if not emitted and begun is not None and line >= begun + wait_us:
            # What comes now is later than the close.
            out.append((key[0], first, last, last_us))
            first, last, emitted = None, None, True
        for pdf in batches:
            for us, rank, payload, text in zip(pdf["us"], pdf["rank"], pdf["payload"], pdf["text"], strict=True):
                us, rank = int(us), int(rank)
                if isinstance(payload, str):
                    if emitted and first_us is None:
                        out.append((key[0], payload, None, None))
                        first_us, first_rank = us, rank
                    elif not emitted and (first_us is None or (us, rank) < (first_us, first_rank)):
                        first_us, first_rank, first = us, rank, payload
                elif emitted:
                    out.append((key[0], None, text, us))
                elif last_us is None or (us, text) > (last_us, last):
                    last_us, last = us, text
        due = (last_us if first_us is None else first_us) + wait_us
        if not emitted and line >= due:
            out.append((key[0], first, last, last_us))
            first, last, emitted = None, None, True
        if emitted and line >= due + remember_us:
            state.remove()
        else:
            state.update((first_us, first_rank, first, last_us, last, emitted))
            state.setTimeoutTimestamp(max((due + remember_us if emitted else due) // 1000, line // 1000) + 1)
        if out:
            found = pd.DataFrame(out, columns=["key", "payload", "text", "text_us"])
            yield found.astype({"text_us": "Int64"})

    return close


def _thinned() -> Callable:
    """Of one key's rows of a batch and kind only the one that can matter goes on: repeats of a hot key end here."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            posts, texts = pdf[pdf["payload"].notna()], pdf[pdf["payload"].isna()]
            yield posts.sort_values(["key", "us", "rank"]).drop_duplicates("key")
            yield texts.sort_values(["key", "us", "text"]).drop_duplicates("key", keep="last")

    return thin


def records(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Whole rows as records of ``closed``: of equal times the smaller hash is the earlier."""
    return rows.select(
        F.col(key).alias("key"),
        F.col(at).cast("timestamp").alias("ts"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("us"),
        F.xxhash64(*rows.columns).alias("rank"),
        F.to_json(F.struct(*rows.columns), JSON).alias("payload"),
        F.lit(None).cast("string").alias("text"),
    )


def texts(rows: DataFrame, key: str, at: str, text: Column) -> DataFrame:
    """Texts as records of ``closed``."""
    none = F.lit(None).cast("string")
    when = F.col(at).cast("timestamp")
    return rows.select(F.col(key).alias("key"), when.alias("ts"), F.unix_micros(when).alias("us"), F.lit(0).cast("long").alias("rank"), none.alias("payload"), text.alias("text"))


def closed(rows: DataFrame, schema: T.StructType, delay: str, marks: DataFrame | None, wait_seconds: int, remember_seconds: int) -> DataFrame:
    """``key, record, text, text_us``: each key's earliest record with its latest text, once the key closes.

    A key closes ``wait_seconds`` after its record, and is forgotten ``remember_seconds`` after that; until then its
    repeats are dropped. A key of texts only closes with a null record, and a text that comes after the close is given
    alone, too.
    """
    thin = rows.mapInPandas(_thinned(), rows.schema)
    found = (
        marked(thin, marks, delay, "key")
        .groupBy("key")
        .applyInPandasWithState(
            _closer(wait_seconds * 1_000_000, remember_seconds * 1_000_000),
            "key string, payload string, text string, text_us long",
            _STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return found.select("key", F.from_json("payload", schema, JSON).alias("record"), "text", "text_us")
