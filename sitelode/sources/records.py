"""Submission records, sitemaps and the sinks of the rewrite jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators.rewrite import changed_only
from sitelode.schemas import SITEMAP_URL, SUBMISSION, SUBMISSION_UPDATE

CORRUPT = "_corrupt_record"


def _json_lines(spark: SparkSession, path: str, schema: str, stream: bool, files: int | None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(f"{schema}, {CORRUPT} string")
    if stream and files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_submissions(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """JSON lines of submissions. A line that is not one keeps its text in ``_corrupt_record``.

    ``files``: how many a trigger of a stream takes at most.
    """
    return _json_lines(spark, path, SUBMISSION, stream, files)


def read_updates(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """The same for partial updates."""
    return _json_lines(spark, path, SUBMISSION_UPDATE, stream, files)


def write_apart(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: records as Parquet in ``path/records``, broken lines as text in ``path/broken``.

    Each batch has a folder of its own in both, and a batch that is tried again replaces what it left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Lines are parsed once for both; Spark asks for that where only the broken text is used.
        rows = batch.persist()
        try:
            rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT).write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
            rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value")).write.mode("overwrite").text(f"{path}/broken/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


def read_apart(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records and the broken lines (``value``) that ``write_apart`` left."""
    return spark.read.schema(schema).parquet(f"{path}/records/*"), spark.read.text(f"{path}/broken/*")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema(SITEMAP_URL).load(path)


def write_sitemap(entries: DataFrame, path: str) -> None:
    entries.select("loc", "lastmod", "changefreq", "priority").write.format("xml").option("rootTag", "urlset").option(
        "rowTag", "url"
    ).save(path)


def write_changed(rewritten: DataFrame, path: str, html: str = "html") -> None:
    """Only pages whose text changed, to a new place: the input corpus is never overwritten."""
    changed = changed_only(rewritten, html)
    kept = [c for c in rewritten.columns if c not in (html, "html_new", "ledger")]
    changed.select(*kept, F.col("html_new").alias(html)).write.parquet(path)


def write_url_log(redirects: DataFrame, path: str) -> None:
    redirects.select(F.concat_ws(" -> ", "old_path", "new_url").alias("value")).write.text(path)
