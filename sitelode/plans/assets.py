"""Queries of the asset audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.images import image_size
from sitelode.operators import assets
from sitelode.plans.derived import IMAGE_PAGES_SQL, INVENTORY_SQL, image_pages, inventory, with_sql
from sitelode.plans.registry import Plan, table


def references(spark: SparkSession, folder: str) -> DataFrame:
    return assets.referenced_paths(image_pages(spark, folder))


def missing(spark: SparkSession, folder: str) -> DataFrame:
    return assets.missing_assets(references(spark, folder), inventory(spark, folder))


def unused(spark: SparkSession, folder: str) -> DataFrame:
    return assets.unused_assets(references(spark, folder), inventory(spark, folder)).select("path", "length")


def largest(spark: SparkSession, folder: str) -> DataFrame:
    return assets.largest_assets(inventory(spark, folder))


def oversized(spark: SparkSession, folder: str) -> DataFrame:
    return assets.oversized_assets(inventory(spark, folder))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return assets.audit_summary(references(spark, folder), inventory(spark, folder))


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return assets.reference_counts(inventory(spark, folder), image_pages(spark, folder)).select(
        "path", "length", "basename", "refs"
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return assets.compression_queue(counted(spark, folder))


def named_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets for paths whose names are built from the documents' sources, to meet every rule."""
    n = F.col("doc_id")
    stems = [rule[1] for rule in assets.TARGET_RULES if rule[0] != "path"]
    stem = F.element_at(F.array(*[F.lit(s) for s in [*stems, "plain-"]]), (n % 9 + 1).cast("int"))
    place = F.when(n % 2 == 0, "/assets/insights/").otherwise("/assets/")
    path = F.concat(place, F.col("lang"), stem, n, F.lit(".png"))
    path = F.when(n % 3 == 0, F.concat(place, stem, n, F.lit(".png"))).otherwise(path)
    return table(spark, folder, "documents").select("doc_id", path.alias("path")).select(
        "doc_id", "path", assets.compression_target(F.col("path")).alias("t")
    ).select("doc_id", "path", "t.*")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return assets.queue_totals(queue(spark, folder))


def converted(spark: SparkSession, folder: str) -> DataFrame:
    """Every file in its converted form, and one without an original per document source."""
    files = inventory(spark, folder).select(
        F.concat(F.lit("/out/"), F.regexp_replace(assets.basename(F.col("path")), r"\.png\z", ".webp")).alias("path"),
        F.floor(F.col("length") / 3).alias("length"),
    )
    strays = table(spark, folder, "documents").groupBy("source").agg(F.max("n_chars").alias("length")).select(
        F.concat(F.lit("/out/"), "source", F.lit(".webp")).alias("path"), "length"
    )
    return files.unionAll(strays)


def matched(spark: SparkSession, folder: str) -> DataFrame:
    return assets.match_converted(converted(spark, folder), inventory(spark, folder), ("/assets", "/assets/insights"))


def reduction(spark: SparkSession, folder: str) -> DataFrame:
    return assets.reduction_report(matched(spark, folder))


def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the four known kinds and of another, from page numbers and text lengths: ``page_id, content``."""
    w = (F.length("html") % 16000 + 1).cast("bigint")
    h = (F.col("page_id") % 16000 + 1).cast("bigint")

    def le(value, width: int):
        big = F.lpad(F.hex(value), width * 2, "0")
        return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])

    def riff(kind: str, rest):
        return F.concat(F.lit("52494646" + "00" * 4 + "57454250" + kind.encode().hex()), rest, F.lit("00" * 12))

    zeros = lambda n: F.lit("00" * n)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0"))
    packed = (w - 1) + F.shiftleft(h - 1, 14)
    header = (
        F.when(F.col("page_id") % 5 == 0, png)
        .when(F.col("page_id") % 5 == 1, riff("VP8X", F.concat(zeros(8), le(w - 1, 3), le(h - 1, 3))))
        .when(F.col("page_id") % 5 == 2, riff("VP8L", F.concat(zeros(5), le(packed, 4))))
        .when(F.col("page_id") % 5 == 3, riff("VP8 ", F.concat(zeros(10), le(w, 2), le(h, 2))))
        .otherwise(F.lit("FFD8FFE0" + "00" * 40))
    )
    return table(spark, folder, "pages").select("page_id", F.unhex(header).alias("content"))


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    files = image_headers(spark, folder)
    return files.select("page_id", image_size(F.col("content")).alias("s")).select("page_id", "s.width", "s.height")


_REFS = r"""
refs AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(html, '["''(\s](/(?:assets|content)/[^"'')\s]+)', 1)), '[#?].*', '') AS path FROM image_pages)
"""
# The SQL joins every file with every page, which only a small table allows.
_COUNTED = r"""
counted AS (
  SELECT i.path, i.length, regexp_extract(i.path, '([^/]+)$', 1) AS basename,
    CAST(sum(((length(html) - length(replace(html, regexp_extract(i.path, '([^/]+)$', 1), '')))
      / length(regexp_extract(i.path, '([^/]+)$', 1)))) AS BIGINT) AS refs
  FROM inventory i CROSS JOIN image_pages GROUP BY 1, 2, 3),
queue AS (SELECT path, length, refs FROM counted WHERE length >= 512000 AND refs > 0)
"""
_MATCHED = r"""
conv AS (
  SELECT '/out/' || regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.png$', '.webp') AS path, length // 3 AS length FROM inventory
  UNION ALL SELECT '/out/' || source || '.webp', max(n_chars) FROM documents GROUP BY source),
best AS (
  SELECT stem, arg_min(path, rank) AS original, arg_min(length, rank) AS old_bytes FROM (
    SELECT regexp_extract(path, '([^/]+)\.png$', 1) AS stem, path, length,
      CASE WHEN path LIKE '/assets/insights/%' THEN 2 ELSE 1 END AS rank FROM inventory) GROUP BY 1),
matched AS (
  SELECT c.stem, c.path AS converted, c.length AS new_bytes, original, old_bytes
  FROM (SELECT *, regexp_extract(path, '/([^/]+)\.webp$', 1) AS stem FROM conv) c LEFT JOIN best b ON b.stem = c.stem)
"""

PLANS = {
    "referenced_assets": Plan(references, with_sql(IMAGE_PAGES_SQL, _REFS, select="SELECT path FROM refs")),
    "missing_assets": Plan(
        missing,
        with_sql(IMAGE_PAGES_SQL, INVENTORY_SQL, _REFS, select="SELECT path FROM refs WHERE path NOT IN (SELECT path FROM inventory)"),
    ),
    "unused_assets": Plan(
        unused,
        with_sql(
            IMAGE_PAGES_SQL, INVENTORY_SQL, _REFS, select="SELECT path, length FROM inventory WHERE path NOT IN (SELECT path FROM refs)"
        ),
    ),
    "largest_assets": Plan(
        largest,
        with_sql(
            INVENTORY_SQL,
            select="SELECT path, CAST(round(length / 1024.0) AS BIGINT) AS kb FROM inventory WHERE length > 512000 ORDER BY kb DESC, path LIMIT 20",
        ),
    ),
    "oversized_assets": Plan(
        oversized,
        with_sql(
            INVENTORY_SQL, select="SELECT path, CAST(round(length / 1024.0) AS BIGINT) AS kb FROM inventory WHERE length > 512000"
        ),
    ),
    "audit_summary": Plan(
        summary,
        with_sql(
            IMAGE_PAGES_SQL,
            INVENTORY_SQL,
            _REFS,
            select="""SELECT * FROM (
              SELECT 'referenced' AS finding, count(*) AS n FROM refs
              UNION ALL SELECT 'on_disk', count(*) FROM inventory
              UNION ALL SELECT 'missing', count(*) FROM refs WHERE path NOT IN (SELECT path FROM inventory)
              UNION ALL SELECT 'unused', count(*) FROM inventory WHERE path NOT IN (SELECT path FROM refs)
              UNION ALL SELECT 'oversized', count(*) FROM inventory WHERE length > 512000) WHERE n > 0""",
        ),
    ),
    "reference_counts": Plan(
        counted, with_sql(IMAGE_PAGES_SQL, INVENTORY_SQL, _COUNTED, select="SELECT path, length, basename, refs FROM counted")
    ),
    "compression_targets": Plan(
        named_targets,
        r"""
        WITH n AS (SELECT doc_id, lang, ['homepage-hero-', 'homepage-pillar-', 'homepage-methodology-hero-', 'homepage-insights-',
            '-hero-', 'foundations-series-', 'about-leadership-', '-card.png', 'plain-'][doc_id % 9 + 1] AS stem,
            CASE WHEN doc_id % 2 = 0 THEN '/assets/insights/' ELSE '/assets/' END AS place FROM documents),
        f AS (SELECT doc_id, place, CASE WHEN doc_id % 3 = 0 THEN stem ELSE lang || stem END || doc_id || '.png' AS name FROM n),
        t AS (SELECT *, CASE WHEN name LIKE 'homepage-hero-%' THEN 1 WHEN name LIKE 'homepage-pillar-%' THEN 2
            WHEN name LIKE 'homepage-methodology-hero-%' THEN 3 WHEN name LIKE 'homepage-insights-%' THEN 4
            WHEN name LIKE '%-hero-%' THEN 5 WHEN name LIKE '%foundations-series-%' THEN 6
            WHEN name LIKE '%about-leadership-%' THEN 7 WHEN name LIKE '%-card.png%' THEN 8
            WHEN place LIKE '%/insights/' THEN 9 ELSE 10 END AS r FROM f)
        SELECT doc_id, place || name AS path, CAST([350, 200, 200, 150, 300, 300, 120, 150, 250, 250][r] AS INTEGER) AS size_kb,
          CAST([1920, 1200, 1200, 1200, 1920, 1920, 800, 1200, 1600, 1920][r] AS INTEGER) AS width,
          ['home hero carousel', 'home pillar thumbnail', 'home methodology pillar', 'home insights teaser', 'page hero',
           'foundations series article hero', 'leadership headshot', 'insight card thumbnail', 'insight art', 'general'][r] AS note
        FROM t""",
    ),
    "compression_queue": Plan(
        queue,
        with_sql(
            IMAGE_PAGES_SQL,
            INVENTORY_SQL,
            _COUNTED,
            select="""SELECT path, length, refs, 250 AS size_kb, 1920 AS width, 'general' AS note FROM queue""",
        ),
    ),
    "compression_totals": Plan(
        totals,
        with_sql(
            IMAGE_PAGES_SQL,
            INVENTORY_SQL,
            _COUNTED,
            select="""SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS current_bytes, CAST(count(*) * 256000 AS BIGINT) AS target_bytes,
              CAST(round((1 - count(*) * 256000 / sum(length)) * 100) AS INTEGER) AS saving_pct FROM queue""",
        ),
    ),
    "converted_matches": Plan(
        matched,
        with_sql(INVENTORY_SQL, _MATCHED, select="SELECT stem, converted, new_bytes, original, old_bytes FROM matched"),
    ),
    "reduction_report": Plan(
        reduction,
        with_sql(
            INVENTORY_SQL,
            _MATCHED,
            select="""SELECT count(*) AS files, CAST(sum(old_bytes) AS BIGINT) AS old_bytes, CAST(sum(new_bytes) AS BIGINT) AS new_bytes,
              round((1 - sum(new_bytes) / sum(old_bytes)) * 100, 1) AS reduction_pct FROM matched WHERE original IS NOT NULL""",
        ),
    ),
    "image_sizes": Plan(
        image_sizes,
        """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN CAST(length(html) % 16000 + 1 AS INTEGER) END AS width,
             CASE WHEN page_id % 5 <> 4 THEN CAST(page_id % 16000 + 1 AS INTEGER) END AS height FROM pages""",
    ),
}
