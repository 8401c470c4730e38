"""Asset audit: references against an inventory, orphans, oversized files, compression targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import BROWSER_SPACE, quote_pattern

REFERENCE = rf"[\"'({BROWSER_SPACE}](/(?:assets|content)/[^\"'){BROWSER_SPACE}]+)"
SIZE_FLOOR = 500 * 1024

# Compression target by file name; the first rule that applies counts.
# (test, text, target KB, width, note)
TARGET_RULES = (
    ("starts", "homepage-hero-", 350, 1920, "home hero carousel"),
    ("starts", "homepage-pillar-", 200, 1200, "home pillar thumbnail"),
    ("starts", "homepage-methodology-hero-", 200, 1200, "home methodology pillar"),
    ("starts", "homepage-insights-", 150, 1200, "home insights teaser"),
    ("holds", "-hero-", 300, 1920, "page hero"),
    ("holds", "foundations-series-", 300, 1920, "foundations series article hero"),
    ("holds", "about-leadership-", 120, 800, "leadership headshot"),
    ("holds", "-card.png", 150, 1200, "insight card thumbnail"),
    ("path", "/insights/", 250, 1600, "insight art"),
)
TARGET_DEFAULT = (250, 1920, "general")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def referenced_paths(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct asset and content paths named anywhere in the text, without fragment or query."""
    hits = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(REFERENCE), F.lit(1))).alias("path"))
    return hits.select(F.regexp_replace("path", r"[#?].*", "").alias("path")).distinct()


def missing_assets(references: DataFrame, inventory: DataFrame) -> DataFrame:
    return references.join(inventory.select("path"), "path", "left_anti")


def unused_assets(references: DataFrame, inventory: DataFrame, folder: str = "/assets/") -> DataFrame:
    return inventory.where(F.startswith("path", F.lit(folder))).join(references, "path", "left_anti")


def _kilobytes(length: Column) -> Column:
    return F.round(length / 1024, 0).cast("bigint")


def oversized_assets(inventory: DataFrame, floor: int = SIZE_FLOOR) -> DataFrame:
    return inventory.where(F.col("length") > floor).select("path", _kilobytes(F.col("length")).alias("kb"))


def largest_assets(inventory: DataFrame, n: int = 20) -> DataFrame:
    """The report's top list: Spark keeps only the best ``n`` of each partition."""
    return oversized_assets(inventory).orderBy(F.desc("kb"), "path").limit(n)


def audit_summary(references: DataFrame, inventory: DataFrame, folder: str = "/assets/") -> DataFrame:
    """Counts per finding. References and inventory meet once, in a single full join."""
    refs = references.withColumn("referenced", F.lit(True))
    files = inventory.select("path", "length").withColumn("present", F.lit(True))
    referenced = F.coalesce("referenced", F.lit(False))
    present = F.coalesce("present", F.lit(False))
    in_folder = present & F.startswith("path", F.lit(folder))
    findings = F.array(
        F.when(referenced, "referenced"),
        F.when(in_folder, "on_disk"),
        F.when(referenced & ~present, "missing"),
        F.when(in_folder & ~referenced, "unused"),
        F.when(in_folder & (F.col("length") > SIZE_FLOOR), "oversized"),
    )
    joined = refs.join(files, "path", "full")
    return (
        joined.select(F.explode(F.array_compact(findings)).alias("finding"))
        .groupBy("finding")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def name_counts(pages: DataFrame, lengths: Sequence[int], extension: str = ".png", html: str = "html") -> DataFrame:
    """How often each possible file name of one of these lengths ending in ``extension`` occurs in the corpus.

    A name counts wherever it occurs, also as the end of a longer name. The text before every extension is cut at the
    last slash (a name holds none) and at the longest length, and equal pieces are counted before their endings are
    listed, so the corpus is read once and each distinct piece is expanded once.
    """
    ending = "(?i)" + quote_pattern(extension)
    parts = F.split(F.col(html), ending, -1)
    found = F.regexp_extract_all(F.col(html), F.lit(ending), F.lit(0))
    longest = max([0, *lengths])
    piece = F.zip_with(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        found,
        lambda before, ext: F.concat(F.substring_index(F.right(before, F.lit(longest)), "/", -1), ext),
    )
    counted = pages.select(F.explode(piece).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    possible = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("piece"))
    named = counted.select(F.explode(F.transform(possible, lambda n: F.right(F.col("piece"), n))).alias("basename"), "n")
    return named.groupBy("basename").agg(F.sum("n").alias("refs"))


def reference_counts(inventory: DataFrame, pages: DataFrame, extension: str = ".png", html: str = "html") -> DataFrame:
    """Every file of the inventory with its number of occurrences; 0 marks an orphan.

    Only names as long as one in the inventory are looked for. The lengths that occur come to the driver: no more of
    them than the longest name has characters.
    """
    files = inventory.where(F.endswith(F.lower("path"), F.lit(extension))).withColumn("basename", basename(F.col("path")))
    lengths = [r[0] for r in files.select(F.length("basename")).distinct().collect()]
    counts = name_counts(pages, lengths, extension, html)
    return files.join(counts, "basename", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("bigint")))


def compression_target(path: Column) -> Column:
    """``struct<size_kb, width, note>`` of the first rule that fits the file."""
    name = basename(path)
    tests = {
        "starts": lambda text: F.startswith(name, F.lit(text)),
        "holds": lambda text: F.contains(name, F.lit(text)),
        "path": lambda text: F.contains(path, F.lit(text)),
    }

    def target(kb: int, width: int, note: str) -> Column:
        return F.struct(F.lit(kb).alias("size_kb"), F.lit(width).alias("width"), F.lit(note).alias("note"))

    out = None
    for test, text, *rest in TARGET_RULES:
        condition = tests[test](text)
        out = F.when(condition, target(*rest)) if out is None else out.when(condition, target(*rest))
    return out.otherwise(target(*TARGET_DEFAULT))


def compression_queue(counted: DataFrame, floor: int = SIZE_FLOOR) -> DataFrame:
    """Referenced files of at least ``floor`` bytes with their target. Here the floor itself is included."""
    return counted.where((F.col("length") >= floor) & (F.col("refs") > 0)).select(
        "path", "length", "refs", compression_target(F.col("path")).alias("target")
    ).select("path", "length", "refs", "target.*")


def queue_totals(queue: DataFrame) -> DataFrame:
    current, target = F.sum("length"), F.sum(F.col("size_kb").cast("bigint") * 1024)
    return queue.agg(
        F.count(F.lit(1)).alias("files"),
        current.alias("current_bytes"),
        target.alias("target_bytes"),
        F.round((1 - target / current) * 100, 0).cast("int").alias("saving_pct"),
    )


def match_converted(converted: DataFrame, originals: DataFrame, folders: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Converted files with the original of the same stem from the first folder that has one.

    ``strict`` fails the job on a file without an original; otherwise it has a null ``original``.
    """
    stem = F.regexp_replace(basename(F.col("path")), r"\.[^.]*\z", "")
    folder = F.left(F.col("path"), F.length("path") - F.length(basename(F.col("path"))) - 1)
    rank = F.array_position(F.array(*[F.lit(f) for f in folders]), folder)
    best = (
        originals.where(F.endswith("path", F.lit(".png")) & (rank > 0))
        .groupBy(stem.alias("stem"))
        .agg(F.min_by(F.struct("path", "length"), rank).alias("_o"))
        .select("stem", F.col("_o.path").alias("original"), F.col("_o.length").alias("old_bytes"))
    )
    out = converted.select(stem.alias("stem"), F.col("path").alias("converted"), F.col("length").alias("new_bytes")).join(
        best, "stem", "left"
    )
    if strict:
        missing = F.raise_error(F.concat(F.lit("no original for "), F.col("converted"))).cast("string")
        out = out.withColumn("original", F.when(F.col("original").isNull(), missing).otherwise(F.col("original")))
    return out


def reduction_report(matched: DataFrame) -> DataFrame:
    pairs = matched.where(F.col("original").isNotNull())
    old, new = F.sum("old_bytes"), F.sum("new_bytes")
    return pairs.agg(
        F.count(F.lit(1)).alias("files"),
        old.alias("old_bytes"),
        new.alias("new_bytes"),
        F.round((1 - new / old) * 100, 1).alias("reduction_pct"),
    )


def hero_assets(pages: DataFrame, page_assets: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Pages with their declared hero asset, where the asset exists in the inventory."""
    existing = page_assets.join(inventory.select(F.col("path").alias("asset")), "asset", "left_semi")
    return pages.join(existing, key, "left")
