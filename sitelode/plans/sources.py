"""Queries that write with a sink and read back with the matching source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.images import image_size
from sitelode.operators import links
from sitelode.operators.attribution import path_date
from sitelode.operators.rewrite import ReplacePattern, observed_totals, rewrite_pages
from sitelode.plans.assets import image_headers
from sitelode.plans.content import PLANS as CONTENT
from sitelode.plans.derived import SITE_PAGES_SQL, SITE_URL, SUBMISSIONS_SQL, markdown, site_pages, submissions, with_sql
from sitelode.plans.registry import Plan, table
from sitelode.plans.rewrite import PLANS as REWRITE
from sitelode.plans.rewrite import ledger_rules
from sitelode.session import work_dir
from sitelode.sources import corpus, records


def sitemap(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "pages").select(
        F.col("url").alias("loc"),
        F.date_format(path_date(F.col("url")), "yyyy-MM-dd").alias("lastmod"),
        F.when(F.col("page_id") % 2 == 0, "weekly").otherwise("monthly").alias("changefreq"),
        (F.col("page_id") % 10 / 10).alias("priority"),
    )
    path = work_dir(spark, "sitemap")
    records.write_sitemap(entries, path)
    return records.read_sitemap(spark, path)


def submission_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines, every thirteenth of them cut off, read back with the broken ones set apart."""
    rows = submissions(spark, folder)
    line = F.to_json(F.struct(*rows.columns))
    broken = F.col("idempotency_id").cast("bigint") % 13 == 0
    path = work_dir(spark, "submissions")
    rows.select(F.when(broken, F.left(line, F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    back = records.read_submissions(spark, path)
    return back.select(
        "idempotency_id", "email", F.size("answers").alias("n_answers"), F.col(records.CORRUPT).isNotNull().alias("is_broken")
    )


def changed_pages(spark: SparkSession, folder: str) -> DataFrame:
    rule = ReplacePattern(name="r", pattern="<b>([^<]*)", replacement="<b>$1!", hint="<b>")
    path = work_dir(spark, "changed")
    records.write_changed(rewrite_pages(table(spark, folder, "pages"), [rule]), path)
    return spark.read.parquet(path).select("page_id", "html")


def url_log(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "url-log")
    records.write_url_log(links.redirects(site_pages(spark, folder), F.col("path"), SITE_URL), path)
    return spark.read.text(path)


SECTIONS = ("scripts", "node_modules", "insights 100%", "industries/a+b")


def written_pages(spark: SparkSession, folder: str, root: str) -> None:
    """Each page as a file, in one of four folders; names hold blanks and signs."""
    pages = table(spark, folder, "pages")
    name = F.concat(F.lit("p "), "page_id", F.lit(" 50%_a+b=c:ñ"))
    for i, section in enumerate(SECTIONS):
        corpus.write_files(pages.where(F.col("page_id") % len(SECTIONS) == i), f"{root}/{section}", name, F.col("html"))


def folder_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a folder of files, without those in folders that no scan enters."""
    root = work_dir(spark, "site")
    written_pages(spark, folder, root)
    return corpus.scan_files(spark, root).select("folder", "name", F.md5("html").alias("html_md5"))


def folder_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown documents, each a file, read back with their front matter."""
    root = work_dir(spark, "documents")
    docs = markdown(spark, folder)
    corpus.write_files(docs, f"{root}/content", F.concat("slug", F.lit(" %")), F.col("text"))
    return corpus.scan_markdown(spark, root, written=True).select(
        F.regexp_extract("slug", r"^doc-(\d+) %$", 1).cast("bigint").alias("doc_id"),
        F.size("meta").alias("n_keys"),
        F.try_element_at("meta", F.lit("title")).alias("title"),
        F.try_element_at("meta", F.lit("category")).alias("category"),
        "body",
    )


def written_headers(spark: SparkSession, folder: str, label: str) -> str:
    root = work_dir(spark, label)
    corpus.write_files(image_headers(spark, folder), f"{root}/assets", F.concat(F.lit("i "), "page_id", F.lit("%.png")), F.col("content"))
    return root


def file_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths of binary files; their contents aren't read."""
    return corpus.written_paths(corpus.scan_inventory(spark, written_headers(spark, folder, "inventory"), "*.txt"))


def file_image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The dimensions in the headers of binary files."""
    files = corpus.written_paths(corpus.scan_images(spark, written_headers(spark, folder, "images"), pattern="*.txt"))
    return files.select("name", image_size(F.col("content")).alias("s")).select("name", "s.width", "s.height")


def ledger_of_write(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's totals, from the job that writes the changed pages."""
    rules = ledger_rules()
    rewritten, totals = observed_totals(rewrite_pages(table(spark, folder, "pages"), rules), [rule.name for rule in rules])
    records.write_changed(rewritten, work_dir(spark, "observed"))
    return totals()


PLANS = {
    "folder_pages": Plan(
        folder_pages,
        """SELECT CASE page_id % 4 WHEN 2 THEN 'insights 100%' ELSE 'industries/a+b' END AS folder, 'p ' || page_id || ' 50%_a+b=c:ñ' AS name,
             md5(html) AS html_md5 FROM pages WHERE page_id % 4 >= 2""",
    ),
    "folder_documents": Plan(folder_documents, CONTENT["front_matter"].sql),
    "file_lengths": Plan(
        file_lengths,
        """SELECT 'i ' || page_id || '%.png' AS name,
             CAST(CASE page_id % 5 WHEN 0 THEN 24 WHEN 1 THEN 42 WHEN 2 THEN 37 WHEN 3 THEN 42 ELSE 44 END + 1 AS BIGINT) AS length FROM pages""",
    ),
    "file_image_sizes": Plan(
        file_image_sizes,
        """SELECT 'i ' || page_id || '%.png' AS name, CASE WHEN page_id % 5 <> 4 THEN CAST(length(html) % 16000 + 1 AS INTEGER) END AS width,
             CASE WHEN page_id % 5 <> 4 THEN CAST(page_id % 16000 + 1 AS INTEGER) END AS height FROM pages""",
    ),
    "ledger_of_write": Plan(ledger_of_write, REWRITE["rewrite_ledger"].sql),
    "sitemap_entries": Plan(
        sitemap,
        """SELECT url AS loc, '2026-05-' || lpad(CAST(('0x' || substr(sha256(url), 1, 2))::INT % 15 + 1 AS VARCHAR), 2, '0') AS lastmod,
             CASE WHEN page_id % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS changefreq, page_id % 10 / 10 AS priority FROM pages""",
    ),
    "submission_lines": Plan(
        submission_lines,
        with_sql(
            SUBMISSIONS_SQL,
            select="""SELECT CASE WHEN c % 13 <> 0 THEN idempotency_id END AS idempotency_id, CASE WHEN c % 13 <> 0 THEN email END AS email,
              CASE WHEN c % 13 <> 0 THEN CAST(len(a) AS INTEGER) END AS n_answers, c % 13 = 0 AS is_broken FROM submissions_all""",
        ),
    ),
    "changed_pages": Plan(
        changed_pages,
        r"""SELECT page_id, regexp_replace(html, '<b>([^<]*)', '<b>\1!', 'g') AS html FROM pages WHERE html LIKE '%<b>%'""",
    ),
    "url_log": Plan(
        url_log, with_sql(SITE_PAGES_SQL, select="SELECT path || ' -> ' || replace(path, '.html', '/') AS value FROM site")
    ),
}
