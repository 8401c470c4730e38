"""Queries that rewrite the page corpus by rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.operators import assets
from sitelode.operators import rewrite as rw
from sitelode.operators.tokens import held_tokens
from sitelode.plans.derived import IMAGE_PAGES_SQL, INVENTORY_SQL, image_pages, inventory, with_sql
from sitelode.plans.registry import Plan, table

Rules = Callable[[], Sequence[rw.Rule]]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def applied(rules: Rules, source: Callable[[SparkSession, str], DataFrame] = pages) -> Callable[[SparkSession, str], DataFrame]:
    """The new text of each page, with status and count of the only rule."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = rw.rewrite_pages(source(spark, folder), rules())
        entry = F.get("ledger", 0)
        return out.select("page_id", "html_new", entry["status"].alias("status"), entry["n_repl"].alias("n_repl"))

    return run


def lined_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in which the footer line comes after a closing row, on lines of their own."""
    html = F.replace("html", F.lit("</article>"), F.lit('</article>\n    <div class="row">\n    </div>\n'))
    html = F.replace(html, F.lit("<footer>"), F.lit('    <p class="made">Built here</p>\n<footer>'))
    early = F.replace("html", F.lit("</article>"), F.lit('<p class="made">x</p></article>\n    <div class="row">\n'))
    return pages(spark, folder).select("page_id", F.when(F.col("page_id") % 4 == 0, early).otherwise(html).alias("html"))


def slashed_images(spark: SparkSession, folder: str) -> DataFrame:
    html = F.replace("html", F.lit('loading="lazy">'), F.lit('  /\n loading="lazy">'))
    return image_pages(spark, folder).select("page_id", html.alias("html"))


def styled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a style sheet link; some carry a version already, and all a script include."""
    version = F.when(F.col("page_id") % 3 == 0, "?v=1").otherwise("")
    head = F.concat(
        F.lit('<link href="/styles.css'), version, F.lit('">\n  <script src="/js/legacy.js" defer></script></head>')
    )
    return pages(spark, folder).select("page_id", F.replace("html", F.lit("</head>"), head).alias("html"))


def menu_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose navigation has buttons with a key each."""
    html = F.regexp_replace("html", r'<li><a href="/([^"]*)">([^<]*)</a>', '<li><button data-key="$1">$2</button>')
    return pages(spark, folder).select("page_id", html.alias("html"))


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    out = rw.enrich_images(image_pages(spark, folder), inventory(spark, folder), "page_id")
    return out.select("page_id", "html_new")


def ledger_rules() -> list[rw.Rule]:
    return [
        rw.word("rename", "the", "THE", outside=rw.COMMENTS_AND_STYLES),
        rw.Insert(name="banner", text="<p>new</p>", anchors=["<article>"], after=True, guard="track(1"),
        rw.ReplacePattern(name="comment", pattern=r"<!--\s*ad \d+\s*-->", replacement="", hint="<!-- ad 7"),
        rw.ReplaceText(name="absent", old="<main>", new="<main id='x'>"),
        rw.ReplaceText(name="same", old="</body>", new="</body>"),
    ]


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return rw.ledger_totals(rw.rewrite_pages(pages(spark, folder), ledger_rules()))


TOKENS = ("%%%", "&amp;&amp;&amp;", "###", "$$$", "***", "spam", "</nav>")


def residual(spark: SparkSession, folder: str) -> DataFrame:
    return rw.residual_tokens(pages(spark, folder), TOKENS, ["page_id"])


def by_table(spark: SparkSession, folder: str) -> DataFrame:
    """Buttons become links whose addresses are looked up in a table of the documents' words; other buttons stay."""
    words = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("key"))
    known = words.distinct().where(F.length("key") % 2 == 0)
    values = known.select("key", F.concat(F.lit("/w$1/"), "key", F.lit("/")).alias("value"))

    def build(match: Column, value: Column) -> Column:
        return F.concat(F.lit('<a href="'), value, F.lit('">'), F.regexp_extract(match, r">([^<]*)<", 1), F.lit("</a>"))

    out = rw.replace_by_table(menu_pages(spark, folder), values, "page_id", r'<button data-key="([^"]+)">([^<]*)</button>', 1, build)
    entry = F.get("ledger", 0)
    return out.select("page_id", "html_new", entry["status"].alias("status"), entry["n_repl"].alias("n_repl"))


def held(spark: SparkSession, folder: str) -> DataFrame:
    """Which pages hold which of the documents' longer words, also inside other words."""
    words = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("token"))
    return held_tokens(pages(spark, folder), words, ["page_id"])


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    out = rw.token_coverage(pages(spark, folder), "<b>", "&copy; www.")
    return out.select("page_id", "status")


def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as they are, and descriptions set by a rule first."""
    rule = rw.Insert(
        name="meta",
        text=F.concat(F.lit('<meta name="description" content="Page '), F.col("page_id"), F.lit('">')),
        anchors=["</head>"],
    )
    out = rw.rewrite_pages(pages(spark, folder), [rule]).select("page_id", F.col("html_new").alias("html"))
    return rw.page_metadata(out, ["page_id"])


def subset_swap(spark: SparkSession, folder: str) -> DataFrame:
    """A literal swap on the pages whose number is that of a toxic document."""
    chosen = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    subset = pages(spark, folder).join(chosen, "page_id", "left_semi")
    return applied(lambda: [rw.ReplaceText(name="swap", old="</h1>", new="</h1><hr>", first=True)], lambda *_: subset)(spark, folder)


def hero_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the card of their host as background, where that asset exists."""
    corpus = pages(spark, folder)
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    ending = F.when(F.col("page_id") % 2 == 0, "-card.png").otherwise("-none.png")
    wanted = corpus.select("page_id", F.concat(F.lit("/assets/insights/"), host, ending).alias("asset"))
    out = assets.hero_assets(corpus, wanted, inventory(spark, folder), "page_id")
    rule = rw.ReplaceText(
        name="hero",
        old="<article>",
        new=F.concat(F.lit("<article style=\"background-image: url('"), F.col("asset"), F.lit("');\">")),
        first=True,
        scope=F.col("asset").isNotNull(),
    )
    return applied(lambda: [rule], lambda *_: out)(spark, folder)


RULES: dict[str, tuple[Rules, Callable[[SparkSession, str], DataFrame], str]] = {
    "replace_text": (
        lambda: [rw.ReplaceText(name="r", old="</p><p>", new="</p>\n<p>$1")],
        pages,
        """SELECT page_id, replace(html, '</p><p>', '</p>' || chr(10) || '<p>$1') AS html_new,
             CASE WHEN html LIKE '%</p><p>%' THEN 'updated' ELSE 'no_match' END AS status,
             CAST((length(html) - length(replace(html, '</p><p>', ''))) / 7 AS INTEGER) AS n_repl FROM pages""",
    ),
    "replace_word": (
        lambda: [rw.word("r", "the", "THE")],
        pages,
        r"""SELECT page_id, regexp_replace(html, '\bthe\b', 'THE', 'g') AS html_new,
             CASE WHEN regexp_matches(html, '\bthe\b') THEN 'updated' ELSE 'no_match' END AS status,
             CAST(len(regexp_extract_all(html, '\bthe\b')) AS INTEGER) AS n_repl FROM pages""",
    ),
    "replace_outside_comments": (
        lambda: [rw.word("r", "ad", "advert", outside=rw.COMMENTS_AND_STYLES)],
        pages,
        r"""SELECT page_id, regexp_replace(regexp_replace(html, '\bad\b', 'advert', 'g'), '<!-- advert (\d+) -->', '<!-- ad \1 -->', 'g') AS html_new,
             'updated' AS status, CAST(len(regexp_extract_all(html, '\bad\b')) - len(regexp_extract_all(html, '<!-- ad \d+ -->')) AS INTEGER) AS n_repl FROM pages""",
    ),
    "insert_at_first_anchor": (
        lambda: [rw.Insert(name="r", text="<hr>$1", anchors=["<p>"], guard="&copy; www.")],
        pages,
        """SELECT page_id, CASE WHEN html LIKE '%&copy; www.%' OR html NOT LIKE '%<p>%' THEN html
               ELSE substr(html, 1, strpos(html, '<p>') - 1) || '<hr>$1' || substr(html, strpos(html, '<p>')) END AS html_new,
             CASE WHEN html LIKE '%&copy; www.%' THEN 'already' WHEN html NOT LIKE '%<p>%' THEN 'no_match' ELSE 'updated' END AS status,
             CASE WHEN html LIKE '%&copy; www.%' OR html NOT LIKE '%<p>%' THEN 0 ELSE 1 END AS n_repl FROM pages""",
    ),
    "insert_at_last_anchor": (
        lambda: [rw.Insert(name="r", text="<hr>", anchors=["<br>", "</article>"], last=frozenset({"<br>"}))],
        pages,
        r"""SELECT page_id, CASE WHEN html LIKE '%<br>%' THEN regexp_replace(html, '(?s)^(.*)<br>', '\1<hr><br>')
               ELSE replace(html, '</article>', '<hr></article>') END AS html_new, 'updated' AS status, 1 AS n_repl FROM pages""",
    ),
    "replace_first_block": (
        lambda: [
            rw.ReplacePattern(name="r", pattern=r"<ul>([\s\S]*?)</ul>(</nav>)", replacement="<ol>$1</ol>$2<hr>", hint="<ul>", first=True)
        ],
        pages,
        r"""SELECT page_id, regexp_replace(html, '(?s)<ul>(.*?)</ul>(</nav>)', '<ol>\1</ol>\2<hr>') AS html_new,
             'updated' AS status, 1 AS n_repl FROM pages""",
    ),
    "insert_at_alternative_anchor": (
        lambda: [rw.Insert(name="r", text="X", anchors=["cheap-pills", "spam-farm", "<b>"], guard="www.theres.")],
        pages,
        """WITH a AS (SELECT page_id, html, CASE WHEN html LIKE '%cheap-pills%' THEN 'cheap-pills' WHEN html LIKE '%spam-farm%' THEN 'spam-farm'
               WHEN html LIKE '%<b>%' THEN '<b>' END AS k, html LIKE '%www.theres.%' AS g FROM pages)
           SELECT page_id, CASE WHEN g OR k IS NULL THEN html ELSE substr(html, 1, strpos(html, k) - 1) || 'X' || substr(html, strpos(html, k)) END AS html_new,
             CASE WHEN g THEN 'already' WHEN k IS NULL THEN 'no_match' ELSE 'updated' END AS status, CASE WHEN g OR k IS NULL THEN 0 ELSE 1 END AS n_repl FROM a""",
    ),
    "all_or_nothing": (
        lambda: [
            rw.AllOf(
                name="r",
                parts=[
                    rw.ReplaceText(name="", old="<b>", new="<strong>"),
                    rw.Insert(name="", text="<i>", anchors=["<strong>"], after=True),
                    rw.ReplaceText(name="", old="www.", new="WWW."),
                ],
            )
        ],
        pages,
        r"""WITH a AS (SELECT page_id, html, html LIKE '%<b>%' AND html LIKE '%www.%' AS ok FROM pages)
           SELECT page_id, CASE WHEN ok THEN replace(regexp_replace(replace(html, '<b>', '<strong>'), '<strong>', '<strong><i>'), 'www.', 'WWW.') ELSE html END AS html_new,
             CASE WHEN ok THEN 'updated' ELSE 'no_match' END AS status,
             CAST(CASE WHEN ok THEN 1 + (length(html) - length(replace(html, '<b>', ''))) / 3 + (length(html) - length(replace(html, 'www.', ''))) / 4 ELSE 0 END AS INTEGER) AS n_repl FROM a""",
    ),
    "replace_by_key": (
        lambda: [
            rw.ReplaceByKey(
                name="r",
                pattern=r'<button data-key="([^"]+)">([^<]*)</button>',
                key_group=1,
                values={"the": "/the/", "in": "/in/", "de": "/de/$1", "und": "/und/"},
                build=lambda m, value: F.concat(
                    F.lit('<a href="'), value, F.lit('">'), F.regexp_extract(m, r">([^<]*)<", 1), F.lit("</a>")
                ),
            )
        ],
        menu_pages,
        r"""WITH m AS (SELECT page_id, regexp_replace(html, '<li><a href="/([^"]*)">([^<]*)</a>', '<li><button data-key="\1">\2</button>', 'g') AS html FROM pages),
           c AS (SELECT *, CAST(len(regexp_extract_all(html, '<button data-key="(the|in|de|und)">')) AS INTEGER) AS n FROM m)
           SELECT page_id, regexp_replace(regexp_replace(html, '<button data-key="(the|in|und)">([^<]*)</button>', '<a href="/\1/">\2</a>', 'g'),
               '<button data-key="de">([^<]*)</button>', '<a href="/de/$1">\1</a>', 'g') AS html_new,
             CASE WHEN n > 0 THEN 'updated' ELSE 'no_match' END AS status, n AS n_repl FROM c""",
    ),
    "move_line": (
        lambda: [
            rw.MoveLine(
                name="r",
                line_pattern=r'(?m)^    <p class="made">[^<]*</p>\r?\n',
                marker='<p class="made"',
                above='    <div class="row">',
            )
        ],
        lined_pages,
        """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '</article>', '<p class="made">x</p></article>' || chr(10) || '    <div class="row">' || chr(10))
               ELSE replace(html, '</article>', '</article>' || chr(10) || '    <p class="made">Built here</p>' || chr(10) || '    <div class="row">' || chr(10) || '    </div>' || chr(10)) END AS html_new,
             CASE WHEN page_id % 4 = 0 THEN 'already' ELSE 'updated' END AS status, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS n_repl FROM pages""",
    ),
    "page_dependent_value": (
        lambda: [
            rw.ReplaceText(
                name="r",
                old="<nav>",
                new=F.concat(F.lit("<nav"), F.when(F.contains("url", F.lit("/en/")), ' aria-current="page"').otherwise(""), F.lit(">")),
                first=True,
            )
        ],
        pages,
        """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN replace(html, '<nav>', '<nav aria-current="page">') ELSE html END AS html_new,
             CASE WHEN url LIKE '%/en/%' THEN 'updated' ELSE 'unchanged' END AS status, CASE WHEN url LIKE '%/en/%' THEN 1 ELSE 0 END AS n_repl FROM pages""",
    ),
    "hero_priority": (
        lambda: [rw.hero_priority("<ul><li>")],
        image_pages,
        r"""SELECT page_id, regexp_replace(html, '(<ul><li><img[^>]*) loading="lazy">', '\1 fetchpriority="high" loading="eager">') AS html_new,
             'updated' AS status, 1 AS n_repl FROM image_pages""",
    ),
    "tidy_void_tags": (
        lambda: [rw.tidy_void_tags()],
        slashed_images,
        """SELECT page_id, html AS html_new, 'updated' AS status, CAST(len(regexp_extract_all(html, '<img')) AS INTEGER) AS n_repl FROM image_pages""",
    ),
    "drop_script": (
        lambda: [rw.drop_script("legacy.js")],
        styled_pages,
        """SELECT page_id, replace(html, '</head>', '<link href="/styles.css' || CASE WHEN page_id % 3 = 0 THEN '?v=1' ELSE '' END || '"></head>') AS html_new,
             'updated' AS status, 1 AS n_repl FROM pages""",
    ),
    "asset_version": (
        lambda: [rw.asset_version("/styles.css", "2")],
        styled_pages,
        """SELECT page_id, replace(html, '</head>', '<link href="/styles.css?v=2">' || chr(10) || '  <script src="/js/legacy.js" defer></script></head>') AS html_new,
             'updated' AS status, 1 AS n_repl FROM pages""",
    ),
    "remove_section": (
        lambda: [rw.ReplacePattern(name="r", pattern=r'\s*<!-- ad \d+ --><div class="ad">[\s\S]*?</div>\s*', replacement="\n", first=True)],
        pages,
        r"""SELECT page_id, regexp_replace(html, '(?s)\s*<!-- ad \d+ --><div class="ad">.*?</div>\s*', chr(10)) AS html_new, 'updated' AS status, 1 AS n_repl FROM pages""",
    ),
    "strict_swap": (
        lambda: [rw.ReplaceText(name="r", old="</article><footer>", new="</article>\n<footer>", strict=True)],
        pages,
        """SELECT page_id, replace(html, '</article><footer>', '</article>' || chr(10) || '<footer>') AS html_new, 'updated' AS status, 1 AS n_repl FROM pages""",
    ),
}

PLANS = {
    name: Plan(applied(rules, source), with_sql(IMAGE_PAGES_SQL, select=sql) if "FROM image_pages" in sql else sql)
    for name, (rules, source, sql) in RULES.items()
}
PLANS |= {
    "image_dimensions": Plan(
        dimensions,
        with_sql(
            IMAGE_PAGES_SQL,
            INVENTORY_SQL,
            r"""tags AS (SELECT page_id, unnest(p) AS part, unnest(range(len(p))) AS i FROM (SELECT page_id, string_split(html, '<img src="') AS p FROM image_pages)),
            sized AS (SELECT page_id, i, CASE WHEN i = 0 THEN part
              WHEN width IS NULL THEN '<img src="' || part
              ELSE '<img src="' || path || '" width="' || width || '" height="' || height || '"' || substr(part, length(path) + 2) END AS part
              FROM tags LEFT JOIN inventory ON path = regexp_extract(part, '^([^"]+)"', 1))""",
            select="SELECT page_id, string_agg(part, '' ORDER BY i) AS html_new FROM sized GROUP BY 1",
        ),
    ),
    "rewrite_ledger": Plan(
        ledger,
        r"""
        WITH b AS (SELECT *, html LIKE '%track(1%' AS g, html LIKE '%<!-- ad 7%' AS h, len(regexp_extract_all(
            regexp_replace(html, '(?s)<!--.*?-->|<style.*?</style>', '<>', 'g'), '\bthe\b')) AS n FROM pages),
        e AS (
          SELECT 'rename' AS rule, CASE WHEN n > 0 THEN 'updated' ELSE 'no_match' END AS status, n FROM b
          UNION ALL SELECT 'banner', CASE WHEN g THEN 'already' ELSE 'updated' END, CASE WHEN g THEN 0 ELSE 1 END FROM b
          UNION ALL SELECT 'comment', CASE WHEN h THEN 'updated' ELSE 'no_match' END, CASE WHEN h THEN 1 ELSE 0 END FROM b
          UNION ALL SELECT 'absent', 'no_match', 0 FROM b
          UNION ALL SELECT 'same', CASE WHEN contains(html, '</body>') THEN 'unchanged' ELSE 'no_match' END, 0 FROM b)
        SELECT rule, status, count(*) AS pages, CAST(sum(n) AS BIGINT) AS n_repl FROM e GROUP BY 1, 2""",
    ),
    "residual_tokens": Plan(
        residual,
        "SELECT page_id, token FROM pages, (VALUES " + ", ".join(f"('{t}')" for t in TOKENS) + ") AS t(token) WHERE contains(html, token)",
    ),
    "replace_by_table": Plan(
        by_table,
        r"""WITH m AS (SELECT page_id, regexp_replace(html, '<li><a href="/([^"]*)">([^<]*)</a>', '<li><button data-key="\1">\2</button>', 'g') AS html FROM pages),
           w AS (SELECT key, 1 AS known FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS key FROM documents) WHERE length(key) % 2 = 0),
           parts AS (SELECT page_id, unnest(p) AS part, unnest(range(len(p))) AS i FROM (SELECT page_id, string_split(html, '<button data-key="') AS p FROM m)),
           cut AS (SELECT page_id, i, part, CASE WHEN i > 0 THEN regexp_extract(part, '^([^"]+)">([^<]*)</button>', 1) END AS key,
             regexp_extract(part, '^([^"]+)">([^<]*)</button>', 2) AS name, regexp_extract(part, '^([^"]+)">([^<]*)</button>', 0) AS whole FROM parts),
           done AS (SELECT page_id, i, known IS NOT NULL AS hit, CASE WHEN i = 0 THEN part
             WHEN known IS NULL THEN '<button data-key="' || part
             ELSE '<a href="/w$1/' || key || '/">' || name || '</a>' || substr(part, length(whole) + 1) END AS part
             FROM cut LEFT JOIN w USING (key))
           SELECT page_id, string_agg(part, '' ORDER BY i) AS html_new, CASE WHEN bool_or(hit) THEN 'updated' ELSE 'no_match' END AS status,
             CAST(sum(CAST(hit AS INTEGER)) AS INTEGER) AS n_repl FROM done GROUP BY 1""",
    ),
    "held_tokens": Plan(
        held,
        """SELECT page_id, token FROM pages, (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS token FROM documents) WHERE contains(html, token)""",
    ),
    "token_coverage": Plan(
        coverage,
        """SELECT page_id, CASE WHEN NOT contains(html, '<b>') THEN 'no_hook' WHEN contains(html, '&copy; www.') THEN 'already' ELSE 'to_do' END AS status FROM pages""",
    ),
    "page_metadata": Plan(
        page_metadata,
        """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'Page ' || page_id AS description,
             '' AS og_title, '' AS og_description FROM pages""",
    ),
    "subset_swap": Plan(
        subset_swap,
        """SELECT page_id, replace(html, '</h1>', '</h1><hr>') AS html_new, 'updated' AS status, 1 AS n_repl FROM pages
           WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    ),
    "hero_assets": Plan(
        hero_assets,
        """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '<article>', '<article style="background-image: url(''/assets/insights/'
               || regexp_extract(url, '^https?://([^/?#]+)', 1) || '-card.png'');">') ELSE html END AS html_new,
             CASE WHEN page_id % 2 = 0 THEN 'updated' ELSE 'out_of_scope' END AS status, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS n_repl FROM pages""",
    ),
}
