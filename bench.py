"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from sitelode.plans import PLANS
from sitelode.session import local_session

HEADLINE = (
    "submissions_scored",
    "submissions_payload",
    "dimension_profile",
    "first_posts",
    "pain_points",
    "click_events",
    "gated_events",
    "event_totals",
    "front_matter",
    "markdown_blocks",
    "rendered_bodies",
    "series_navigation",
    "prerendered_pages",
    "json_blocks",
    "article_blocks",
    "faq_blocks",
    "replace_outside_comments",
    "all_or_nothing",
    "replace_by_key",
    "image_dimensions",
    "rewrite_ledger",
    "residual_tokens",
    "link_table",
    "link_targets",
    "migrated_pages",
    "missing_assets",
    "page_bylines",
    "related_items",
    "reference_counts",
    "audit_summary",
    "stream_gated_events",
    "stream_first_posts",
    "stream_scored_submissions",
    "stream_pain_points",
    "stream_retries",
    "stream_update_lines",
    "replace_by_table",
    "held_tokens",
    "json_ld_nodes",
    "ledger_of_write",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    shared = tempfile.mkdtemp(prefix="sitelode-bench-")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, **{"spark.checkpoint.dir": shared})
    PLANS["submissions_scored"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds, again = {}, {}
    for name in names:
        for took in (seconds, again):
            # The second run tells work from compilation; streams are run once.
            if took is again and name.startswith("stream_"):
                continue
            started = time.perf_counter()
            PLANS[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "again": again,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
