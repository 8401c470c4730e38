"""Registered queries: each runs operators over the given tables, most with an equivalent SQL text."""

from __future__ import annotations

from sitelode.plans import (
    assets,
    attribution,
    content,
    events,
    jsonld,
    links,
    rewrite,
    scoring,
    sources,
    streams,
)
from sitelode.plans.registry import Plan

PLANS: dict[str, Plan] = {}
for _module in (scoring, events, content, jsonld, rewrite, links, assets, attribution, sources, streams):
    PLANS.update(_module.PLANS)
