"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelode.llm import decontamination, langid, packing, periodic, personal, quality, secrets, simhash, substrings, topk, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (warc, packing, topk, substrings, secrets, decontamination, toxicity, simhash, quality, langid, personal, periodic, trie):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
