"""Small dimension tables. Their size is fixed by constants, so they may be broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sitelode.functions.fixed_values import GOALS, QUESTIONS, TIER_COPY, TIERS


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (tuple, list)):
        return "array(" + ", ".join(map(_literal, value)) + ")"
    return str(value)


def constant_table(spark: SparkSession, rows: Sequence[Sequence[object]], columns: Sequence[str]) -> DataFrame:
    """Constants as a local relation: part of the plan, with a size Catalyst knows, and no Python at run time."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def questions(spark: SparkSession) -> DataFrame:
    rows = [(i, dim, label, opts) for i, (dim, label, opts) in enumerate(QUESTIONS)]
    return constant_table(spark, rows, ("q_idx", "dim", "label", "opts"))


def tiers(spark: SparkSession, site_origin: str = "") -> DataFrame:
    """Tier order, cut point and result copy; landing paths are prefixed with the site's origin."""
    tops = dict(TIERS)
    rows = [
        (tier, i, tops[tier], definition, description, next_step, cta, site_origin + path)
        for i, (tier, definition, description, next_step, cta, path) in enumerate(TIER_COPY)
    ]
    columns = ("tier", "ord", "max_total", "definition", "description", "next_step", "cta", "url")
    return constant_table(spark, rows, columns)


def goals(spark: SparkSession) -> DataFrame:
    return constant_table(spark, GOALS, ("letter", "phrase"))
