"""How a stage of derived columns is cut."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the session's shared checkpoint folder, and read from there by all that follows.

    Without ``spark.checkpoint.dir`` (or a folder set on the context) Spark refuses.
    """
    return rows.checkpoint()


def computed_once(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds (or replaces) dear columns so that they are computed once per row.

    Catalyst moves a filter below the projection that computes its column and repeats the
    computation there; over a chain of projections that repeats exponentially. It does not move a
    filter below a generator, so the columns come out of one that gives exactly one row.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*kept, F.inline_outer(F.array(made)))
