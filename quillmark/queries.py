"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation, files, forms, knowledge, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**evaluation.QUERIES, **knowledge.QUERIES, **texts.QUERIES, **files.QUERIES, **forms.QUERIES}
ORACLE_SQL: dict[str, str] = {**evaluation.SQL, **knowledge.SQL, **texts.SQL, **files.SQL, **forms.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of lexical neighbours, evaluated."""
    return QUERIES["flagship_knn_evaluated"](spark, sf_dir)
