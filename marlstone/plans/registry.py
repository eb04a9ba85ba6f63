"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import adapted, answers, dataset, evaluation, roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**dataset.QUERIES, **answers.QUERIES, **roles.QUERIES, **adapted.QUERIES, **evaluation.QUERIES}
SQL: dict[str, str] = {**dataset.SQL, **answers.SQL, **roles.SQL, **adapted.SQL, **evaluation.SQL}
