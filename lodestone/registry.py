"""The register of queries with their oracles, and what several modules of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.fixtures import Tables, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FULL = "q > 0 AND uid > 0"
PRIMARY = "active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL"


def csv(column: str = "id", where: str = "") -> str:
    """Sorted distinct numbers as text, as candidates.ids() writes them."""
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {column}){where}), ','), '')"


def query(oracle: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = prelude(oracle)
        return f

    return register


def csv_array(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
