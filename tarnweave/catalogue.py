"""All named queries of the library, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnweave.queries import ORACLES, QUERIES
from tarnweave.queries import build as _build  # noqa: F401  registers its queries
from tarnweave.queries import retrieval as _retrieval  # noqa: F401
from tarnweave.queries import text as _text  # noqa: F401

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["graph_rag"](spark, sf_dir)
