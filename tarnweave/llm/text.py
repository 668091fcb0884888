"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators define it: tab to carriage return, and the blank.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def collapsed(text: Column) -> Column:
    """Null becomes empty; every run of white space becomes one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def learns(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether a row may be learned from: crc32 of the id's decimal text, modulo ``modulus``, isn't ``held_out``.

    A null id is taken as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != held_out
