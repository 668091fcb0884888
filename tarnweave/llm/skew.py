"""Joins that hot keys can't hurt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it holds over 1/HOT of all rows; there are fewer than HOT such groups whatever the input's size.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` left join ``groups`` (one row per key, with its number of rows in ``size``), in two parts.

    Hot groups are broadcast (under HOT of them), so their rows never meet in one task; the rest is shuffled.
    """
    is_hot = F.col(size) * HOT > F.lit(n_rows)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    with_hot = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return with_hot, rest
