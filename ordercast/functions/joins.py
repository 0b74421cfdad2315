"""Equi-joins in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null matching null; each key comes out once, then the other columns.

    ``<=>`` is still an equi-join for Spark: it plans as a hash or sort-merge join and AQE can
    split skewed partitions.
    """
    l, r = left.alias("l"), right.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    if how == "full":
        out_keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    else:
        out_keys = [F.col(f"l.{k}") for k in keys]
    return l.join(r, on, how).select(
        *out_keys,
        *[F.col(f"l.{c}") for c in left.columns if c not in keys],
        *[F.col(f"r.{c}") for c in right.columns if c not in keys],
    )
