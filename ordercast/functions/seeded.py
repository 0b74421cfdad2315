"""Repeatable pseudo-random columns.

They hash column values with a seed, so a row gets the same draw however the data is
partitioned, and a lost task that runs again draws the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits: exact in a double


def _digest(seed: int | str, *keys: Column) -> Column:
    parts = [F.coalesce(k.cast("string"), F.lit("NA")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A text key that puts rows in a seed-dependent random order."""
    return _digest(seed, *keys)


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform draw in (0, 1)."""
    head = F.conv(F.substring(_digest(seed, *keys), 1, _HEX_DIGITS), 16, 10).cast("double")
    return (head + 0.5) / float(16**_HEX_DIGITS)


def hash_choice(n: int, seed: int | str, *keys: Column) -> Column:
    """Uniform integer in 1..n."""
    return F.floor(hash_uniform(seed, *keys) * n).cast("int") + 1


def hash_normal(mean: float, sd: float, seed: int | str, *keys: Column) -> Column:
    """Normal draw (Box-Muller on two uniforms)."""
    radius = F.sqrt(-2.0 * F.ln(hash_uniform(f"{seed}:r", *keys)))
    angle = 2.0 * math.pi * hash_uniform(f"{seed}:a", *keys)
    return mean + sd * (radius * F.cos(angle))
