"""A filter on key combinations that is checked where rows are read, ahead of any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 128 KB go to the tasks, however many combinations there are.
BITS = 1 << 20
_WORD = 64


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def perhaps_in(wanted: DataFrame, keys: Sequence[str], bits: int = BITS) -> Column:
    """A condition on rows with columns ``keys``: true for every combination in ``wanted``, and for few others.

    The combinations' hashes are bits of an array, put together by a grouping and handed to the rows' plan as a scalar
    subquery, so the test is an array look-up in generated code: no join, no shuffle, nothing in Python. With
    very many combinations more rows pass; an exact join has to follow. Null is a value like others.
    """
    place = _place(keys, bits)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(_WORD)).cast("int"))
    marks = wanted.select(F.shiftright(place, 6).alias("word"), mark.alias("mark"))
    # Every word has a row, so the sorted list is the array.
    blank = wanted.sparkSession.range(0, bits // _WORD, 1, 1).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mark"))
    words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    pairs = words.agg(F.array_sort(F.collect_list(F.struct("word", "mark"))).alias("pairs"))
    array = pairs.select(F.col("pairs.mark").alias("bits")).scalar()
    word = F.get(array, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(_WORD)).cast("int")) == 1
