"""Word windows of whole texts with built-in functions only, in time linear in the text.

An array of hashes of single words is joined with itself, shifted: two words, four, eight, and sums of
these give any number of words.  Nothing is sliced for each place, so very long texts stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_shifted(df: DataFrame, k: int, one: str, combine, prefix: str) -> tuple[DataFrame, str]:
    """df with an array column of all k-windows over array column ``one``, and its name.

    Columns stand in projections of their own, since each is used twice.  Fewer than k elements
    give an empty array.
    """
    name = {1: one}
    have = [1]

    def add(width: int, a: int, b: int) -> None:
        nonlocal df
        if width in name:
            return
        left, right = F.col(name[a]), F.col(name[b])
        n = F.greatest(F.size(left) - b, F.lit(0))
        zipped = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(a + 1), n), combine)
        name[width] = f"{prefix}{width}"
        df = df.withColumn(name[width], zipped)

    while have[-1] * 2 <= k:
        add(have[-1] * 2, have[-1], have[-1])
        have.append(have[-1] * 2)
    total = 0
    for w in sorted(have, reverse=True):
        if k & w:
            if total:
                add(total + w, total, w)
            total += w
    return df, name[k]


def hash_pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def text_pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)
