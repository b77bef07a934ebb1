"""Exact Shapley values over all coalitions of a few players."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PLAYERS = 8


def shapley(values: DataFrame, n: int) -> DataFrame:
    """(id, player, phi) of ``values`` (id, mask, value) with the worth of every coalition of n players as a bit mask."""
    if n > MOST_PLAYERS:
        raise ValueError(f"exact values are for at most {MOST_PLAYERS} players")
    table = values.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mask", "value"))), lambda s: s["value"]).alias("v"))  # 2**n numbers a row
    out = []
    for i in range(n):
        terms = []
        for mask in range(1 << n):
            if not mask >> i & 1:
                s = mask.bit_count()
                terms.append((F.col("v")[mask | 1 << i] - F.col("v")[mask]) * (factorial(s) * factorial(n - s - 1) / factorial(n)))
        out.append(F.struct(F.lit(i).alias("player"), sum(terms[1:], terms[0]).alias("phi")))
    return table.select("id", F.explode(F.array(*out)).alias("x")).select("id", "x.*")
