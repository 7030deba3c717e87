"""Reproducible pseudo-random numbers from keys: the same row gets the same number on every run and cluster size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPAN = 16**7


def key_hash(key: Column | str, salt: str | int | Column = 0) -> Column:
    """28-bit integer from the md5 of ``key|salt``."""
    key = F.col(key) if isinstance(key, str) else key
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    text = F.concat(key.cast("string"), F.lit("|"), salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def unit_hash(key: Column | str, salt: str | int | Column = 0) -> Column:
    """Uniform number in [0, 1) from the key."""
    return key_hash(key, salt) / F.lit(float(HASH_SPAN))


def order_hash(key: Column | str, salt: str | int | Column = 0) -> Column:
    """Full md5 text of ``key|salt``: a random sort order."""
    key = F.col(key) if isinstance(key, str) else key
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat(key.cast("string"), F.lit("|"), salt.cast("string")))


# Largest prime below the span of the key hash.
REPLICATE_PRIME = 268_435_399


def with_replicate_hashes(df: DataFrame, key: Column | str, seed: int) -> DataFrame:
    """Two hashes per row from which ``replicate_number`` derives a number for any replicate by arithmetic alone."""
    return df.withColumn("_h1", key_hash(key, f"{seed}:a")).withColumn("_h2", key_hash(key, f"{seed}:b"))


def replicate_number(rep: Column | str) -> Column:
    """Number in 0..prime-1 for (row, replicate): uniform over rows, pairwise independent over replicates."""
    rep = F.col(rep) if isinstance(rep, str) else rep
    return F.pmod(F.col("_h1") + rep * F.col("_h2"), F.lit(REPLICATE_PRIME).cast("long"))


# Cumulative Poisson(1) probabilities; beyond the last one the weight stays at the maximum (probability below 2e-11).
POISSON_STEPS = tuple(float(v) for v in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]))
POISSON_CUTS = tuple(round(step * REPLICATE_PRIME) for step in POISSON_STEPS)
