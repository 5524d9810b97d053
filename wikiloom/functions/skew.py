"""Lookup joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """``facts`` left join ``lookup`` on ``keys``; ``lookup`` must be unique on ``keys``.

    A page everybody links to may own a third of all facts. The facts are the left side of an
    equi-join whose result is exchanged again by another key, which is the shape in which the
    adaptive skew join cuts an oversized partition into slices by map output and gives each slice
    a copy of the one lookup row: the hot key is spread over as many tasks as its size asks for,
    and the facts are computed and shuffled once. The lookup's rows of a partition go into a hash
    table, which is even since its keys are unique; the facts run past it without a sort, so what a
    task holds does not grow with them. Nor is a small lookup broadcast once the facts are shuffled:
    each task would then read all that one task before it wrote, however much that is. Facts without
    a key match nothing; they get a salt, so that they do not meet in one partition.
    """
    keys, values = list(keys), list(values)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    salt = F.when(keyless, F.pmod(F.xxhash64(*facts.columns), F.lit(4096)) + 1)
    salted = facts.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint")))
    rows = lookup.select(*keys, *values, F.lit(0).cast("bigint").alias("_salt"))
    return salted.join(rows.hint("shuffle_hash"), [*keys, "_salt"], "left").select(*facts.columns, *values)
