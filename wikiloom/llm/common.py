"""What the operators share: tables, column names that cannot clash, and scratch tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts of the operators define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to clash (in any case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(column(df, text).cast("string"), F.lit(""))


def row_key(doc_id: Column, content: Column) -> Column:
    """A doc_id, null or not, and what stands for the text, as one key."""
    return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.lit(" "), content.cast("string"))
