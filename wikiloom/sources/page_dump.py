"""Page dumps: JSON lines as the wiki's content API returns them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    id string,
    title string,
    space struct<key: string>,
    version struct<number: int>,
    body struct<export_view: struct<value: string>>,
    ancestors array<struct<id: string>>
"""


def read_page_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Page rows of a dump, absent fields as '', 0 and []."""
    return flatten_pages(spark.read.schema(SCHEMA).json(folder))


def flatten_pages(dump: DataFrame) -> DataFrame:
    return dump.select(
        F.col("id").alias("page_id"),
        "title",
        F.coalesce("space.key", F.lit("")).alias("space_key"),
        F.coalesce("body.export_view.value", F.lit("")).alias("html"),
        F.coalesce("version.number", F.lit(0)).alias("version"),
        F.coalesce(
            F.transform("ancestors", lambda a: a["id"]), F.array().cast("array<string>")
        ).alias("ancestors"),
    )


def write_page_dump(pages: DataFrame, folder: str) -> None:
    """Page rows as a dump; empty fields are left out as the API leaves them out."""

    def present(column: str, empty: str | int):
        return F.when(F.col(column) != empty, F.col(column))

    pages.select(
        F.col("page_id").alias("id"),
        "title",
        F.struct(present("space_key", "").alias("key")).alias("space"),
        F.struct(present("version", 0).alias("number")).alias("version"),
        F.struct(F.struct(present("html", "").alias("value")).alias("export_view")).alias("body"),
        F.when(
            F.size("ancestors") > 0,
            F.transform("ancestors", lambda a: F.struct(a.alias("id"))),
        ).alias("ancestors"),
    ).write.mode("overwrite").json(folder)
