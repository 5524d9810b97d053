"""Relative document paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikiloom.functions import text as t
from wikiloom.functions.urls import decode_component


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(
        F.concat(folder, F.lit("/"), name)
    )


def _parts(folder: Column) -> Column:
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))


def resolve_path(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``; null if absolute, a URL, or climbing above the root."""
    absolute = target.rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|/|#)")
    steps = F.filter(F.split(decode_component(target), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.lit(True).alias("inside"), _parts(folder).alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        size = F.size(acc["parts"])
        up = s == ".."
        shorter = F.slice(acc["parts"], F.lit(1), F.greatest(size - 1, F.lit(0)))
        return F.struct(
            (acc["inside"] & (~up | (size > 0))).alias("inside"),
            F.when(up, shorter).otherwise(F.concat(acc["parts"], F.array(s))).alias("parts"),
        )

    walked = F.aggregate(
        steps,
        start,
        step,
        lambda acc: F.when(
            acc["inside"] & (F.size(acc["parts"]) > 0), F.array_join(acc["parts"], "/")
        ),
    )
    return F.when(~absolute, walked)


def relative_md_link(from_dir: Column, to_path: Column) -> Column:
    """The link from a document in ``from_dir`` to the document ``to_path``."""
    both = F.struct(_parts(from_dir).alias("source"), F.split(to_path, "/").alias("target"))

    def shared(x: Column) -> Column:
        folders = F.slice(x["target"], F.lit(1), F.size(x["target"]) - 1)
        same = F.zip_with(x["source"], folders, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
        return t.bind(
            same,
            lambda flags: F.when(
                F.array_contains(flags, False), F.array_position(flags, False) - 1
            ).otherwise(F.size(flags)),
        ).cast("int")

    def link(x: Column, n: Column) -> Column:
        up = F.size(x["source"]) - n
        return F.concat(
            F.when(up > 0, F.repeat(F.lit("../"), up)).otherwise("./"),
            F.array_join(F.slice(x["target"], n + 1, F.size(x["target"])), "/"),
            F.lit(".md"),
        )

    return t.bind(both, lambda x: t.bind(shared(x), lambda n: link(x, n)))
