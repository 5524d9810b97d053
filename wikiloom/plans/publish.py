"""A full publish: saved documents as a plan of page updates and creations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.functions import documents, paths
from wikiloom.operators import assembly, publishing, sync
from wikiloom.session import WorkFolder, keep


def publish(
    docs: DataFrame, pages: DataFrame, parent_url: str, work: WorkFolder | None = None
) -> DataFrame:
    """``docs``: package, path, text. ``pages``: the wiki now. See ``sync.publish_plan``.

    Parts are published inside their index only, never on their own.
    """
    name = F.regexp_replace(paths.base_name(F.col("path")), r"(?i)\.md$", "")
    whole = assembly.publishable(docs, work).select(
        F.concat_ws("/", "package", "path").alias("doc_id"),
        F.col("fm.bound").alias("bound"),
        F.col("fm.url").alias("url"),
        F.col("fm.version").alias("version"),
        "body",
        F.when(name == "", "Untitled").otherwise(name).alias("fallback"),
        F.lit(parent_url).alias("parent_url"),
    )
    titled = whole.withColumns(
        {
            "title": documents.title_of(F.col("body"), F.col("fallback")),
            "markdown": documents.body_without_title(F.col("body")),
        }
    ).drop("body", "fallback")
    rendered = publishing.with_storage(titled, "markdown", work=work and work.part("storage"))
    ready = keep(work, rendered.drop("markdown"), "ready")
    wiki = keep(work, pages.select("page_id", "space_key", "title", "version"), "pages")
    return sync.publish_plan(ready, wiki, work)
