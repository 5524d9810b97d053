"""Keeping a corpus and a wiki in step: documents, bundles, guards, plans, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions import documents, urls
from wikiloom.operators import links
from wikiloom.session import WorkFolder, keep

GENERATOR = "wikiloom@1.0.0"


def _site(origin: str, base_path: str, cloud: bool) -> tuple[Column, Column, Column]:
    return F.lit(origin), F.lit(base_path), F.lit(cloud)


def page_documents(
    pages: DataFrame,
    generated: str,
    origin: str,
    base_path: str = "",
    cloud: bool = False,
    generator: str = GENERATOR,
) -> DataFrame:
    """Saved documents of pages: binding, description, title and body.

    ``pages``: page_id, title, space_key, version, markdown; ``generated`` is the run's date.
    """
    space = F.coalesce(F.col("space_key"), F.lit(""))
    url = urls.page_web_url(*_site(origin, base_path, cloud), space, F.col("page_id"))
    lines = F.array(
        F.concat(F.lit("type: "), documents.doc_type(F.col("markdown"), F.col("title"))),
        F.lit(f"generator: {generator}"),
        F.lit(f"generated: {generated}"),
        F.concat(F.lit("sourceId: "), F.col("page_id")),
        F.when(space != "", F.concat(F.lit("space: "), space)),
        F.lit("managed: true"),
    )
    head = documents.compose_front_matter(url, F.col("version"), F.array_compact(lines))
    text = F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\n"), F.col("markdown"))
    kept = [c for c in pages.columns if c != "markdown"]
    return pages.select(*kept, text.alias("text"))


def doc_types(docs: DataFrame) -> DataFrame:
    """Number of documents per type."""
    kind = documents.doc_type(F.col("markdown"), F.col("title"))
    return docs.groupBy(kind.alias("type")).agg(F.count("*").alias("docs"))


def title_body(docs: DataFrame) -> DataFrame:
    """doc_id, title, body: the first level-one heading is the title, else the file name."""
    body = F.col("body")
    return docs.select(
        "doc_id",
        documents.title_of(body, F.col("fallback")).alias("title"),
        documents.body_without_title(body).alias("body"),
    )


def bundle_documents(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """page_id, markdown: every root's document followed by its linked pages.

    ``roots``: page_id, text (with front matter). ``linked``: root_id, ord, title, markdown. A
    bundle is one document by definition; its parts are as many as the root page has links.
    """
    section = F.concat(
        F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("markdown")
    )
    sections = linked.select(F.col("root_id").alias("page_id"), "ord", section.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    tails = sections.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("_tail")
    )
    return roots.join(tails, "page_id", "left").select(
        "page_id", F.concat("text", F.coalesce("_tail", F.lit(""))).alias("markdown")
    )


def version_guard(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Bound documents with the wiki's version of their page and a state.

    Adds remote_version and state to ``local`` (page_id, version, ...), whose version becomes
    local_version. A local version of 0 or none publishes without a check; otherwise any
    difference is a conflict.
    """
    joined = local.withColumnRenamed("version", "local_version").join(
        remote.select("page_id", F.col("version").alias("remote_version")), "page_id", "left"
    )
    known = F.coalesce("local_version", F.lit(0)) != 0
    state = (
        F.when(F.col("remote_version").isNull(), "not-found")
        .when(known & (F.col("local_version") != F.col("remote_version")), "conflict")
        .otherwise("current")
    )
    return joined.withColumn("state", state)


def relink_saved(
    saved: DataFrame,
    written: DataFrame,
    path_by_id: DataFrame,
    path_by_title: DataFrame,
    origin: str = "",
) -> DataFrame:
    """rel_path, text of saved documents that were not just written and whose links changed."""
    others = saved.join(written.select("rel_path"), "rel_path", "left_anti")
    others = others.select("rel_path", "dir", "text", F.col("text").alias("_old"))
    rewritten = links.rewrite_links(
        others, path_by_id, path_by_title, origin, doc_id="rel_path", markdown="text"
    )
    return rewritten.where(F.col("text") != F.col("_old")).select("rel_path", "text")


def resolve_parents(
    docs: DataFrame, pages: DataFrame, parent_url: str = "parent_url", work: WorkFolder | None = None
) -> DataFrame:
    """Add parent_id and parent_space, found by id or else by space and title.

    Each parent is looked up once, however many documents name it, among the pages that may be it;
    as a table of its own the short list of parents goes to the pages, which are not shuffled for it.
    """
    kept = docs.columns
    ref = urls.page_url_ref(docs.select(parent_url).distinct(), parent_url, "_ref").select(
        F.col(parent_url).alias("_parent_url"),
        F.col("_ref.origin").alias("site_origin"),
        F.col("_ref.base_path").alias("site_base_path"),
        F.col("_ref.cloud").alias("site_cloud"),
        F.col("_ref.page_id").alias("want_id"),
        F.when(F.col("_ref.page_id").isNull(), F.col("_ref.space_key")).alias("want_space"),
        F.when(F.col("_ref.page_id").isNull(), F.col("_ref.title")).alias("want_title"),
    )
    ref = keep(work, ref, "parents")
    titles = ref.select(F.col("want_space").alias("space_key"), F.col("want_title").alias("title"))
    columns = pages.select("page_id", "space_key", "title")
    asked = columns.join(ref.select(F.col("want_id").alias("page_id")), "page_id", "left_semi").unionByName(
        columns.join(titles, ["space_key", "title"], "left_semi")
    )
    found = keep(work, links.resolve_targets(ref, asked).withColumnRenamed("found_id", "parent_id"), "parents-found")
    spaces = pages.select(F.col("page_id").alias("parent_id"), F.col("space_key").alias("parent_space"))
    spaces = spaces.join(found.select("parent_id"), "parent_id", "left_semi")
    placed = keep(work, found.join(spaces, "parent_id", "left"), "parents-placed")
    joined = docs.join(placed, docs[parent_url].eqNullSafe(placed["_parent_url"]), "left")
    return joined.select(
        *[docs[c] for c in kept], "site_origin", "site_base_path", "site_cloud", "parent_id", "parent_space"
    )


def publish_plan(docs: DataFrame, pages: DataFrame, work: WorkFolder | None = None) -> DataFrame:
    """What publishing every document would do.

    ``docs``: doc_id, title, storage, bound, url, version, parent_url. ``pages``: page_id,
    space_key, title, version of the wiki now. Bound documents update their page with the next
    version unless the guard finds a conflict; others create a page below their parent, version 1.
    doc_id, action, page_id, parent_id, space_key, version, url, title, payload.
    """
    bound = urls.page_url_ref(docs.where("bound"), "url", "_ref")
    local = bound.withColumn("page_id", F.col("_ref.page_id"))
    joined = version_guard(local, pages)
    next_version = F.col("remote_version") + 1
    update_action = (
        F.when(F.col("page_id").isNull(), "bad-url")
        .when(F.col("state") == "current", "updated")
        .otherwise(F.col("state"))
    )
    update_payload = F.to_json(
        F.struct(
            F.col("page_id").alias("id"),
            F.lit("page").alias("type"),
            "title",
            F.struct(next_version.alias("number")).alias("version"),
            _storage_body(),
        )
    )
    updates = joined.select(
        "doc_id",
        update_action.alias("action"),
        "page_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("space_key"),
        F.when(update_action == "updated", next_version).alias("version"),
        "url",
        "title",
        F.when(update_action == "updated", update_payload).alias("payload"),
    )
    new = resolve_parents(
        docs.where(~F.col("bound")).select("doc_id", "title", "storage", "parent_url"), pages, work=work
    )
    create_action = F.when(F.col("parent_id").isNotNull(), "created").otherwise("not-found")
    create_payload = F.to_json(
        F.struct(
            F.lit("page").alias("type"),
            "title",
            F.struct(F.col("parent_space").alias("key")).alias("space"),
            _storage_body(),
            F.array(F.struct(F.col("parent_id").alias("id"))).alias("ancestors"),
        )
    )
    creates = new.select(
        "doc_id",
        create_action.alias("action"),
        F.lit(None).cast("string").alias("page_id"),
        "parent_id",
        F.col("parent_space").alias("space_key"),
        F.when(create_action == "created", 1).alias("version"),
        F.lit(None).cast("string").alias("url"),
        "title",
        F.when(create_action == "created", create_payload).alias("payload"),
    )
    return updates.unionByName(creates)


def _storage_body() -> Column:
    value = F.struct(
        F.col("storage").alias("value"), F.lit("storage").alias("representation")
    )
    return F.struct(value.alias("storage")).alias("body")


def rebind(docs: DataFrame) -> DataFrame:
    """doc_id, text after publishing: the new binding in front of what the document already had.

    ``docs``: doc_id, text, url, version (of the published page).
    """
    fm = documents.front_matter(docs, "text", "_fm")
    head = documents.compose_front_matter(F.col("url"), F.col("version"), F.col("_fm.extra_lines"))
    gap = F.when(F.col("_fm.raw_length") == 0, "\n").otherwise("")
    return fm.select("doc_id", F.concat(head, gap, F.col("_fm.body")).alias("text"))


def run_summary(
    files: DataFrame, samples: DataFrame, relinked: DataFrame, inlined: DataFrame
) -> DataFrame:
    """One row of counts: pages, samples, relinked, parts."""

    def count(df: DataFrame, name: str) -> DataFrame:
        zeros = [F.lit(0).cast("bigint").alias(n) for n in names if n != name]
        return df.agg(F.count("*").alias(name)).select(name, *zeros)

    names = ["pages", "samples", "relinked", "parts"]
    counts = [
        count(df, name) for df, name in zip((files, samples, relinked, inlined), names)
    ]
    total = counts[0]
    for other in counts[1:]:
        total = total.unionByName(other)
    return total.agg(*[F.sum(n).alias(n) for n in names])

