"""One query per operator over the test tables, as registered in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.functions import documents, paths
from wikiloom.operators import assembly, lines, links, markup, publishing, sync, tree
from wikiloom.plans.download import download, run_download
from wikiloom.plans.publish import publish
from wikiloom.session import WorkFolder, scratch_folder
from wikiloom.sources import corpus, page_dump
from wikiloom.streaming import revisions
from wikiloom.views import ORIGIN, table, view

GENERATED = "2024-01-31"
BLOCK_LIMIT = 4
APPENDIX = "Additional materials"
GUARD_TIME = "2024-01-30 12:00:00"
PARENT_URL = f"{ORIGIN}/display/GEO/EUROPE"
CATALOGUE = "CAT"
ORDERS = "ORD"

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs ------------------------------------------------------------------------------
def _pages(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "wiki_pages")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.col("page_id").cast("bigint"))


def _saved(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(view(spark, d, "wiki_saved"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return links.page_links(view(spark, d, "wiki_links_html"), ORIGIN)


def _sources(spark: SparkSession, d: str, html: DataFrame | None = None) -> DataFrame:
    orders = (view(spark, d, "wiki_links_html") if html is None else html).select("page_id")
    return orders.withColumn("space_key", F.lit(ORDERS))


def _kept_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The link pages and all pages, written once: each use of the views would join and shuffle their tables again."""
    work = WorkFolder.scratch(spark, "inputs")
    return work.keep(view(spark, d, "wiki_links_html"), "html"), work.keep(_pages(spark, d), "pages")


def _order_docs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "order_docs")


def _conv_docs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "conv_docs")


def _versioned_pages(spark: SparkSession, d: str, pages: DataFrame | None = None) -> DataFrame:
    version = (F.col("page_id").cast("bigint") % 2 + 1).cast("int")
    return (_pages(spark, d) if pages is None else pages).withColumn("version", version)


def _linked_docs(spark: SparkSession, d: str) -> DataFrame:
    """The link pages as Markdown, spread over three folders."""
    markdown = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    number = F.col("page_id").cast("bigint") % 3
    folder = F.when(number == 0, "").when(number == 1, "catalogue").otherwise("geo/orders")
    return view(spark, d, "wiki_links_html").select(
        F.col("page_id").alias("doc_id"), folder.alias("dir"), markdown.alias("markdown")
    )


def _html_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages, storage pages and issue pages under one id space."""

    def part(df: DataFrame, prefix: str, html: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), F.col("page_id").cast("string")).alias("page_id"),
            F.col(html).alias("html"),
        )

    return (
        part(table(spark, d, "pages"), "raw-", "html")
        .unionByName(part(view(spark, d, "storage_pages"), "storage-", "storage"))
        .unionByName(part(view(spark, d, "issue_pages"), "issue-", "html"))
    )


def _whole_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All pages as fetched and placed, and the saved corpus."""
    saved = _saved(spark, d)
    work = WorkFolder.scratch(spark, "run")
    fetched = _numbered(_pages(spark, d))
    fetched = work.keep(fetched, "fetched")
    slugs = work.keep(tree.assign_slugs(fetched, saved, work), "slugs")
    placed = fetched.join(tree.place_in_tree(fetched, saved, slugs), "page_id")
    return work.keep(placed.select("page_id", "title", "path", "ord"), "placed"), saved


# --- sources and sinks ---------------------------------------------------------------------
def page_dump_flatten(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("bigint")
    html = F.when(number % 2 == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>"))).otherwise("")
    pages = _pages(spark, d).withColumns(
        {"html": html, "version": (number % 5).cast("int")}
    )
    folder = scratch_folder(spark, "dump")
    page_dump.write_page_dump(pages, folder)
    return page_dump.read_page_dump(spark, folder).withColumn(
        "ancestors", F.array_join("ancestors", ",")
    )


def page_by_title(spark: SparkSession, d: str) -> DataFrame:
    return links.page_by_title(_pages(spark, d))


def saved_scan(spark: SparkSession, d: str) -> DataFrame:
    saved = view(spark, d, "wiki_saved")
    folder = scratch_folder(spark, "saved")
    corpus.write_files(saved, folder)
    outside = saved.orderBy("page_id").limit(1)
    places = F.explode(F.array(F.lit("x.samples/inside"), F.lit(".hidden/inside")))
    corpus.write_files(outside.withColumn("rel_path", places), folder)
    return corpus.read_saved(spark, folder)


def corpus_write_readback(spark: SparkSession, d: str) -> DataFrame:
    saved = view(spark, d, "wiki_saved").select("page_id", "rel_path", "text")
    samples = saved.select(
        "page_id",
        "rel_path",
        F.explode(F.array(F.lit("a.txt"), F.lit("b.txt"))).alias("name"),
        F.lit("first\n").alias("content"),
    )
    folder = scratch_folder(spark, "corpus")
    corpus.write_corpus(saved, samples, folder)
    again = F.col("page_id").cast("bigint") % 2 == 0
    corpus.write_corpus(
        saved.where(again).withColumn("text", F.concat("text", F.lit("again\n"))),
        samples.where(again & (F.col("name") == "a.txt")).withColumn("content", F.lit("second\n")),
        folder,
    )
    docs = corpus.read_table(spark, f"{folder}/docs")
    kept = corpus.read_table(spark, f"{folder}/samples")
    return docs.select("page_id", "rel_path", "text").join(
        kept.select("page_id", "name", "content"), "page_id"
    )


def bundle_document(spark: SparkSession, d: str) -> DataFrame:
    html, pages = _kept_inputs(spark, d)
    targets = links.frontier_targets(links.page_links(html, ORIGIN), _sources(spark, d, html), _saved(spark, d))
    found = links.resolve_targets(targets, pages).where(F.col("found_id").isNotNull())
    body = F.concat(F.lit("Page "), F.col("page_id"), F.lit(".\n"))
    linked = found.select(
        F.col("source_id").alias("root_id"), F.col("pos").alias("ord"), F.col("found_id").alias("page_id")
    ).join(pages.select("page_id", "title"), "page_id")
    roots = _versioned_pages(spark, d, pages).join(
        _sources(spark, d, html).select("page_id"), "page_id", "left_semi"
    )
    texts = sync.page_documents(
        roots.select("page_id", "title", "space_key", "version", body.alias("markdown")),
        GENERATED,
        ORIGIN,
    )
    return sync.bundle_documents(
        texts.select("page_id", "text"), linked.withColumn("markdown", body)
    )


def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    saved = view(spark, d, "wiki_saved").select(
        F.lit("saved").alias("package"),
        F.concat("rel_path", F.lit(".md")).alias("path"),
        "text",
    )
    docs = _conv_docs(spark, d).unionByName(saved)
    return publish(
        docs, _versioned_pages(spark, d), PARENT_URL, WorkFolder.scratch(spark, "publish")
    )


# --- projections -----------------------------------------------------------------------------
def url_classify(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("url_id"), "url")
    return links.classify_urls(view(spark, d, "url_samples").unionByName(raw))


def link_refs(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve_hrefs(
        links.html_anchors(view(spark, d, "wiki_links_html")), "href", ORIGIN
    )


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    cloud = F.col("space_key") == CATALOGUE
    pages = _pages(spark, d).withColumns(
        {
            "cloud": cloud,
            "origin": F.when(cloud, "https://acme.atlassian.net").otherwise(ORIGIN),
            "base_path": F.when(cloud, "/wiki").otherwise(""),
        }
    )
    return links.page_urls(pages)


def image_links(spark: SparkSession, d: str) -> DataFrame:
    return links.image_links(view(spark, d, "issue_pages"), ORIGIN)


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    saved = view(spark, d, "wiki_saved").select(F.col("page_id").alias("doc_id"), "text")
    conv = _conv_docs(spark, d).select(F.concat_ws("/", "package", "path").alias("doc_id"), "text")
    split = documents.front_matter(saved.unionByName(conv), "text", "fm")
    return split.select(
        "doc_id",
        "fm.bound",
        "fm.url",
        "fm.version",
        F.array_join("fm.extra_lines", "|").alias("extra_lines"),
        "fm.raw_length",
        "fm.body",
    )


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = view(spark, d, "typed_docs").select(
        F.col("doc_id").cast("string").alias("page_id"),
        "title",
        F.when(F.col("doc_id") % 2 == 0, CATALOGUE).otherwise("").alias("space_key"),
        F.lit(3).alias("version"),
        "markdown",
    )
    return sync.page_documents(pages, GENERATED, ORIGIN).select("page_id", "text")


def doc_types(spark: SparkSession, d: str) -> DataFrame:
    return sync.doc_types(view(spark, d, "typed_docs"))


def title_body(spark: SparkSession, d: str) -> DataFrame:
    orders = _order_docs(spark, d).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("markdown").alias("body"),
        F.lit("order").alias("fallback"),
    )
    conv = documents.front_matter(_conv_docs(spark, d), "text", "fm").select(
        F.concat_ws("/", "package", "path").alias("doc_id"),
        F.col("fm.body").alias("body"),
        F.regexp_replace(paths.base_name(F.col("path")), r"\.md$", "").alias("fallback"),
    )
    return sync.title_body(orders.unionByName(conv))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_html(markup.normalise_storage(_html_corpus(spark, d)))


def storage_normalise(spark: SparkSession, d: str) -> DataFrame:
    return markup.normalise_storage(view(spark, d, "storage_pages"), "storage")


def md_link_offsets(spark: SparkSession, d: str) -> DataFrame:
    pseudo = F.concat(F.lit("See [it](confluence:CAT/"), F.col("slug"), F.lit(").\n"))
    docs = view(spark, d, "wiki_saved").select(
        F.col("page_id").alias("doc_id"), F.concat("text", pseudo).alias("text")
    )
    unbound = docs.select(
        F.concat(F.lit("unbound-"), "doc_id").alias("doc_id"),
        documents.strip_part_front_matter(F.col("text")).alias("text"),
    )
    return links.md_link_offsets(docs.unionByName(unbound))


# --- links -------------------------------------------------------------------------------------
def link_inventory(spark: SparkSession, d: str) -> DataFrame:
    return links.link_inventory(table(spark, d, "pages"), ORIGIN)


def links_unique(spark: SparkSession, d: str) -> DataFrame:
    return links.unique_links(_links(spark, d))


def links_known(spark: SparkSession, d: str) -> DataFrame:
    return links.mark_known(_links(spark, d), _saved(spark, d))


def frontier_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return links.frontier_one_hop(
        _links(spark, d), _sources(spark, d), _saved(spark, d), _pages(spark, d)
    )


def _pages_with_lost_links(spark: SparkSession, d: str, html: DataFrame | None = None) -> DataFrame:
    """The link pages with two more links on each, to a title and an id that no page has."""
    lost = F.concat(
        F.lit('<p><a href="/display/CAT/Lost+'), "page_id", F.lit('">by title</a> <a href="/pages/viewpage.action?pageId=9'),
        "page_id", F.lit('">by id</a></p>'),
    )
    return (view(spark, d, "wiki_links_html") if html is None else html).withColumn("html", F.concat("html", lost))


def _links_to_nowhere(spark: SparkSession, d: str, html: DataFrame | None = None) -> DataFrame:
    return links.page_links(_pages_with_lost_links(spark, d, html), ORIGIN)


def frontier_failures(spark: SparkSession, d: str) -> DataFrame:
    html, pages = _kept_inputs(spark, d)
    return links.frontier_failures(
        _links_to_nowhere(spark, d, html), _sources(spark, d, html), _saved(spark, d), pages
    )


def failure_report(spark: SparkSession, d: str) -> DataFrame:
    return links.failure_report(frontier_failures(spark, d))


def links_rewrite(spark: SparkSession, d: str) -> DataFrame:
    saved = _saved(spark, d)
    none = saved.select("page_id", "title", F.col("rel_path").alias("path"), "ord").limit(0)
    by_id, by_title = tree.lookup_by_id(none, saved), tree.lookup_by_title(none, saved)
    return links.rewrite_links(_linked_docs(spark, d), by_id, by_title, ORIGIN)


def relink_changed(spark: SparkSession, d: str) -> DataFrame:
    return _relinked(*_whole_run(spark, d))


def _relinked(placed: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved documents outside of one folder whose links a run changed."""
    written = saved.where(F.col("dir") == "geo").select("rel_path")
    return sync.relink_saved(
        saved, written, tree.lookup_by_id(placed, saved), tree.lookup_by_title(placed, saved), ORIGIN
    )


# --- tree ----------------------------------------------------------------------------------------
def slug_assign(spark: SparkSession, d: str) -> DataFrame:
    work = WorkFolder.scratch(spark, "slugs")
    return tree.assign_slugs(_numbered(_pages(spark, d)), _saved(spark, d), work)


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    fetched, saved = _numbered(_pages(spark, d)), _saved(spark, d)
    work = WorkFolder.scratch(spark, "tree")
    fetched = work.keep(fetched, "fetched")
    slugs = work.keep(tree.assign_slugs(fetched, saved, work), "slugs")
    return tree.place_in_tree(fetched, saved, slugs)


def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    placed, saved = _whole_run(spark, d)
    return tree.lookup_by_id(placed, saved)


def lookup_by_title(spark: SparkSession, d: str) -> DataFrame:
    placed, saved = _whole_run(spark, d)
    return tree.lookup_by_title(placed, saved)


def overwrite_clashes(spark: SparkSession, d: str) -> DataFrame:
    """All pages written flat into the catalogue folder meet files of other pages there."""
    fetched = _numbered(_pages(spark, d))
    nothing = _saved(spark, d).limit(0)
    slugs = tree.assign_slugs(fetched, nothing)
    files = slugs.select("page_id", F.concat(F.lit("catalogue/"), "slug").alias("path"))
    saved = _saved(spark, d)
    return tree.overwrite_clashes(files, saved, saved)


# --- lines ---------------------------------------------------------------------------------------
def fence_state(spark: SparkSession, d: str) -> DataFrame:
    orders = _order_docs(spark, d)
    prose = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), F.col("text").alias("markdown"))
    return lines.fence_state(orders.unionByName(prose))


def headings(spark: SparkSession, d: str) -> DataFrame:
    return lines.headings(_order_docs(spark, d))


def anchor_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = WorkFolder.scratch(spark, "docs").keep(_order_docs(spark, d), "docs")
    return lines.anchor_resolution(docs)


def anchors_rewrite(spark: SparkSession, d: str) -> DataFrame:
    docs = WorkFolder.scratch(spark, "docs").keep(_order_docs(spark, d), "docs")
    return lines.rewrite_anchors(docs)


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines.code_blocks(_order_docs(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_samples(_order_docs(spark, d), BLOCK_LIMIT, APPENDIX)


def samples_named(spark: SparkSession, d: str) -> DataFrame:
    return lines.samples_table(_split(spark, d))


def samples_extract(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select(
        "doc_id",
        "markdown",
        F.array_join(F.transform("samples", lambda s: s["name"]), "|").alias("names"),
        F.array_join(F.transform("samples", lambda s: s["content"]), "|").alias("contents"),
    )


# --- split documents -------------------------------------------------------------------------------
def part_docs(spark: SparkSession, d: str) -> DataFrame:
    return assembly.part_documents(_conv_docs(spark, d)).select("package", "path")


def part_rows(spark: SparkSession, d: str) -> DataFrame:
    return assembly.part_rows(_conv_docs(spark, d))


def parts_inlined(spark: SparkSession, d: str) -> DataFrame:
    return assembly.parts_inlined(_conv_docs(spark, d))


def parts_missing(spark: SparkSession, d: str) -> DataFrame:
    return assembly.parts_missing(_conv_docs(spark, d))


def part_anchors(spark: SparkSession, d: str) -> DataFrame:
    return assembly.part_anchors(_conv_docs(spark, d))


def parts_anchor_links(spark: SparkSession, d: str) -> DataFrame:
    return assembly.parts_anchor_links(_conv_docs(spark, d), WorkFolder.scratch(spark, "assembly"))


def headings_dropped(spark: SparkSession, d: str) -> DataFrame:
    return assembly.headings_dropped(_conv_docs(spark, d))


def assemble_documents(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assemble_documents(_conv_docs(spark, d), WorkFolder.scratch(spark, "assembly"))


# --- markup ----------------------------------------------------------------------------------------
def issue_table_flat(spark: SparkSession, d: str) -> DataFrame:
    return markup.issue_tables(view(spark, d, "issue_pages"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    cleaned = markup.clean_html(markup.normalise_storage(_html_corpus(spark, d)))
    return markup.html_blocks(cleaned).select(
        "page_id", "block_no", "kind", "level", "quote", "lang", "text"
    )


def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    work = WorkFolder.scratch(spark, "markdown")
    return markup.html_to_markdown(_html_corpus(spark, d), "link", ORIGIN, work)


def md_to_storage(spark: SparkSession, d: str) -> DataFrame:
    return publishing.md_to_storage(_order_docs(spark, d))


def md_emphasis(spark: SparkSession, d: str) -> DataFrame:
    """Emphasis, links and tasks whose marks cross, as markup that is well formed."""
    return publishing.md_to_storage(view(spark, d, "marked_docs"))


# --- sync and streams --------------------------------------------------------------------------------
def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    versions = view(spark, d, "page_versions")
    known = versions.where(F.col("ts") < F.lit(GUARD_TIME).cast("timestamp"))
    local = revisions.latest(known).select("page_id", "version")
    return sync.version_guard(local, revisions.latest(versions).select("page_id", "version"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    placed, saved = _whole_run(spark, d)
    return sync.run_summary(
        placed,
        samples_named(spark, d),
        _relinked(placed, saved),
        parts_inlined(spark, d),
    )


def _revision_folder(spark: SparkSession, d: str) -> tuple[str, int]:
    """A folder with all revisions, and how many seconds late one may come in it."""
    versions = view(spark, d, "page_versions").selectExpr(
        "page_id", "cast(version as int) version", "client", "cast(ts as timestamp) ts", "event_id"
    )
    folder = scratch_folder(spark, "revisions")
    return folder, revisions.write_in_time_order(versions, folder)


def stream_latest_page(spark: SparkSession, d: str) -> DataFrame:
    folder, _ = _revision_folder(spark, d)
    stream = revisions.read_revisions(spark, folder, 4)
    out = scratch_folder(spark, "latest")
    revisions.follow_latest(stream, out, scratch_folder(spark, "latest-checkpoint"))
    return revisions.read_latest(spark, out).select("page_id", "version", "client", "event_id")


def stream_version_guard(spark: SparkSession, d: str) -> DataFrame:
    folder, seconds = _revision_folder(spark, d)
    delay = f"{seconds} seconds"
    stream = revisions.read_revisions(spark, folder, 4)
    revisions.close_feed(spark.read.schema(revisions.REVISION).parquet(folder), folder, delay)
    out = scratch_folder(spark, "verdicts")
    revisions.run_guard(stream, out, scratch_folder(spark, "verdicts-checkpoint"), delay)
    return spark.read.schema(revisions.VERDICT).parquet(out)


def publish_rebind(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose page was updated, bound to the version that the update made."""
    plan = publish_plan(spark, d).where(F.col("action") == "updated").select("doc_id", "url", "version")
    saved = view(spark, d, "wiki_saved").select(F.concat(F.lit("saved/"), "rel_path", F.lit(".md")).alias("doc_id"), "text")
    return sync.rebind(saved.join(plan, "doc_id"))


def _download_tables(spark: SparkSession, d: str, work: WorkFolder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The order pages and all others, the pages to begin with, and the saved corpus."""
    html = view(spark, d, "wiki_links_html")
    pages = (
        _versioned_pages(spark, d)
        .join(html, "page_id", "left")
        .withColumn("html", F.coalesce("html", F.concat(F.lit("<p>"), "title", F.lit("</p>"))))
    )
    pages = work.keep(pages, "pages")
    roots = pages.where(F.col("space_key") == ORDERS).where(F.col("html").contains("<a ")).select("page_id")
    return pages, roots, work.keep(_saved(spark, d), "saved")


def full_download(spark: SparkSession, d: str) -> DataFrame:
    """Download all order pages and the pages they link to into the saved corpus."""
    work = WorkFolder.scratch(spark, "download")
    pages, roots, saved = _download_tables(spark, d, work)
    result = download(pages, roots, saved, ORIGIN, GENERATED, work=work)
    return result.files.select("page_id", "rel_path", "text", F.size("samples").alias("samples"))


def download_commit(spark: SparkSession, d: str) -> DataFrame:
    """The same download as a committed run, repeated, and its pages as the corpus then holds them."""
    work = WorkFolder.scratch(spark, "commit")
    pages, roots, saved = _download_tables(spark, d, work)
    folder, run = f"{work.folder}/corpus", f"{work.folder}/run"
    for _ in range(2):
        run_download(spark, pages, roots, saved, ORIGIN, GENERATED, folder, run)
    own = spark.read.parquet(f"{run}/files").select("page_id")
    counts = corpus.read_table(spark, f"{folder}/samples").groupBy("page_id").agg(F.count("*").cast("int").alias("samples"))
    docs = corpus.read_table(spark, f"{folder}/docs").join(own, "page_id", "left_semi").join(counts, "page_id", "left")
    return docs.select("page_id", "rel_path", "text", F.coalesce("samples", F.lit(0)).alias("samples"))


def _reported_run(spark: SparkSession, d: str) -> tuple[str, dict[str, int]]:
    """The folder and the counts of a committed download whose roots also hold links to nowhere and a long listing."""
    work = WorkFolder.scratch(spark, "reported")
    pages, roots, saved = _download_tables(spark, d, work)
    lost = _pages_with_lost_links(spark, d).select("page_id", F.col("html").alias("_lost"))
    listing = F.concat(
        F.lit("<h2>Packing log</h2><pre>"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat(F.lit("box "), n, F.lit(" of "), "page_id")), "\n"),
        F.lit("</pre>"),
    )
    pages = pages.join(lost, "page_id", "left").withColumn("html", F.coalesce(F.concat("_lost", listing), "html")).drop("_lost")
    run = f"{work.folder}/run"
    return run, run_download(spark, pages, roots, saved, ORIGIN, GENERATED, f"{work.folder}/corpus", run)


def download_failures(spark: SparkSession, d: str) -> DataFrame:
    """The links of a download that lead to no page."""
    return spark.read.parquet(f"{_reported_run(spark, d)[0]}/failures")


def download_relinked(spark: SparkSession, d: str) -> DataFrame:
    """Saved documents that were not downloaded and whose links a download changed."""
    return spark.read.parquet(f"{_reported_run(spark, d)[0]}/relinked")


def download_samples(spark: SparkSession, d: str) -> DataFrame:
    """The listings that a download moved out of its pages."""
    return spark.read.parquet(f"{_reported_run(spark, d)[0]}/samples").select("page_id", "rel_path", "seq", "name", "content")


def download_summary(spark: SparkSession, d: str) -> DataFrame:
    """The counts of one download, as observed while it wrote its tables."""
    counts = _reported_run(spark, d)[1]
    names = ("pages", "samples", "relinked", "failures", "clashes")
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


#: Queries whose rows are those of another one, so that they share its oracle.
SAME_ROWS = {"download_commit": "full_download"}

QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        page_dump_flatten, page_by_title, saved_scan, corpus_write_readback, bundle_document,
        publish_plan, url_classify, link_refs, page_urls, image_links, front_matter,
        page_documents, doc_types, title_body, part_docs, part_rows, html_clean,
        storage_normalise, md_link_offsets, links_known, links_rewrite, frontier_one_hop,
        frontier_failures, failure_report, tree_paths, anchor_resolve, parts_inlined,
        parts_missing, version_conflicts, overwrite_clashes, relink_changed, parts_anchor_links,
        links_unique, headings_dropped, run_summary, issue_table_flat, fence_state, code_blocks,
        samples_named, samples_extract, headings, slug_assign, part_anchors, lookup_by_id,
        lookup_by_title, link_inventory, html_blocks, html_to_markdown, anchors_rewrite,
        assemble_documents, md_to_storage, md_emphasis, stream_latest_page, stream_version_guard,
        publish_rebind, full_download, download_commit,
        download_failures, download_relinked, download_samples, download_summary,
    )
}
