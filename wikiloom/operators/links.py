"""Link extraction, resolution, the one-hop frontier and link rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom import fixed
from wikiloom.functions import paths, urls
from wikiloom.functions import text as t
from wikiloom.functions.documents import front_matter
from wikiloom.functions.order import page_order
from wikiloom.functions.skew import lookup_join


def classify_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Page URLs split into site, space, id and title; ``kind`` is 'none' for anything else."""
    keep = df.columns
    ref = urls.page_url_ref(df, url, "_ref")
    fields = ("origin", "base_path", "cloud", "space_key", "page_id", "title", "tiny_url")
    return ref.select(
        *keep,
        F.coalesce(F.col("_ref.kind"), F.lit("none")).alias("kind"),
        *[F.col(f"_ref.{name}").alias(name) for name in fields],
    )


def resolve_hrefs(df: DataFrame, href: str = "href", origin: str = "") -> DataFrame:
    """Link targets split into space, id and title; ``kind`` is 'none' for other targets."""
    keep = df.columns
    ref = urls.page_ref(df, href, "_ref", origin)
    return ref.select(
        *keep,
        F.coalesce(F.col("_ref.kind"), F.lit("none")).alias("kind"),
        *[F.col(f"_ref.{name}").alias(name) for name in ("space_key", "page_id", "title")],
    )


def html_anchors(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per ``<a href>`` of the raw markup: source_id, pos, href, label."""
    found = pages.select(
        F.col(page_id).alias("source_id"),
        F.posexplode(t.all_matches(F.col(html), fixed.HTML_ANCHOR)).alias("pos", "_tag"),
    )
    tag = F.col("_tag")
    href = F.coalesce(
        t.blank_to_null(t.group(tag, fixed.HTML_ANCHOR, 1)), t.group(tag, fixed.HTML_ANCHOR, 2)
    )
    label = t.group(tag, fixed.HTML_ANCHOR, 3)
    cut = t.once(found, href=href, label=label).drop("_tag")

    def decoded(c: Column) -> Column:
        return F.when(c.contains("&"), t.decode_entities(c, fixed.PAGE_ENTITIES)).otherwise(c)

    shown = F.when(F.col("label").contains("<"), t.strip_tags(F.col("label"))).otherwise(F.col("label"))
    cut = t.once(cut, label=shown)
    cut = t.once(cut, href=decoded(F.col("href")), label=decoded(F.col("label")))
    return cut.select("source_id", "pos", "href", t.trim(F.col("label")).alias("label"))


def page_links(
    pages: DataFrame, origin: str = "", page_id: str = "page_id", html: str = "html"
) -> DataFrame:
    """Links to wiki pages, one row per occurrence.

    A target without a title takes the link's text; links with neither are dropped.
    """
    refs = resolve_hrefs(html_anchors(pages, page_id, html), "href", origin)
    title = F.coalesce(t.blank_to_null(F.col("title")), F.col("label"))
    return (
        refs.where(F.col("kind") != "none").withColumn("title", title).where(F.col("title") != "")
    )


def link_inventory(pages: DataFrame, origin: str = "") -> DataFrame:
    """Number of links and of pages having them, per kind of target.

    Counted per page first, where all links of a page still sit in one task, so that only a
    handful of partial counts per task reach the shuffle.
    """
    refs = resolve_hrefs(html_anchors(pages), "href", origin)
    per_page = refs.groupBy("source_id", "kind").agg(F.count("*").alias("_n"))
    return per_page.groupBy("kind").agg(
        F.sum("_n").alias("links"), F.count("*").alias("pages")
    )


def unique_links(links: DataFrame) -> DataFrame:
    """The first occurrence of every target of a page.

    The links are dealt by their page before they are grouped: a page repeats few of its targets, so
    groups made before that would only carry each key a second time. What joins them by their page
    finds them in place.
    """
    key = F.when(F.col("page_id") != "", F.col("page_id")).otherwise(
        F.concat_ws("|", "space_key", "title")
    )
    first = F.min_by(F.struct("pos", "kind", "space_key", "page_id", "title"), F.col("pos"))
    return (
        links.repartition("source_id").groupBy("source_id", key.alias("_key"))
        .agg(first.alias("_first"))
        .select("source_id", "_first.*")
    )


def mark_known(links: DataFrame, saved: DataFrame) -> DataFrame:
    """Add ``known``: the target's id already has a saved document."""
    by_id = saved.select("page_id", F.lit(True).alias("_saved")).dropDuplicates(["page_id"])
    keyed = links.withColumn("page_id", t.blank_to_null(F.col("page_id")))
    marked = lookup_join(keyed, by_id, ["page_id"], ["_saved"])
    return marked.select(
        *[F.coalesce("page_id", F.lit("")).alias(c) if c == "page_id" else c for c in links.columns],
        F.coalesce("_saved", F.lit(False)).alias("known"),
    )


def page_by_title(pages: DataFrame) -> DataFrame:
    """One page per (space_key, title): the one with the smallest id."""
    best = F.min_by(F.col("page_id"), page_order(F.col("page_id")))
    return pages.groupBy("space_key", "title").agg(best.alias("page_id"))


def frontier_targets(links: DataFrame, sources: DataFrame, saved: DataFrame) -> DataFrame:
    """Links worth following, each with the (space, title) or id it asks for.

    ``sources``: page_id, space_key of the pages the links stand on; a target without a space
    is looked up in the space of its source.
    """
    spaces = sources.select(
        F.col("page_id").alias("source_id"), F.col("space_key").alias("_source_space")
    )
    # The space comes first, while the links still lie by their page.
    placed = unique_links(links).drop("kind").join(spaces, "source_id")
    picked = mark_known(placed, saved).where(~F.col("known"))
    space = F.coalesce(t.blank_to_null(F.col("space_key")), F.col("_source_space"))
    by_id = F.col("page_id") != ""
    return picked.select(
        "source_id",
        "pos",
        "title",
        F.when(by_id, F.col("page_id")).alias("want_id"),
        F.when(~by_id, space).alias("want_space"),
        F.when(~by_id, F.col("title")).alias("want_title"),
    )


def resolve_targets(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``found_id``, the page a target leads to, or null."""
    known = pages.select(F.col("page_id").alias("want_id")).distinct().withColumn("_by_id", F.lit(True))
    titled = page_by_title(pages).select(
        F.col("space_key").alias("want_space"),
        F.col("title").alias("want_title"),
        F.col("page_id").alias("_by_title"),
    )
    by_id = lookup_join(targets, known, ["want_id"], ["_by_id"])
    both = lookup_join(by_id, titled, ["want_space", "want_title"], ["_by_title"])
    return both.withColumn("found_id", F.coalesce(F.when(F.col("_by_id"), F.col("want_id")), "_by_title")).drop(
        "_by_id", "_by_title"
    )


def frontier_one_hop(
    links: DataFrame, sources: DataFrame, saved: DataFrame, pages: DataFrame
) -> DataFrame:
    """Pages one link away from ``sources``, each once, with the link that reached it first.

    Links are taken in the order of their source's id, then of their position. Pages among the
    sources are already fetched and do not come up again.
    """
    targets = frontier_targets(links, sources, saved)
    # Links to one target are one row before the lookups, so that a page everybody links to is no hot key there.
    wanted = _first_links(targets, "want_id", "want_space", "want_title")
    return _new_pages(resolve_targets(wanted, pages), sources, pages)


def reached_pages(resolved: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that resolved targets lead to; see ``frontier_one_hop``."""
    return _new_pages(_first_links(resolved.where(F.col("found_id").isNotNull()), "found_id"), sources, pages)


def _link_order(source_id: Column, pos: Column) -> Column:
    return F.struct(page_order(source_id).alias("source"), pos.alias("pos"))


def _first_links(targets: DataFrame, *keys: str) -> DataFrame:
    """Per key the first link, ``_via``, and how many there are, ``links``."""
    order = _link_order(F.col("source_id"), F.col("pos"))
    return targets.groupBy(*keys).agg(F.min_by(F.struct("source_id", "pos"), order).alias("_via"), F.count("*").alias("links"))


def _new_pages(firsts: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages found for some first links that are not among the sources."""
    order = _link_order(F.col("_via.source_id"), F.col("_via.pos"))
    reached = (
        firsts.where(F.col("found_id").isNotNull())
        .groupBy(F.col("found_id").alias("page_id"))
        .agg(F.min_by("_via", order).alias("_via"), F.sum("links").alias("links"))
    )
    new = reached.join(sources.select("page_id"), "page_id", "left_anti")
    return new.join(pages.select("page_id", "space_key", "title"), "page_id").select(
        "page_id",
        "space_key",
        "title",
        F.col("_via.source_id").alias("via_id"),
        F.col("_via.pos").alias("via_pos"),
        "links",
    )


def frontier_failures(
    links: DataFrame, sources: DataFrame, saved: DataFrame, pages: DataFrame
) -> DataFrame:
    """Picked links that lead to no page."""
    return failed_targets(resolve_targets(frontier_targets(links, sources, saved), pages))


def failed_targets(resolved: DataFrame) -> DataFrame:
    """Resolved targets that lead to no page."""
    return resolved.where(F.col("found_id").isNull()).select(
        "source_id", "pos", "title", F.lit("not-found").alias("reason")
    )


def failure_report(failures: DataFrame) -> DataFrame:
    """One line per source page naming its failed links in order."""
    entry = F.concat(F.col("title"), F.lit(" ("), F.col("reason"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))
    return failures.groupBy("source_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["entry"]), "; ").alias("report"),
        F.count("*").alias("failures"),
    )


def page_urls(
    pages: DataFrame, origin: str = "origin", base_path: str = "base_path", cloud: str = "cloud"
) -> DataFrame:
    web = urls.page_web_url(
        F.col(origin), F.col(base_path), F.col(cloud), F.col("space_key"), F.col("page_id")
    )
    return pages.select("page_id", web.alias("url"))


def image_markdown(tag: Column, origin: str, mode: str = "link") -> Column:
    """An ``<img>`` tag as Markdown: dropped, or a link named by its alt text or file name."""
    if mode != "link":
        return F.lit("")
    src = t.decode_entities(t.group(tag, r"\ssrc\s*=\s*\"([^\"]*)\""), fixed.PAGE_ENTITIES)
    alt = t.decode_entities(t.group(tag, r"\salt\s*=\s*\"([^\"]*)\""), fixed.PAGE_ENTITIES)

    def shown(x: Column) -> Column:
        file = F.element_at(F.split(F.substring_index(x["src"], "?", 1), "/"), -1)
        name = F.coalesce(t.blank_to_null(x["alt"]), urls.decode_component(file, F.lit("")))
        own = F.lit(bool(origin)) & x["src"].startswith("/")
        href = F.when(own, F.concat(F.lit(origin), x["src"])).otherwise(x["src"])
        return F.when(x["src"] == "", "").otherwise(
            F.concat(F.lit("!["), name, F.lit("]("), href, F.lit(")"))
        )

    return t.bind(F.struct(src.alias("src"), alt.alias("alt")), shown)


def image_links(pages: DataFrame, origin: str = "") -> DataFrame:
    """One row per image of the markup with its Markdown form."""
    return pages.select(
        "page_id",
        F.posexplode(t.all_matches(F.col("html"), fixed.HTML_IMAGE)).alias("pos", "_tag"),
    ).select("page_id", "pos", image_markdown(F.col("_tag"), origin).alias("markdown"))


def md_link_offsets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Wiki links of saved documents: the target, where it stands and where it leads.

    Pseudo-scheme links are followed inside the corpus; root-relative ones lead to the site the
    document is bound to and are skipped in unbound documents.
    """
    bound = urls.page_url_ref(front_matter(docs, text, "_fm"), "_fm.url", "_own")
    found = bound.select(
        F.col(doc_id),
        F.col("_own.origin").alias("_origin"),
        F.explode(t.match_offsets(F.col(text), fixed.MD_SCANNED_TARGET)).alias("_m"),
    )
    target = t.group(F.col("_m.text"), fixed.MD_SCANNED_TARGET)
    pseudo = target.startswith(fixed.PSEUDO_SCHEME)
    return found.select(
        F.col(doc_id),
        (F.col("_m.start") + 2).alias("start"),
        (F.col("_m.start") + 2 + F.length(target)).alias("end"),
        target.alias("target"),
        F.when(pseudo, "corpus").otherwise("site").alias("kind"),
        F.when(~pseudo, F.concat("_origin", target)).alias("url"),
    ).where(pseudo | F.col("_origin").isNotNull())


def rewrite_links(
    docs: DataFrame,
    path_by_id: DataFrame,
    path_by_title: DataFrame,
    origin: str = "",
    doc_id: str = "doc_id",
    folder: str = "dir",
    markdown: str = "markdown",
) -> DataFrame:
    """Links to pages with a document become relative links to that document.

    ``path_by_id``: page_id, path. ``path_by_title``: title, path. A link names a page by its id or
    by its title, regardless of space; links without a document stay. Only (document, position,
    target) rows travel, through one lookup of ids and titles; texts move once, when the paths come
    back, and texts without any link not at all. The relative links are made beside their text, so a
    title that many link to brings its task rows but no work.
    """
    has_links = F.col(markdown).contains("](")
    linked = docs.where(has_links)
    hrefs = linked.select(
        F.col(doc_id).alias("_doc"),
        F.posexplode(t.all_matches(F.col(markdown), fixed.MD_TARGET, 1)).alias("_pos", "_href"),
    )
    refs = resolve_hrefs(hrefs, "_href", origin)
    by_id, by_title = F.concat(F.lit("i"), "page_id"), F.concat(F.lit("t"), "title")
    target = F.when(F.col("page_id") != "", by_id).when(F.col("title") != "", by_title)
    wanted = refs.select("_doc", F.col("_pos").alias("pos"), target.alias("_target")).where(F.col("_target").isNotNull())
    known = path_by_id.select(by_id.alias("_target"), "path").unionByName(path_by_title.select(by_title.alias("_target"), "path"))
    found = lookup_join(wanted, known.where(F.col("path") != ""), ["_target"], ["path"])
    new = (
        found.where(F.col("path").isNotNull())
        .groupBy("_doc")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("_new"))
    )

    def link(x: Column) -> Column:
        value = F.concat(F.lit("]("), paths.relative_md_link(F.col(folder), x["path"]), F.lit(")"))
        return F.struct(x["pos"].alias("pos"), value.alias("value"))

    rewritten = linked.join(
        new.withColumnRenamed("_doc", doc_id), doc_id, "left"
    ).withColumn(
        markdown,
        F.when(F.col("_new").isNull(), F.col(markdown)).otherwise(
            t.splice(F.col(markdown), fixed.MD_TARGET, t.by_position(F.transform("_new", link)))
        ),
    )
    return rewritten.select(*docs.columns).unionByName(
        docs.where(~F.coalesce(has_links, F.lit(False)))
    )
