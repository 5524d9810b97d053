"""Split documents: an index that lists its parts, assembled into one document.

``docs``: package, path, text. Paths are relative to the package; an index names its parts
relative to its own folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom import fixed
from wikiloom.functions import documents, paths, urls
from wikiloom.functions import text as t
from wikiloom.functions.skew import lookup_join
from wikiloom.session import WorkFolder, keep

_INDEX = ["package", "index"]


def part_documents(docs: DataFrame) -> DataFrame:
    """Documents whose front matter declares them parts."""
    return docs.where(documents.is_part(F.col("text")))


def part_bodies(docs: DataFrame) -> DataFrame:
    """package, full_path, body of the parts without their front matter."""
    body = t.trim(documents.strip_part_front_matter(F.col("text")))
    return part_documents(docs).select(
        "package", F.col("path").alias("full_path"), body.alias("body")
    )


def _anchor_of(body: Column) -> Column:
    pattern = f"{fixed.BOL}{fixed.HEADING_LINE}([^\\n]*)"
    return t.heading_plain_text(t.group(body, pattern), r"[*_`~]")


def part_anchors(docs: DataFrame) -> DataFrame:
    """package, path, anchor: the plain text of a part's first heading, '' without one."""
    return part_bodies(docs).select(
        "package", F.col("full_path").alias("path"), _anchor_of(F.col("body")).alias("anchor")
    )


def index_lines(docs: DataFrame) -> DataFrame:
    """The lines of every document that could list parts, one pass over each document.

    package, index, line_no, line, section (number of its heading), heading (the line is one),
    blank, and for a list item that is nothing but a link to a file below the index: title, path
    (from the index's folder), full_path.
    """
    listing = documents.front_matter(docs.where(F.col("text").contains(".md)")), "text", "_fm")
    # A carriage return in front of the line feed belongs to the line end.
    body = F.replace(F.col("_fm.body"), F.lit("\r\n"), F.lit("\n"))
    sections = F.split(body, f"\\n(?={fixed.HEADING_LINE})", -1)
    section_numbers = F.flatten(
        F.transform(sections, lambda s, n: F.array_repeat(n, t.newlines(s) + 1))
    )

    def line(x: Column, section: Column) -> Column:
        text = x["line"]
        row = ~x["fenced"] & text.rlike(fixed.PART_ROW)
        target = F.when(row, t.group(text, fixed.PART_ROW, 2))
        return F.struct(
            text.alias("line"),
            section.alias("section"),
            text.rlike(f"^{fixed.HEADING_LINE}").alias("heading"),
            (t.trim(text) == "").alias("blank"),
            F.when(row, t.group(text, fixed.PART_ROW, 1)).alias("title"),
            paths.resolve_path(F.lit(""), target).alias("path"),
        )

    lines = F.zip_with(documents.fenced_lines(body), section_numbers, line)
    found = listing.select(
        "package", F.col("path").alias("index"), F.posexplode(lines).alias("line_no", "_l")
    )
    folder = paths.dir_of(F.col("index"))
    return found.select(
        *_INDEX,
        "line_no",
        "_l.*",
        paths.join_path(folder, F.col("_l.path")).alias("full_path"),
    )


def part_rows(docs: DataFrame) -> DataFrame:
    """package, index, line_no, title, path, full_path of all list items that name a file."""
    return (
        index_lines(docs)
        .where(F.col("path").isNotNull())
        .select(*_INDEX, "line_no", "title", "path", "full_path")
    )


def marked_lines(docs: DataFrame, rows_only: bool = False) -> DataFrame:
    """The index lines with what becomes of them.

    Adds ``known`` (the named file exists), ``part`` (it is a part: the row is inlined),
    ``anchor``, ``first`` (the row that takes the part's text), ``missing`` and ``dropped`` (a
    heading of level 2 to 6 whose section holds nothing but inlined rows). Documents that inline
    nothing are left out. One join looks the files up; one exchange by index serves all windows.
    """
    body = t.trim(documents.strip_part_front_matter(F.col("text")))
    is_part = F.coalesce(documents.is_part(F.col("text")), F.lit(False))
    files = docs.select(
        "package",
        F.col("path").alias("full_path"),
        F.lit(True).alias("known"),
        is_part.alias("part"),
        F.when(is_part, _anchor_of(body)).alias("anchor"),
    )
    lines = index_lines(docs)
    if rows_only:
        lines = lines.where(F.col("path").isNotNull()).drop("line")
    looked_up = lookup_join(lines, files, ["package", "full_path"], ["known", "part", "anchor"])
    flags = looked_up.withColumns(
        {
            "known": F.coalesce("known", F.lit(False)),
            "part": F.coalesce("part", F.lit(False)),
            "_dir": paths.dir_of(F.col("path")),
        }
    ).repartition(*[F.col(c) for c in _INDEX])
    index = Window.partitionBy(*_INDEX)
    named = Window.partitionBy(*_INDEX, "path").orderBy("line_no")
    folder = Window.partitionBy(*_INDEX, "_dir")
    section = Window.partitionBy(*_INDEX, "section")
    text = ~F.col("heading") & ~F.col("blank")
    added = {
        "_any": F.max("part").over(index),
        "first": F.col("part") & (F.row_number().over(named) == 1),
        "missing": F.col("path").isNotNull()
        & ~F.col("known")
        & F.max("part").over(folder)
        & (F.row_number().over(named) == 1),
        "dropped": F.col("heading")
        & F.col("line").startswith("##")
        & (F.count_if(text & F.col("part")).over(section) > 0)
        & (F.count_if(text & ~F.col("part")).over(section) == 0),
    }
    if rows_only:
        del added["dropped"]
    return flags.withColumns(added).where("_any").drop("_any", "_dir")


def parts_inlined(docs: DataFrame) -> DataFrame:
    """The parts that become text of their index: package, index, path, title, line_no."""
    return marked_lines(docs, True).where("first").select(*_INDEX, "path", "title", "line_no")


def parts_missing(docs: DataFrame) -> DataFrame:
    """Listed files that do not exist, in folders that hold at least one inlined part."""
    return marked_lines(docs, True).where("missing").select(*_INDEX, "path", "title")


def headings_dropped(docs: DataFrame) -> DataFrame:
    """Headings that disappear with their list: package, index, line_no, text."""
    return marked_lines(docs).where("dropped").select(
        *_INDEX, "line_no", F.col("line").alias("text")
    )


def _texts(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """What assembled documents consist of, before links are rewritten.

    package, index, line_no, folder, part, text: index lines as they stand, and part bodies at
    the rows that take them.
    """
    own = marked.where(~F.col("dropped") & ~F.col("first")).select(
        *_INDEX, "line_no", F.lit("").alias("folder"), F.lit(False).alias("part"),
        F.col("line").alias("text"),
    )
    inserted = marked.where("first").select(*_INDEX, "line_no", "path", "full_path")
    parts = inserted.join(part_bodies(docs), ["package", "full_path"]).select(
        *_INDEX, "line_no", paths.dir_of(F.col("path")).alias("folder"),
        F.lit(True).alias("part"), F.col("body").alias("text"),
    )
    return own.unionByName(parts)


def _anchor_links(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Links from a text of an assembled document to one of its parts, as anchor links."""
    found = texts.where(F.col("text").contains(".md)")).select(
        *_INDEX,
        "line_no",
        "folder",
        F.posexplode(t.all_matches(F.col("text"), fixed.MD_FILE_LINK)).alias("pos", "_m"),
    )
    target = paths.resolve_path(F.col("folder"), t.group(F.col("_m"), fixed.MD_FILE_LINK, 2))
    links = t.once(found, path=target, label=t.group(F.col("_m"), fixed.MD_FILE_LINK, 1))
    anchors = marked.where(F.col("first") & (F.col("anchor") != "")).select(
        *_INDEX, "path", "anchor"
    )
    return links.join(anchors, [*_INDEX, "path"]).select(
        *_INDEX,
        "line_no",
        "pos",
        "path",
        F.concat(
            F.lit("["), "label", F.lit("](#"), urls.encode_component(F.col("anchor")), F.lit(")")
        ).alias("value"),
    )


def parts_anchor_links(docs: DataFrame, work: WorkFolder | None = None) -> DataFrame:
    """Links between parts as they read in the assembled document."""
    marked = keep(work, marked_lines(docs), "marked")
    links = _anchor_links(_texts(marked, docs), marked)
    return links.withColumnRenamed("value", "markdown")


def assembled_texts(docs: DataFrame, work: WorkFolder | None = None) -> DataFrame:
    """The texts of every assembled document, one row each: package, index, line_no, part, text.

    This is the form to work on when a package has more parts than one row should hold. Texts
    without a link to a file are not joined with anything.
    """
    marked = keep(work, marked_lines(docs), "marked")
    texts = keep(work, _texts(marked, docs), "texts")
    new = (
        _anchor_links(texts, marked)
        .groupBy(*_INDEX, "line_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_new"))
    )
    has_link = F.col("text").contains(".md)")
    linked = texts.where(has_link).join(new, [*_INDEX, "line_no"], "left")
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(
        t.splice(F.col("text"), fixed.MD_FILE_LINK, t.by_position(F.col("_new")))
    )
    columns = [*_INDEX, "line_no", "part", "text"]
    rewritten = linked.withColumn("text", text).select(*columns)
    return rewritten.unionByName(texts.where(~has_link).select(*columns))


def assemble_documents(docs: DataFrame, work: WorkFolder | None = None) -> DataFrame:
    """package, index, markdown, parts: every index that inlines at least one part."""
    text = F.when(F.col("part"), F.concat(F.lit("\n"), F.col("text"), F.lit("\n"))).otherwise(
        F.col("text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", text.alias("text"))))
    joined = (
        assembled_texts(docs, work)
        .groupBy(*_INDEX)
        .agg(
            F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("_text"),
            F.count_if("part").alias("parts"),
        )
    )
    single = F.regexp_replace(F.col("_text"), "\\n{3,}", "\n\n")
    return joined.select(
        *_INDEX, F.concat(F.trim(single, F.lit("\n")), F.lit("\n")).alias("markdown"), "parts"
    )


def publishable(docs: DataFrame, work: WorkFolder | None = None) -> DataFrame:
    """package, path, fm, body, parts: every document that is no part, assembled if it lists some."""
    whole = documents.front_matter(
        docs.where(~F.coalesce(documents.is_part(F.col("text")), F.lit(False))), "text", "fm"
    ).select("package", "path", "fm")
    assembled = assemble_documents(docs, work).withColumnRenamed("index", "path")
    return whole.join(assembled, ["package", "path"], "left").select(
        "package",
        "path",
        "fm",
        F.coalesce("markdown", "fm.body").alias("body"),
        F.coalesce("parts", F.lit(0)).alias("parts"),
    )
