"""Columns of whole Markdown documents: front matter, titles, types, fenced regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom import fixed
from wikiloom.functions import text as t

_BINDING_LINE = f"^{fixed.BINDING_KEY}{fixed.WS}*$"
_BINDING_IN_BLOCK = f"{fixed.M_BOL}{fixed.BINDING_KEY}{fixed.WS}*{fixed.M_EOL}"
_URL_IN_BLOCK = f"{fixed.M_BOL}{fixed.WS}+url:{fixed.WS}*({fixed.NOT_WS}+){fixed.WS}*{fixed.M_EOL}"
_VERSION_IN_BLOCK = f"{fixed.M_BOL}{fixed.WS}+version:{fixed.WS}*(\\d+){fixed.WS}*{fixed.M_EOL}"
_BOUND_FIELD = f"^{fixed.WS}+(?:url|version):"
_FIRST_H1 = f"{fixed.M_BOL}#[ \\t]+({fixed.ANY}+)\\r?\\n?"


def front_matter(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add struct ``out``: bound, url, version, extra_lines, raw_length, body."""
    whole = F.col(text)

    def fields(head: Column, block: Column, url: Column) -> Column:
        bound = block.rlike(_BINDING_IN_BLOCK) & (url != "")
        version = t.blank_to_null(t.group(block, _VERSION_IN_BLOCK)).cast("int")

        def split(is_bound: Column) -> Column:
            extra = F.filter(
                F.split(block, r"\r?\n", -1),
                lambda line: (t.trim(line) != "")
                & (~is_bound | ~(line.rlike(_BINDING_LINE) | line.rlike(_BOUND_FIELD))),
            )
            return F.struct(
                is_bound.alias("bound"),
                F.when(is_bound, url).alias("url"),
                F.when(is_bound, F.coalesce(version, F.lit(0))).alias("version"),
                extra.alias("extra_lines"),
                F.length(head).alias("raw_length"),
                F.substr(whole, F.length(head) + 1).alias("body"),
            )

        return t.bind(bound, split)

    def parsed(head: Column) -> Column:
        return t.bind(
            t.group(head, fixed.FRONT_MATTER, 1),
            lambda block: t.bind(
                t.group(block, _URL_IN_BLOCK), lambda url: fields(head, block, url)
            ),
        )

    return t.once(df, **{out: t.bind(t.group(whole, fixed.FRONT_MATTER, 0), parsed)})


def compose_front_matter(url: Column, version: Column, extra_lines: Column) -> Column:
    head = F.array(
        F.lit("---"),
        F.lit(fixed.BINDING_KEY),
        F.concat(F.lit("  url: "), url),
        F.concat(F.lit("  version: "), version.cast("string")),
    )
    return F.array_join(F.concat(head, extra_lines, F.array(F.lit("---"), F.lit(""))), "\n")


def source_id(extra_lines: Column) -> Column:
    """The page id a saved document names itself, '' without one."""
    return t.group(
        F.array_join(extra_lines, "\n"),
        f"{fixed.M_BOL}sourceId:{fixed.WS}*(\\d+){fixed.WS}*{fixed.M_EOL}",
    )


def first_title(body: Column) -> Column:
    """The first level-one heading line, '' without one."""
    return t.trim(t.group(body, f"{fixed.M_BOL}#[ \\t]+({fixed.ANY}+){fixed.M_EOL}"))


def title_of(body: Column, fallback: Column) -> Column:
    return F.when(body.rlike(_FIRST_H1), t.trim(t.group(body, _FIRST_H1))).otherwise(fallback)


def body_without_title(body: Column) -> Column:
    """The body without the first occurrence of its first level-one heading line."""
    line = t.group(body, _FIRST_H1, 0)
    at = F.instr(body, line)
    return F.when(
        line != "",
        F.concat(F.substr(body, F.lit(1), at - 1), F.substr(body, at + F.length(line))),
    ).otherwise(body)


def doc_type(markdown: Column, title: Column) -> Column:
    """The first type whose marks the document carries."""
    title = F.coalesce(title, F.lit(""))

    def has(mark: str, pattern: str) -> Column:
        """A substring test spares the texts without ``mark``, which is part of every match."""
        return F.when(markdown.contains(mark), markdown.rlike(pattern)).otherwise(False)

    view = has("- **", fixed.VIEW_BULLET) & (
        has("# UI: ", fixed.VIEW_TITLE_LINE)
        | title.rlike(fixed.VIEW_TITLE)
        | has("View structure", fixed.VIEW_SECTION)
    )
    mapping = (
        has("## Field mappings", fixed.MAPPING_SECTION)
        | has("# Mapping: ", fixed.MAPPING_TITLE_LINE)
        | title.rlike(fixed.MAPPING_TITLE)
    )
    contract = has("## Data model", fixed.CONTRACT_SECTION) & (
        markdown.rlike(fixed.CONTRACT_OPERATIONS) | markdown.rlike(fixed.CONTRACT_TABLE)
    )
    return (
        F.when(view, fixed.DOC_TYPES["view"])
        .when(mapping, fixed.DOC_TYPES["mapping"])
        .when(contract, fixed.DOC_TYPES["contract"])
        .otherwise(fixed.DOC_TYPES["plain"])
    )


def strip_part_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, fixed.PART_FRONT_MATTER, "")


def is_part(text: Column) -> Column:
    """The document declares itself part of a split document."""
    block = t.group(text, fixed.PART_FRONT_MATTER)
    return block.rlike(
        f"{fixed.M_BOL}(?:type:[ \\t]*{fixed.NOT_WS}+-part[ \\t]*{fixed.M_EOL}"
        f"|parent:[ \\t]*{fixed.NOT_WS})"
    )


def fence_chunks(markdown: Column) -> Column:
    """array<struct<text, fenced>>: the document cut in front of every fence line.

    Chunks joined by a line feed give the document back. A fence line opens a fenced chunk or
    closes it; in the latter case it is the first line of the next, unfenced chunk.
    """
    cut = F.split(markdown, f"\\n(?={fixed.TOGGLE_FENCE})", -1)
    chunks = F.when(~(markdown.contains("```") | markdown.contains("~~~")), F.array(markdown)).otherwise(cut)
    offset = markdown.rlike(f"\\A{fixed.TOGGLE_FENCE}").cast("int")
    return F.transform(
        chunks,
        lambda c, i: F.struct(c.alias("text"), ((i + offset) % 2 == 1).alias("fenced")),
    )


def fenced_lines(markdown: Column) -> Column:
    """array<struct<line, is_fence, fenced>>, one element per line; no shuffle, linear."""
    return F.flatten(
        F.transform(
            fence_chunks(markdown),
            lambda chunk: F.transform(
                F.split(chunk["text"], "\n", -1),
                lambda line, i: F.struct(
                    line.alias("line"),
                    ((i == 0) & line.rlike(f"^{fixed.TOGGLE_FENCE}")).alias("is_fence"),
                    chunk["fenced"].alias("fenced"),
                ),
            ),
        )
    )
