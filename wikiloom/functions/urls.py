"""Page URLs and hrefs.

The parsers are single expressions whose intermediate values are bound, so that every regular
expression runs once per row.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom import fixed
from wikiloom.functions import text as t

_UNKNOWN = "\ufffd"
_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
_HTTP_URL = (
    r"^(?i:(https?)):[/\\]*(?:[^/?#\\@]*@)?([^\s/?#\\:@<>^|%\[\]]+)(?::(\d*))?"
    r"(?:([/\\][^?#]*))?(?:\?([^#]*))?(?:#.*)?$"
)


def decode_component(c: Column, fallback: Column | None = None) -> Column:
    """Percent-decoding; malformed input gives the fallback (the input itself by default)."""

    def decoded(x: Column) -> Column:
        plain = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
        raw = x if fallback is None else fallback
        checked = t.bind(
            plain,
            lambda p: F.when(
                p.isNull() | (p.contains(_UNKNOWN) & ~x.contains(_UNKNOWN)), raw
            ).otherwise(p),
        )
        return F.when(x.contains("%"), checked).otherwise(x)

    return t.bind(c, decoded)


def _decoded(x: Column) -> Column:
    """``decode_component`` of a column at hand, which costs little to mention often, as one compiled expression."""
    plain = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    malformed = plain.isNull() | (plain.contains(_UNKNOWN) & ~x.contains(_UNKNOWN))
    return F.when(x.contains("%") & ~malformed, plain).otherwise(x)


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) alone."""
    out = F.url_encode(c)
    for code, char in (
        ("+", "%20"),
        ("%28", "("),
        ("%29", ")"),
        ("%21", "!"),
        ("%27", "'"),
        ("%7E", "~"),
    ):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def dot_segments(path: Column) -> Column:
    """A URL path without its ``.`` and ``..`` steps."""

    def walked(x: Column) -> Column:
        parts = F.aggregate(
            F.split(x, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        return F.when(x.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(parts, "/")).otherwise(x)

    return t.bind(path, walked)


def _query_page_id(query: Column) -> Column:
    value = decode_component(t.group(query, "(?:^|&)pageId=([^&]*)"))
    return t.bind(value, lambda v: F.when(v.rlike(r"^\d+$"), v))


def page_url_ref(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add struct ``out`` for an absolute page URL; null when it does not point at a page.

    Fields: kind, origin, base_path, cloud, space_key, page_id, title, tiny_url.
    """

    def cut(raw: Column) -> Column:
        return F.struct(
            raw.alias("raw"),
            t.bind(t.group(raw, _HTTP_URL, 1), t.lower).alias("scheme"),
            t.bind(t.group(raw, _HTTP_URL, 2), t.lower).alias("host"),
            t.group(raw, _HTTP_URL, 3).alias("port"),
            decode_component(dot_segments(t.group(raw, _HTTP_URL, 4))).alias("path"),
            _query_page_id(t.group(raw, _HTTP_URL, 5)).alias("pid"),
        )

    def kind_of(u: Column) -> Column:
        return (
            F.when(u["host"] == "", None)
            .when(u["path"].rlike(fixed.SPACE_PAGE_PATH), "space-page")
            .when(u["pid"].isNotNull(), "page-id")
            .when(u["path"].rlike(fixed.DISPLAY_PATH), "display")
            .when(u["path"].rlike(fixed.ANY_PAGE_PATH), "any-page")
            .when(u["path"].rlike(fixed.TINY_PATH), "tiny")
        )

    def ref(u: Column, k: Column) -> Column:
        path = u["path"]
        marker = (
            F.when(k == "space-page", "/spaces/")
            .when(k == "display", "/display/")
            .when(k == "tiny", "/x/")
            .otherwise("/pages/")
        )
        at = F.instr(path, marker)
        base = F.regexp_replace(
            F.when(at > 0, F.substr(path, F.lit(1), at - 1)).otherwise(""), "/+$", ""
        )
        default_port = F.when(u["scheme"] == "https", "443").otherwise("80")
        port = F.when(u["port"].isin("") | (u["port"] == default_port), "").otherwise(
            F.concat(F.lit(":"), u["port"])
        )
        title = F.replace(t.group(path, fixed.DISPLAY_PATH, 2), F.lit("+"), F.lit(" "))
        return t.bind(
            base,
            lambda b: F.struct(
                k.alias("kind"),
                F.concat(u["scheme"], F.lit("://"), u["host"], port).alias("origin"),
                b.alias("base_path"),
                (u["host"].rlike(fixed.CLOUD_HOST) | (b == fixed.CLOUD_BASE)).alias("cloud"),
                F.when(k == "space-page", t.group(path, fixed.SPACE_PAGE_PATH, 1))
                .when(k == "display", t.group(path, fixed.DISPLAY_PATH, 1))
                .alias("space_key"),
                F.when(k == "space-page", t.group(path, fixed.SPACE_PAGE_PATH, 2))
                .when(k == "page-id", u["pid"])
                .when(k == "any-page", t.group(path, fixed.ANY_PAGE_PATH, 1))
                .alias("page_id"),
                F.when(k == "display", title).alias("title"),
                F.when(k == "tiny", u["raw"]).alias("tiny_url"),
            ),
        )

    raw = F.coalesce(t.trim(F.col(url)), F.lit(""))
    parsed = t.bind(
        t.bind(raw, cut),
        lambda u: t.bind(kind_of(u), lambda k: F.when(k.isNotNull(), ref(u, k))),
    )
    return t.once(df, **{out: parsed})


def _origin_parts(origin: str) -> tuple[str, str]:
    """Scheme and host[:port] of the job's own origin, default ports dropped."""
    parts = urlsplit(origin)
    host = (parts.netloc.rsplit("@", 1)[-1]).lower()
    default = {"https": ":443", "http": ":80"}.get(parts.scheme.lower(), "")
    if default and host.endswith(default):
        host = host[: -len(default)]
    return parts.scheme.lower(), host


def page_ref(df: DataFrame, href: str, out: str, origin: str = "") -> DataFrame:
    """Add struct ``out`` (kind, space_key, page_id, title) for a link target, else null.

    ``origin`` is the wiki's own address: absolute links count only on the same host and port.
    """
    keep = df.columns
    own_scheme, own_host = _origin_parts(origin)

    # What every link needs is told apart by substring tests and cut by steps of `once`, which Spark
    # compiles; patterns and bound values are for the links that have what they look for.
    raw = F.col("_raw")
    pseudo, slash = raw.startswith(fixed.PSEUDO_SCHEME), raw.contains("/")
    local = raw.startswith("/") & ~raw.startswith("//")
    authority = t.group(raw, f"^(?:{_SCHEME}:)?//(?:[^/?#@]*@)?([^/?#]*)")
    cut = t.once(df, _raw=F.coalesce(t.trim(F.col(href)), F.lit("")))
    cut = t.once(
        cut,
        _parts=F.when(pseudo, F.split(F.substring(raw, len(fixed.PSEUDO_SCHEME) + 1, 1 << 30), "/")),
        _local=~pseudo & local,
        _authority=F.when(~pseudo & slash & ~local & raw.contains("//"), authority),
    )

    scheme = F.coalesce(t.blank_to_null(F.lower(t.group(raw, f"^({_SCHEME})://"))), F.lit(own_scheme))
    default_port = F.when(scheme == "https", ":443").when(scheme == "http", ":80")
    host = t.lower(F.col("_authority"))
    same_host = F.lit(bool(own_host)) & (
        (host == own_host) | (host.startswith(f"{own_host}:") & (host == F.concat(F.lit(own_host), default_port)))
    )
    hosted_path = t.group(raw, f"^(?:(?:{_SCHEME}:)?//[^/?#]*)?([^?#]*)")
    before_fragment = F.substring_index(raw, "#", 1)
    cut = t.once(
        cut,
        _path=F.when(F.col("_local"), F.substring_index(before_fragment, "?", 1)).when(same_host, hosted_path),
        _query=F.when(raw.contains("pageId="), t.group(raw, r"^[^?#]*\?([^#]*)")),
    )

    path, value = F.col("_path"), F.col("_value")
    cut = t.once(cut, _path=F.when(path.contains("."), dot_segments(path)).otherwise(path))
    asked = t.group(F.col("_query"), "(?:^|&)pageId=([^&]*)")
    cut = t.once(cut, _path=_decoded(path), _value=F.when(path.isNotNull() & (F.col("_query") != ""), asked))
    cut = t.once(cut, _value=_decoded(value), _in_space=F.when(path.contains("/spaces/"), t.group(path, fixed.SPACE_PAGE_PATH, 2)))
    in_space = F.coalesce(F.col("_in_space") != "", F.lit(False))
    by_query = F.coalesce(F.col("_value").rlike(r"^\d+$"), F.lit(False))
    cut = t.once(
        cut,
        _kind=F.when(in_space, "space-page").when(path.isNotNull() & by_query, "page-id"),
        _shown=F.when(~in_space & ~by_query & path.contains("/display/"), t.group(path, fixed.DISPLAY_HREF_PATH, 2)),
    )
    shown = F.coalesce(F.col("_shown") != "", F.lit(False))
    cut = t.once(
        cut,
        _any=F.when(F.col("_kind").isNull() & ~shown & path.contains("/pages/"), t.group(path, fixed.ANY_PAGE_PATH, 1)),
    )

    def fields(kind: str, space: Column | None = None, page_id: Column | None = None, title: Column | None = None) -> Column:
        named = {"space_key": space, "page_id": page_id, "title": title}
        values = [F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in named.values()]
        return F.struct(F.lit(kind).alias("kind"), *[c.alias(name) for name, c in zip(named, values)])

    parts = F.col("_parts")
    title = F.element_at(parts, -1)
    ref = (
        F.when(
            parts.isNotNull(),
            F.when(title != "", fields("pseudo", F.when(F.size(parts) > 1, _decoded(F.get(parts, F.lit(0)))), None, _decoded(title))),
        )
        .when(F.col("_kind") == "space-page", fields("space-page", t.group(path, fixed.SPACE_PAGE_PATH, 1), F.col("_in_space")))
        .when(F.col("_kind") == "page-id", fields("page-id", None, F.col("_value")))
        .when(shown, fields("display", t.group(path, fixed.DISPLAY_HREF_PATH, 1), None, F.replace(F.col("_shown"), F.lit("+"), F.lit(" "))))
        .when(F.col("_any") != "", fields("any-page", None, F.col("_any")))
    )
    return t.once(cut, **{out: ref}).select(*keep, out)


def page_web_url(
    origin: Column, base_path: Column, cloud: Column, space_key: Column, page_id: Column
) -> Column:
    """The canonical address of a page."""
    root = F.concat(origin, base_path)
    space = F.coalesce(t.blank_to_null(space_key), F.lit("~"))
    return F.when(
        cloud, F.concat(root, F.lit("/spaces/"), space, F.lit("/pages/"), page_id)
    ).otherwise(F.concat(root, F.lit("/pages/viewpage.action?pageId="), page_id))
