"""News pages to article rows, all with built-in functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import decode_entities, extract_cves, squeeze

# Tags whose content is not a direct text node of its paragraph.
_INLINE = "a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u"
# Containers: the element's name and the pattern of its start tag.
DEFAULT_CONTAINER = ("div", r"""<div\b[^>]*\bclass=["'][^"'>]*\barticlebody\b[^"'>]*["'][^>]*>""")
ARTICLE_CONTAINER = ("article", r"<article\b[^>]*>")
TAGS_CONTAINER = ("span", r"""<span\b[^>]*\bclass=["'][^"'>]*\bcateg\b[^"'>]*["'][^>]*>""")


def element_content(html: Column, element: tuple[str, str]) -> Column:
    """Content of the first element with that start tag, up to the end tag that closes it.

    The rest of the page is cut before each start and end tag of the name; the running
    depth over the pieces tells which end tag is the element's own. One that is
    never closed holds the rest of the page.
    """
    name, start = element
    rest = F.regexp_extract(html, f"(?is){start}(.*)", 1)
    pieces = F.split(rest, rf"(?i)(?=</?{name}[\s>])")
    opened = F.lit(rf"(?i)^<{name}[\s>]")
    closed = F.lit(rf"(?i)^</{name}[\s>]")
    first = lambda depth, seen, end: F.struct(depth.alias("depth"), seen.alias("seen"), end.alias("end"))

    def step(state: Column, piece: Column) -> Column:
        move = F.when(F.regexp(piece, closed), -1).when(F.regexp(piece, opened), 1).otherwise(0)
        depth = state["depth"] + move
        end = F.coalesce(state["end"], F.when(depth < 0, state["seen"]))
        return first(depth, state["seen"] + 1, end)

    found = F.aggregate(pieces, first(F.lit(0), F.lit(0), F.lit(None).cast("int")), step)["end"]
    return F.array_join(F.slice(pieces, F.lit(1), F.coalesce(found, F.size(pieces))), "")


def as_date(value: str | dt.date | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def page_title(html: Column) -> Column:
    """Title up to the first en dash."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.get(F.split(squeeze(decode_entities(raw)), "–"), F.lit(0)))


def page_body(html: Column, container: tuple[str, str] = DEFAULT_CONTAINER) -> Column:
    """Direct text of the paragraphs inside the container, joined by blanks.

    Text inside nested tags (links, bold) is not part of the body.
    """
    region = element_content(html, container)

    def paragraph(p: Column) -> Column:
        inner = F.get(F.split(p, r"(?i)</p\s*>"), F.lit(0))
        direct = F.regexp_replace(
            inner, rf"(?is)<(?:{_INLINE})(?:\s[^>]*)?>.*?(?:</(?:{_INLINE})\s*>|\z)", " "
        )
        return squeeze(decode_entities(F.regexp_replace(direct, r"(?s)<[^>]*>", " ")))

    pieces = F.split(region, r"(?i)<p(?:\s[^>]*)?>")
    texts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), paragraph)
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def _named_month(text: Column, formats: list[str]) -> list[Column]:
    t = F.initcap(squeeze(text))
    return [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats]


def article_date(meta: Column, page: Column, as_of: str | dt.date | Column) -> Column:
    """Date of the meta text, else of the first date in the page, else ``as_of``."""
    formats = ["MMMM d, yyyy", "MMM d, yyyy"]
    iso = F.try_to_timestamp(F.trim(meta), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("date")
    found = F.regexp_extract(page, r"([A-Za-z]{3,9} [0-9]{1,2},\s*[0-9]{4})", 1)
    found = F.regexp_replace(found, r",\s*", ", ")
    return F.coalesce(iso, *_named_month(meta, formats), *_named_month(found, formats), as_date(as_of))


def all_text(html: Column) -> Column:
    """Every text node of a page, scripts included."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[a-zA-Z/!?][^>]*>", " ")
    return squeeze(decode_entities(bare))


def product_mentions(text: Column) -> Column:
    """Sorted distinct products: version phrases, else known names near a flaw word.

    A known name counts when it stands within 50 characters after one of the
    vulnerability words. A version phrase holds only letters, digits, blanks, dots
    and hyphens, so the text is cut at any other character first and only the pieces
    with a telling word are searched.
    """
    runs = F.filter(
        F.split(text, r"[^A-Za-z0-9\s\-.]+"),
        lambda r: r.rlike(r"(?i)version|before|prior\s|up\s+to"),
    )

    def phrases_in(run: Column) -> Column:
        found = []
        for pattern in fixed.PRODUCT_VERSION_PATTERNS:
            names = F.transform(F.regexp_extract_all(run, F.lit(pattern), 1), F.trim)
            if pattern.count("([") > 1:
                versions = F.regexp_extract_all(run, F.lit(pattern), 2)
                names = F.zip_with(names, versions, lambda n, v: F.concat_ws(" ", n, F.trim(v)))
            found.append(names)
        return F.concat(*found)

    # the name alone is looked for first, which is far cheaper
    near = rf"(?i)(?:{fixed.VULNERABILITY_WORDS})[\s\S]{{0,50}}\b"
    named = lambda p: F.contains(F.lower(text), F.lit(p.lower()))
    known = F.array_compact(
        F.array(*[F.when(named(p) & text.rlike(rf"{near}{p}\b"), p) for p in fixed.KNOWN_PRODUCTS])
    )

    def clean(found: Column) -> Column:
        return F.filter(F.transform(found, squeeze), lambda p: p != "")

    phrases = F.flatten(F.transform(runs, phrases_in))
    picked = F.transform(
        F.array(phrases), lambda found: F.when(F.size(found) > 0, clean(found)).otherwise(known)
    )
    return F.array_sort(F.array_distinct(F.element_at(picked, 1)))


def page_tags(html: Column) -> Column:
    """Labels of the page: text of spans inside links of the category span."""
    block = element_content(html, TAGS_CONTAINER)
    links = F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^>]*>\s*<span[^>]*>(.*?)</span>"), 1)
    return F.filter(F.transform(links, lambda t: squeeze(decode_entities(t))), lambda t: t != "")


def parse_article(
    pages: DataFrame,
    as_of: str | dt.date,
    *,
    url: str = "url",
    html: str = "html",
    container: tuple[str, str] = DEFAULT_CONTAINER,
    ingest_ts: Column | None = None,
) -> DataFrame:
    """One article row per (url, html) page."""
    h = F.col(html)
    # the tag first, then its attributes, in whatever order they stand
    published = F.filter(
        F.regexp_extract_all(h, F.lit(r"(?is)<meta\b[^>]*>"), 0),
        lambda m: m.rlike(r"""(?is)\bproperty=["']article:published_time["']"""),
    )
    meta = F.regexp_extract(F.coalesce(F.get(published, F.lit(0)), F.lit("")), r"""(?is)\bcontent=["']([^"']*)["']""", 1)
    full_text = all_text(h)
    return pages.select(
        F.lit(fixed.SOURCE_NEWS).alias("source"),
        F.concat(page_title(h), F.lit(". "), page_body(h, container)).alias("text"),
        article_date(meta, h, as_of).alias("published_date"),
        product_mentions(full_text).alias("products"),
        page_tags(h).alias("tags"),
        F.col(url).alias("url"),
        extract_cves(full_text).alias("cves"),
        (ingest_ts if ingest_ts is not None else F.lit(str(as_of)).cast("timestamp")).alias("ingest_ts_thn"),
    )
