"""HTML fragments as columns: blocks, element text, attributes and urls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a refused page, and shortest useful page sizes.
BLOCK_MARKERS = ["antibot", "xxzlGatewayUrl"]
IMAGE_BLOCK_MARKERS = ["CAPTCHA"]
MIN_LENGTH = {"feed": 3000, "list": 5000, "images": 10000}

# Characters named by the common entities.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain_text(c: Column) -> Column:
    """Text of a fragment with tags removed and each piece trimmed, joined without gaps."""
    return F.btrim(unescape(F.regexp_replace(c, r"(?s)\s*<[^>]*>\s*", "")))


def spaced_text(c: Column) -> Column:
    """Text of a whole page: scripts and styles dropped, tags replaced by one space."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.btrim(unescape(F.regexp_replace(bare, r"\s+", " ")))


def _class_pattern(name: str) -> str:
    return rf'class="(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?"'


# A tag up to its class attribute; possessive, so a tag without one fails at once.
_TO_CLASS = r"<([a-z0-9]++)[^>c]*+(?:c(?!lass=)[^>c]*+)*+"


def blocks(html: Column, tag: str, class_name: str | None = None) -> Column:
    """Inner blocks ``<tag …>…</tag>`` (no nesting of the same tag) as an array."""
    attrs = rf"[^>]*{_class_pattern(class_name)}[^>]*" if class_name else r"(?:\s[^>]*)?"
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}{attrs}>.*?</{tag}>"), F.lit(0))


def element_html(block: Column, class_name: str) -> Column:
    """Inner markup of the first element carrying a class; '' when absent."""
    return F.regexp_extract(
        block, rf"(?s){_TO_CLASS}{_class_pattern(class_name)}[^>]*+>(.*?)</\1>", 2)


def element_text(block: Column, class_name: str) -> Column:
    return plain_text(element_html(block, class_name))


def element_texts(block: Column, class_name: str) -> Column:
    """Non-blank texts of all elements carrying a class, in order."""
    found = F.regexp_extract_all(
        block, F.lit(rf"(?s){_TO_CLASS}{_class_pattern(class_name)}[^>]*+>(.*?)</\1>"),
        F.lit(2))
    return F.filter(F.transform(found, plain_text), lambda x: x != "")


def tag_texts(fragment: Column, tag: str) -> Column:
    found = F.regexp_extract_all(fragment, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, plain_text)


def attribute(block: Column, tag: str, name: str) -> Column:
    return unescape(F.regexp_extract(block, rf'(?s)<{tag}\b[^>]*?\s{name}="([^"]*)"', 1))


def attributes(block: Column, tag: str, name: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(rf'(?s)<{tag}\b[^>]*?\s{name}="([^"]*)"'), F.lit(1))
    return F.transform(found, unescape)


def meta_content(html: Column, name: str) -> Column:
    """Content of a named meta tag, attributes in either order."""
    return F.coalesce(
        F.nullif(F.regexp_extract(html, rf'<meta[^>]+name="{name}"[^>]+content="([^"]+)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(html, rf'<meta[^>]+content="([^"]+)"[^>]+name="{name}"', 1), F.lit("")),
        F.lit(""))


def page_status(html: Column, kind: str = "list") -> Column:
    """'short', 'blocked' or 'ok'."""
    marks = IMAGE_BLOCK_MARKERS if kind == "images" else BLOCK_MARKERS
    blocked = F.lit(False)
    for mark in marks:
        blocked = blocked | html.contains(mark)
    return (F.when(F.length(html) < MIN_LENGTH[kind], "short").when(blocked, "blocked").otherwise("ok"))


def url_without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "")


def url_base(url: Column) -> Column:
    """Identity of an image without query and size suffix ('!' or a trailing '.WxH.ext')."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"!.*$", "")
    return F.regexp_replace(bare, r"\.[0-9]+x[0-9]+(?=\.[A-Za-z]+$)", "")


def with_scheme(url: Column) -> Column:
    return (F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
            .when(url.rlike("^https?://"), url)
            .otherwise(F.concat(F.lit("https://"), url)))


# Marks of template pictures that are not photos of the listing.
TEMPLATE_MARKS = ["hdic-frame", "static", "default", "photo_none"]
IMAGE_HOSTS = {
    "a": r'pic[0-9]*\.ajkimg\.com/display/anjuke/[^"\s<>)]+\.(?:jpg|jpeg|png|webp)',
    "b": r'(?:image[0-9]*|pic[0-9]*)\.ljcdn\.com/[^"\s<>)]+',
}
ANY_IMAGE = r'https?://[^"\s<>]+\.(?:jpg|jpeg|png|webp)'


def extract_urls(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def drop_templates(urls: Column, marks: list[str] = TEMPLATE_MARKS) -> Column:
    def real(u: Column) -> Column:
        keep = F.lit(True)
        for mark in marks:
            keep = keep & ~u.contains(mark)
        return keep
    return F.filter(urls, real)


def distinct_by_base(urls: Column, base=url_base) -> Column:
    """First url per base, order kept."""
    bases = F.transform(urls, base)
    return F.filter(urls, lambda u, i: F.array_position(bases, base(u)) == (i + 1))


def image_urls(html: Column, source: str, limit: int = 6, enough: int = 3) -> Column:
    """Listing pictures: the source's own host first, then any image while fewer than ``enough``."""
    own = F.transform(extract_urls(html, IMAGE_HOSTS[source]),
                      lambda u: F.concat(F.lit("https://"), u))
    if source == "b":
        own = distinct_by_base(drop_templates(own, TEMPLATE_MARKS[:2]))
        other = drop_templates(extract_urls(html, ANY_IMAGE), TEMPLATE_MARKS[1:])
    else:
        own = distinct_by_base(own, url_without_query)
        tagged = F.concat(*[attributes(html, "img", a) for a in ("src", "data-src", "data-original")])
        other = F.filter(
            F.transform(tagged, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)),
            lambda u: u.contains("ajkimg.com/display/anjuke"))
    filled = F.when(F.size(own) < enough, F.array_distinct(F.concat(own, other))).otherwise(own)
    return F.slice(filled, 1, limit)
