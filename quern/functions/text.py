"""Column functions on text: normal forms, fingerprints, quotes, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character, for Java's regular expressions.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Characters that don't count when a quote is looked for loosely.
LOOSE = " \t\r\n　，。、；：！？“”‘’（）《》〈〉【】…—～·,.;:!?\"'()[]<>-"
MIN_QUOTE_CHARS = 6
#: HTML blocks without text, elements that end a line, and entities, of which the ampersand comes last.
HIDDEN_BLOCKS = "script|style|noscript|svg|iframe"
LINE_ENDS = "p|div|li|tr|h[1-6]|section|article|blockquote|br"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))
#: Sites by domain; the first that fits wins.
SITES = (
    ("mafengwo.cn", "mafengwo"), ("mafengwo.com", "mafengwo"), ("zhihu.com", "zhihu"), ("zhuanlan.zhihu.com", "zhihu"), ("qyer.com", "qiongyou"),
    ("ctrip.com", "ctrip"), ("you.ctrip.com", "ctrip"), ("xiaohongshu.com", "xhs"), ("xhslink.com", "xhs"),
)
#: What a page loads by itself.
LOADED = (r"""<script[^>]+src=["']([^"']+)""", r"""<link[^>]+href=["']([^"']+)""", r"""<img[^>]+src=["']([^"']+)""", r"""@import\s+(?:url\()?["']([^"']+)""", r"""url\(["']?(https?://[^)"']+)""")
SNIPPET_CHARS = 80


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squash(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE, "")


def normal_body(text: Column) -> Column:
    """One kind of line end, no blanks at line ends, one blank line at most between lines, none at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(squash(text), 256)


def without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def quote_verdict(quote: Column, body: Column) -> Column:
    """exact, loose, too_short or missing."""
    text = strip(quote)
    loose = without(text, LOOSE)
    return (
        F.when(F.length(text) < MIN_QUOTE_CHARS, "too_short")
        .when(body.contains(text), "exact")
        .when((loose != "") & without(body, LOOSE).contains(loose), "loose")
        .otherwise("missing")
    )


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def gram_hashes(text: Column, size: int) -> Column:
    """A hash of each run of so many characters, in their order; the text is taken apart once, so that long ones take time in proportion."""
    hashed = F.transform(F.array(characters(text)), lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (size - 1)), lambda i: F.xxhash64(F.slice(x, i, F.lit(size)))))
    return F.when(F.length(text) >= size, hashed[0]).otherwise(F.array().cast("array<bigint>"))


def occurrences(text: Column, part: Column) -> Column:
    """Number of occurrences that don't overlap; 0 for an empty part."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def site_of(url: Column) -> Column:
    """The site that a page's host belongs to, or manual."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    out = F.when(host == "", "manual")
    for domain, site in SITES:
        out = out.when((host == domain) | host.endswith("." + domain), site)
    return F.coalesce(out.otherwise("manual"), F.lit("manual"))


def external_resources(html: Column) -> Column:
    """Addresses on other hosts that a page loads by itself, by kind and then by place."""
    found = [F.regexp_extract_all(html, F.lit("(?i)" + x), F.lit(1)) for x in LOADED]
    return F.filter(F.concat(*found), lambda x: x.startswith("http://") | x.startswith("https://") | x.startswith("//"))


def snippet(body: Column, offset: Column) -> Column:
    """The text around a place, with an ellipsis where it goes on; offset counts from 0."""
    half = SNIPPET_CHARS // 2
    start, end = F.greatest(F.lit(0), offset - half), F.least(F.length(body), offset + half)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, end - start), F.when(end < F.length(body), "…").otherwise(""))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: hidden blocks go, block ends become line ends, tags go, entities are read once."""
    out = F.regexp_replace(html, rf"(?is)<({HIDDEN_BLOCKS})\b.*?</\1>", "")
    out = F.regexp_replace(out, rf"(?i)<br\s*/?>|</({LINE_ENDS})\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return normal_body(out)
