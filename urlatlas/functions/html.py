"""Page column functions over raw HTML text, built-in expressions only.

These are regex re-statements of CSS-selector reads: ``title::text``,
``meta[name="description"]::attr(content)``, ``body ::text`` and
``a/area[href]``. On badly broken markup they can differ from a real
HTML parser (documented in the README); they never leave the JVM.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import _col, let, memo

# A character reference: decimal, hexadecimal, or a name that ends in ";".
REFERENCE_RE = r"&(?:#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)"

# Names met most, looked up first (fixed values); the others come from the standard table.
COMMON_NAMES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}


def named_references() -> dict[str, str]:
    """``&name;`` to its text, from the standard library's table of HTML names."""
    from html.entities import html5
    return {f"&{name}": text for name, text in html5.items() if name.endswith(";")}

COMMENT_RE = r"(?s)<!--.*?(-->|\z)"
TAG_RE = r"<[A-Za-z/!?][^>]*>?"
ATTR_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _code_point(n: Column) -> Column:
    """The character of a code point; U+FFFD for zero, surrogates and what lies beyond Unicode."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    code = F.when(ok, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _reference_text(r: Column) -> Column:
    """What one character reference stands for; an unknown name stays as written."""
    digits = F.regexp_replace(r, r"[^0-9A-Fa-f]", "")
    out = F.when(r.rlike(r"^&#[xX]"), _code_point(F.conv(digits, 16, 10).cast("long")))
    out = out.when(r.startswith("&#"), _code_point(digits.cast("long")))
    for name, text in COMMON_NAMES.items():
        out = out.when(r == F.lit(name), F.lit(text))
    table = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")  # folded to a constant
    return out.otherwise(F.coalesce(F.try_element_at(table, r), r))


@memo
def decode_entities(c) -> Column:
    """Decodes every character reference once, from left to right (``&amp;lt;`` gives ``&lt;``)."""
    def decoded(t):
        refs = F.regexp_extract_all(t, F.lit(REFERENCE_RE), F.lit(0))
        between = F.split(t, REFERENCE_RE, -1)
        both = F.zip_with(between, refs, lambda b, r: F.concat(b, F.when(r.isNull(), F.lit("")).otherwise(_reference_text(r))))
        return F.when(t.contains("&"), F.array_join(both, "")).otherwise(t)
    return let(_col(c), decoded)


def attr(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` in one tag's text; null when absent."""
    rx = r"(?is)[\s\"'/]" + name + ATTR_VALUE
    val = F.concat(F.regexp_extract(tag, rx, 1), F.regexp_extract(tag, rx, 2), F.regexp_extract(tag, rx, 3))
    return F.when(tag.rlike(rx), decode_entities(val))


@memo
def page_title(html) -> Column:
    """First text of a ``<title>`` that has one; null when there is none."""
    t = F.regexp_extract(_col(html), r"(?is)<title\b[^>]*>([^<]+)", 1)
    return F.when(t != "", decode_entities(t))


@memo
def page_description(html) -> Column:
    """``content`` of the first ``<meta name="description">`` (attribute order free)."""
    metas = F.regexp_extract_all(_col(html), F.lit(r"(?is)<meta\b[^>]*>"), 0)
    named = F.filter(metas, lambda m: m.rlike(r"(?is)[\s\"'/]name\s*=\s*(\"description\"|'description'|description[\s/>])"))
    first = F.try_element_at(named, F.lit(1))
    return F.when(F.size(named) > 0, attr(first, "content"))


@memo
def body_text(html, collapse: bool = False) -> Column:
    """Text nodes under ``<body>`` joined by one blank, lower-cased.

    From the end of the ``<body ...>`` tag to ``</body>`` or the end of the
    text; comments and runs of tags become one separator; entities decoded.
    A page without a body tag gives an empty text. ``collapse`` squeezes
    every run of white space to one blank.
    """
    h = _col(html)
    inner = F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    inner = F.regexp_replace(inner, COMMENT_RE, "<!>")
    # one tag at a time, then runs of the separator: a repeated group would recurse in the regex engine
    inner = F.regexp_replace(F.regexp_replace(inner, TAG_RE, "\u0001"), "\u0001+", "\u0001")
    inner = F.regexp_replace(inner, r"^\u0001|\u0001\z", "")
    text = F.lower(decode_entities(F.replace(inner, F.lit("\u0001"), F.lit(" "))))
    if collapse:
        text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return text


def find_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords (input order and spelling kept) whose lower case occurs in ``text``.

    ``text`` must already be lower-cased (``body_text``). An empty list gives
    an empty array and the text is never computed.
    """
    if not keywords:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lower(F.lit(k)).alias("l")) for k in keywords])  # folded: lowered once, not per row
    # bind the text once: a lambda body would otherwise re-evaluate it per keyword
    return let(text, lambda t: F.filter(pairs, lambda p: F.instr(t, p["l"]) > 0)["k"])


@memo
def extract_hrefs(html) -> Column:
    """``href`` values of ``<a>`` and ``<area>`` tags, in page order (comments skipped)."""
    h = F.regexp_replace(_col(html), COMMENT_RE, "")
    tags = F.regexp_extract_all(h, F.lit(r"(?is)<(?:a|area)\s[^>]*>"), 0)
    return F.filter(F.transform(tags, lambda t: F.trim(attr(t, "href"))), lambda x: x.isNotNull())


@memo
def page_bytes(html) -> Column:
    """Size of the page in UTF-8 bytes (not characters)."""
    return F.octet_length(_col(html)).cast("bigint")


def content_type(headers) -> Column:
    """First ``Content-Type`` value of a ``map<string, array<string>>`` header map."""
    return F.try_element_at(F.try_element_at(_col(headers), F.lit("Content-Type")), F.lit(1))
