"""URL validation: an ordered chain of rules, first failing rule gives the reason."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import BLOCKED_DOMAINS, DENY_PATTERN, MAX_URL_LENGTH, SKIP_EXTENSIONS
from .url import CONFUSABLE_RE, IPV6_RE, _col, let, memo, url_parts

# Reason texts (fixed values).
R_FORMAT = "Invalid URL format"
R_SCHEME = "Invalid scheme"
R_BLOCKED = "Blocked domain"
R_EXTENSION = "Blocked file extension"
R_LENGTH = "URL too long"
R_ERROR = "Validation error: "

EXTENSION_RE = "(" + "|".join(re.escape(e) for e in SKIP_EXTENSIONS) + r")\z"
IPV4_RE = r"^\d{1,3}(\.\d{1,3}){3}\z"
TAIL = max(len(e) for e in SKIP_EXTENSIONS) + 3   # characters kept for the extension test


@memo
def raw_host(c) -> Column:
    """Host as written: user info, port and a trailing dot dropped, case kept."""
    return let(url_parts(c), lambda p: _raw_host_of(p["authority"]))


def _raw_host_of(authority: Column) -> Column:
    def of(hp):
        host = F.when(hp.startswith("["), F.regexp_extract(hp, r"^(\[[^\]]*\])", 1)) \
            .otherwise(F.substring_index(hp, ":", 1))
        return F.regexp_replace(host, r"\.\z", "")
    return let(F.regexp_extract(authority, r"(?s)^(?:.*@)?(.*)\z", 1), of)


def in_domains(host: Column, domains: Sequence[str]) -> Column:
    """Host equals one of ``domains`` or is a sub-domain of one (exact case)."""
    if not domains:
        return F.lit(False)
    cond = None
    for d in domains:
        c = (host == F.lit(d)) | host.endswith("." + d)
        cond = c if cond is None else (cond | c)
    return cond


def _parse_error(authority: Column) -> Column:
    def of(inner):
        lb = authority.contains("[")
        rb = authority.contains("]")
        return (F.when(lb != rb, F.lit("Invalid IPv6 URL"))
                .when(lb & inner.startswith("v") & ~inner.rlike(r"^v[a-fA-F0-9]+\..+\z"),
                      F.lit("IPvFuture address is invalid"))
                .when(lb & inner.rlike(IPV4_RE), F.lit("An IPv4 address cannot be in brackets"))
                .when(lb & ~inner.startswith("v") & ~inner.rlike(IPV6_RE),
                      F.concat(F.lit("'"), inner, F.lit("' does not appear to be an IPv4 or IPv6 address"))))
    brackets = F.when(authority.contains("[") | authority.contains("]"),
                      let(F.regexp_extract(authority, r"\[([^\]]*)", 1), of))
    confusable = F.concat(F.lit("netloc '"), authority, F.lit("' contains invalid characters under NFKC normalization"))
    return F.coalesce(brackets, F.when(authority.rlike(CONFUSABLE_RE), confusable))


@memo
def validate_url(c, blocked_domains: Sequence[str] = BLOCKED_DOMAINS,
                 max_length: int = MAX_URL_LENGTH) -> Column:
    """struct<is_valid boolean, reason string>; reason is '' for a valid URL.

    Rules in order: parse error, scheme and authority present, scheme http or
    https, registrable domain not blocked, no blocked file extension at the
    very end (case-blind), at most ``max_length`` characters.
    """
    u = _col(c)

    def build(p):
        def with_err(err):
            host = _raw_host_of(p["authority"])
            reason = (F.when(u.isNull(), F.lit(R_FORMAT))
                      .when(err.isNotNull(), F.concat(F.lit(R_ERROR), err))
                      .when((p["scheme"] == "") | (p["authority"] == ""), F.lit(R_FORMAT))
                      .when(~p["scheme"].isin("http", "https"), F.lit(R_SCHEME))
                      .when(let(host, lambda h: in_domains(h, blocked_domains)), F.lit(R_BLOCKED))
                      # the extension test needs only the end of the lower-cased URL
                      .when(F.lower(F.substring(u, -TAIL, TAIL)).rlike(EXTENSION_RE), F.lit(R_EXTENSION))
                      .when(F.length(u) > max_length, F.lit(R_LENGTH))
                      .otherwise(F.lit("")))
            return let(reason, lambda r: F.struct((r == "").alias("is_valid"), r.alias("reason")))
        return let(_parse_error(p["authority"]), with_err)
    return let(url_parts(u), build)


def is_valid_url(c, **kw) -> Column:
    return validate_url(c, **kw)["is_valid"]


def denied(c, pattern: str = DENY_PATTERN) -> Column:
    """True where the link matches the extractor's deny pattern (case-sensitive).

    The pattern is searched, not anchored at the start, so a leading ``.*``
    adds nothing but backtracking (quadratic on long URLs); it is dropped.
    A final ``$`` becomes ``\\z``: the end of the text, never before a newline.
    """
    rx = pattern[2:] if pattern.startswith(".*") else pattern
    if rx.endswith("$") and not rx.endswith("\\$"):
        rx = rx[:-1] + r"\z"
    return _col(c).rlike(rx)

