"""URL column functions: parse, canonicalise, hash, resolve.

All functions take and return Columns made of built-in expressions (regex,
string, higher-order array functions): no Python in the tasks. Higher-order
functions are interpreted, so the projections that hold these expressions run
outside whole-stage code generation; tables that repeat their URLs should key
the distinct ones (``operators.util.with_distinct_url_key``). The parse follows the standard-library URL
splitter: leading control characters and blanks dropped, tab/CR/LF removed,
scheme ``[A-Za-z][A-Za-z0-9+.-]*:``, authority after ``//`` up to ``/?#``,
fragment split before the query, ``;params`` cut from the last segment.
"""

from __future__ import annotations

import functools
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import (AUTHORITY_CONFUSABLES, DEDUP_TRACKING_PARAMS, HOST_VARIATIONS, TRACKING_PARAMS,
                    USES_NETLOC, USES_PARAMS)

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _ipv6_pattern() -> str:
    """Regex of a textual IPv6 address, built from its rules.

    Eight groups of 1-4 hex digits, or six groups and a dotted IPv4 tail
    (octets 0-255, no leading zeros); one ``::`` may stand for one or more
    zero groups; an optional ``%scope`` (non-empty, no ``%``) may follow.
    """
    h = "[0-9A-Fa-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    alts = []
    for tail, groups in (("", 8), (v4, 6)):
        def seq(n):
            return "" if n == 0 else f"{h}(?::{h}){{{n - 1}}}"
        full = (f"(?:{h}:){{{groups - 1}}}{h}" if not tail else f"(?:{h}:){{{groups}}}{tail}")
        alts.append(full)
        for left in range(groups):
            for right in range(groups - left):
                lhs, rhs = seq(left), seq(right)
                if tail:
                    rhs = f"{rhs}:{tail}" if right else tail
                alts.append(f"{lhs}::{rhs}")
    return "(?:" + "|".join(alts) + ")(?:%[^%]+)?"


IPV6_RE = "^" + _ipv6_pattern() + r"\z"


MEMO_SIZE = 512


def memo(fn):
    """Reuse the Column built for the same input (and hashable options).

    Building a long expression costs thousands of calls into the JVM; the
    unresolved Column for ``fn("url")`` is the same for every DataFrame, so
    it is built once per Spark context (least recently used entries beyond
    ``MEMO_SIZE`` are dropped).
    """
    from collections import OrderedDict
    cache: OrderedDict = OrderedDict()

    @functools.wraps(fn)
    def wrapper(c, *args, **kw):
        try:
            from pyspark import SparkContext
            # a Column is keyed by its full expression text; lambda variables
            # carry unique generated names, so they never collide
            ident = c if isinstance(c, str) else ("col", c._jc.toString())
            key = (SparkContext._active_spark_context.applicationId, ident, args, tuple(sorted(kw.items())))
            hash(key)
        except (TypeError, AttributeError):
            return fn(c, *args, **kw)
        hit = cache.get(key)
        if hit is None:
            hit = cache[key] = fn(c, *args, **kw)
            if len(cache) > MEMO_SIZE:
                cache.popitem(last=False)
        else:
            cache.move_to_end(key)
        return hit
    return wrapper


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Column trees repeat a sub-expression each time it is referenced; long
    URL expressions would grow past what code generation can compile. A
    one-element ``transform`` binds the value once instead.
    """
    return F.transform(F.array(value), body)[0]


# Characters dropped from the start of a URL: C0 controls and blank (fixed).
LEADING_JUNK = "".join(chr(i) for i in range(0x21))


@memo
def clean_url(c) -> Column:
    """Drop leading bytes <= 0x20, then every tab, CR and LF.

    ``ltrim`` over a character set stops at the first kept character; the
    removal regex only runs on the rare URLs that hold a tab or line break.
    """
    def drop_breaks(t):
        has = t.contains("\t") | t.contains("\r") | t.contains("\n")
        return F.when(has, F.regexp_replace(t, r"[\t\r\n]", "")).otherwise(t)
    return let(F.ltrim(_col(c), F.lit(LEADING_JUNK)), drop_breaks)


def _after_first(x: Column, head: Column, sep: str) -> Column:
    """Text after the first ``sep`` ('' when absent), given ``head`` = text before it."""
    return F.when(x.contains(sep), F.substring(x, F.length(head) + 2, F.length(x))).otherwise(F.lit(""))


#: A character that compatibility normalisation would turn into a delimiter.
CONFUSABLE_RE = f"[{AUTHORITY_CONFUSABLES}]"


def _authority_ok(authority: Column) -> Column:
    """False where the authority's brackets, or a delimiter in compatibility form, would make the parser raise."""
    def check(inner):
        host_ok = F.when(inner.startswith("v"), inner.rlike(r"^v[a-fA-F0-9]+\..+\z")).otherwise(
            inner.rlike(IPV6_RE))
        lb = authority.contains("[")
        return (lb == authority.contains("]")) & (~lb | host_ok)
    brackets = F.when(~authority.contains("[") & ~authority.contains("]"), F.lit(True)).otherwise(
        let(F.regexp_extract(authority, r"\[([^\]]*)", 1), check))
    return brackets & ~authority.rlike(CONFUSABLE_RE)


def _split_after(after: Column, scheme: Column, authority: Column) -> Column:
    def from_head(h):
        def from_path(pa):
            cut = scheme.isin(*USES_PARAMS) & pa.contains(";")
            return F.struct(
                scheme.alias("scheme"), authority.alias("authority"),
                F.when(cut, F.regexp_replace(pa, r";[^/]*\z", "")).otherwise(pa).alias("path"),
                F.when(cut, F.regexp_extract(pa, r";([^/]*)\z", 1)).otherwise(F.lit("")).alias("params"),
                _after_first(h, pa, "?").alias("query"),
                _after_first(after, h, "#").alias("fragment"),
                _authority_ok(authority).alias("ok"))
        # split by plain index search, not regex: fragment first, then query
        return let(F.substring_index(h, "?", 1), from_path)
    return let(F.substring_index(after, "#", 1), from_head)


@memo
def url_parts(c) -> Column:
    """Split a URL into struct<scheme, authority, path, params, query, fragment, ok>.

    ``ok`` is false where the standard parser raises (unbalanced or bad
    brackets in the authority, or a character in it whose compatibility form
    holds a delimiter). Null in, null out.
    """
    def from_clean(u):
        def from_scheme(raw):
            # a scheme match is at least one character, so '' means "none"
            has_scheme = raw != ""

            def from_rest(sr):
                rest = sr["rest"]
                has_auth = rest.startswith("//")

                def from_auth(auth):
                    after = F.when(has_auth, F.substring(rest, F.length(auth) + 3, F.length(rest))).otherwise(rest)
                    return _split_after(after, sr["scheme"], auth)
                return let(F.when(has_auth, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit("")),
                           from_auth)
            return let(F.struct(
                F.lower(raw).alias("scheme"),
                F.when(has_scheme, F.substring(u, F.length(raw) + 2, F.length(u))).otherwise(u).alias("rest")),
                from_rest)
        return F.when(u.isNotNull(), let(F.regexp_extract(u, SCHEME_RE, 1), from_scheme))
    return let(clean_url(c), from_clean)


@memo
def url_parse_ok(c) -> Column:
    """True where the URL parses (the canonical form exists); null for null.

    Only brackets and delimiters in compatibility form can make the parse
    fail, so URLs without such characters are decided by one search and never
    parsed here; use it to filter before computing keys.
    """
    c = _col(c)
    return F.when(~c.rlike(rf"[\[\]{AUTHORITY_CONFUSABLES}]"), F.lit(True)).otherwise(url_parts(c)["ok"])


def apply_host_variations(host: Column) -> Column:
    for old, new in HOST_VARIATIONS:
        host = F.replace(host, F.lit(old), F.lit(new))
    return host


def _strip_default_ports(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r":80\z", ""), r":443\z", "")


def qs_decode(x: Column) -> Column:
    """Form-decode a query piece; malformed escapes are kept as they are."""
    return F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def qs_encode(x: Column) -> Column:
    """Form-encode: blank as '+', unreserved set A-Z a-z 0-9 _ . - ~."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query_pairs(query: Column, keep_blank: bool) -> Column:
    """array<struct<k, p, v>> of decoded pairs in input order."""
    pieces = F.split(query, "&")
    if keep_blank:
        kept = F.filter(pieces, lambda x: x != "")
        val = lambda x: F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)
    else:
        kept = F.filter(pieces, lambda x: x.rlike(r"(?s)^[^=]*=."))
        val = lambda x: F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)
    return F.transform(kept, lambda x, i: F.struct(
        qs_decode(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("k"),
        i.alias("p"),
        qs_decode(val(x)).alias("v")))


def canonical_query(query: Column, drop: Sequence[str] = TRACKING_PARAMS,
                    keep_blank: bool = False) -> Column:
    """Parse, drop names, sort by name (values keep their order), re-encode.

    An empty query skips the whole pipeline (most URLs have none).
    """
    def build(q):
        pairs = _query_pairs(q, keep_blank)
        pairs = F.filter(pairs, lambda s: ~s["k"].isin(*drop))
        ordered = F.array_sort(pairs)
        enc = F.array_join(F.transform(ordered, lambda s: F.concat(qs_encode(s["k"]), F.lit("="),
                                                                     qs_encode(s["v"]))), "&")
        return F.when(q == "", F.lit("")).otherwise(enc)
    return let(query, build)


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    def build(r):
        sc, nl, pa, qu = r["s"], r["n"], r["p"], r["q"]
        body = (F.when(nl != "", F.concat(F.lit("//"), nl,
                                          F.when(pa.startswith("/") | (pa == ""), pa)
                                          .otherwise(F.concat(F.lit("/"), pa))))
                .when(pa.startswith("//"), F.concat(F.lit("//"), pa))
                .when((sc != "") & sc.isin(*USES_NETLOC) & ((pa == "") | pa.startswith("/")),
                      F.concat(F.lit("//"), pa))
                .otherwise(pa))
        return F.concat(F.when(sc != "", F.concat(sc, F.lit(":"))).otherwise(F.lit("")),
                        body,
                        F.when(qu != "", F.concat(F.lit("?"), qu)).otherwise(F.lit("")))
    return let(F.struct(scheme.alias("s"), netloc.alias("n"), path.alias("p"), query.alias("q")), build)


@memo
def normalize_url(c) -> Column:
    """Canonical URL; null where the URL cannot be parsed (or is null).

    Host and path lower-cased, ``:80`` then ``:443`` cut from the end of the
    host, host variations replaced anywhere, trailing slashes dropped (empty
    path becomes ``/``), blank query values and tracking parameters dropped,
    parameters sorted by name, path parameters and fragment dropped.
    """
    def build(p):
        host = apply_host_variations(_strip_default_ports(F.lower(p["authority"])))
        path = let(F.rtrim(F.lower(p["path"]), F.lit("/")),
                   lambda x: F.when(x == "", F.lit("/")).otherwise(x))
        query = canonical_query(p["query"], TRACKING_PARAMS, keep_blank=False)
        return F.when(p["ok"], _unsplit(p["scheme"], host, path, query))
    return let(url_parts(c), build)


@memo
def normalize_query(c, drop: Sequence[str] = DEDUP_TRACKING_PARAMS, keep_blank: bool = True) -> Column:
    """Second query pass: ``scheme://authority/path[?sorted query]``.

    Blank values kept, five tracking names dropped; on a canonical URL with
    an authority this is the identity.
    """
    def build(p):
        base = F.concat(p["scheme"], F.lit("://"), p["authority"], p["path"])
        return F.when(p["ok"], let(canonical_query(p["query"], drop, keep_blank=keep_blank),
                                   lambda q: F.when(q != "", F.concat(base, F.lit("?"), q)).otherwise(base)))
    return let(url_parts(c), build)


@memo
def canonical_domain(c) -> Column:
    """Lower-cased host, cut at the first ':', host variations applied."""
    return let(url_parts(c), lambda p: F.when(
        p["ok"], apply_host_variations(F.substring_index(F.lower(p["authority"]), ":", 1))))


@memo
def strip_url(c) -> Column:
    """Light form ``scheme://authority/path`` without default ports; case kept.

    Where the URL cannot be parsed the input comes back unchanged.
    """
    c = _col(c)
    return let(url_parts(c), lambda p: F.when(p["ok"], F.concat(
        p["scheme"], F.lit("://"), _strip_default_ports(p["authority"]), p["path"])).otherwise(c))


@memo
def url_authority(c) -> Column:
    """Raw authority (netloc): case, port and user info kept."""
    return let(url_parts(c), lambda p: F.when(p["ok"], p["authority"]))


@memo
def url_scheme(c) -> Column:
    return let(url_parts(c), lambda p: F.when(p["ok"], p["scheme"]))


@memo
def url_hostname(c) -> Column:
    """Host name: user info and port dropped, lower-cased, null when empty."""
    def build(p):
        def host_of(hp):
            return F.lower(F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1))
                           .otherwise(F.substring_index(hp, ":", 1)))
        host = let(F.regexp_extract(p["authority"], r"(?s)^(?:.*@)?(.*)\z", 1), host_of)
        return let(host, lambda h: F.when(p["ok"] & (h != ""), h))
    return let(url_parts(c), build)


@memo
def link_scheme(c) -> Column:
    """Lower-cased scheme of a URL by its prefix alone ('' when none)."""
    return F.lower(F.regexp_extract(clean_url(c), SCHEME_RE, 1))


def url_hash(c, algo: str = "sha256") -> Column:
    """Key of a canonical URL: hex SHA-256 (default) or 128-bit MD5."""
    c = _col(c)
    if algo == "sha256":
        return F.sha2(c, 256)
    if algo == "md5":
        return F.md5(c)
    raise ValueError(f"unknown hash {algo!r}")


def _remove_dot_segments(path: Column, squeeze_inner: bool) -> Column:
    def on_segs(segs):
        if squeeze_inner:
            n = F.size(segs)
            segs = F.when(n > 2, F.concat(F.slice(segs, 1, 1),
                                           F.filter(F.slice(segs, 2, n - 2), lambda s: s != ""),
                                           F.slice(segs, n, 1))).otherwise(segs)
        return let(segs, resolve_segs)

    def resolve_segs(segs):
        empty = F.array().cast("array<string>")
        out = F.aggregate(segs, empty, lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s)))
        last = F.try_element_at(segs, F.lit(-1))
        out = F.when(last.isin(".", ".."), F.array_append(out, F.lit(""))).otherwise(out)
        return let(F.array_join(out, "/"), lambda j: F.when(j == "", F.lit("/"))
                   .when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))
    return let(F.split(path, "/"), on_segs)


def _tidy_markers(x: Column) -> Column:
    """Drop an empty query marker (``?`` before ``#`` or the end) and an empty fragment marker."""
    return F.regexp_replace(F.regexp_replace(x, r"^([^?#]*)\?(#|\z)", "$1$2"), r"^([^#]*)#\z", "$1")


def resolve_url(base, href, base_parts: Column | None = None) -> Column:
    """Make ``href`` absolute against ``base`` (the page URL), as ``urljoin`` does.

    Absolute links are kept (same scheme with an authority: scheme lower-cased
    and empty ``?``/``#`` markers dropped); ``//host/p`` takes the base
    scheme; ``''`` is the base. Everything else is a relative reference:
    an empty path keeps the base path (and, without a query of its own, the
    base query); ``/p`` is rooted; other paths merge with the base
    directory; dot segments are removed; ``//`` with an empty authority is
    read as the reference after it. ``base_parts`` (``url_parts(base)``)
    may be passed in when many links share one base.
    """
    base = _col(base)

    def build(r):
        h, bp = r["h"], r["bp"]
        hsch = link_scheme(h)
        has_net = h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")
        pr_net = h.rlike(r"^//[^/?#]")
        rel = F.when(h.startswith("//"), F.substring(h, 3, F.length(h))).otherwise(h)

        def relative(parts):
            hpath, hq, hf = parts["p"], parts["q"], parts["f"]
            origin = F.concat(bp["scheme"], F.lit("://"), bp["authority"])
            base_path = F.when(bp["params"] != "", F.concat(bp["path"], F.lit(";"), bp["params"])).otherwise(bp["path"])
            base_dir = F.regexp_extract(bp["path"], r"(?s)^(.*/)", 1)
            path = (F.when(hpath == "", base_path)
                    .when(hpath.startswith("/"), _remove_dot_segments(hpath, False))
                    .otherwise(_remove_dot_segments(
                        F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), hpath), True)))
            query = F.when((hpath == "") & (hq == ""), bp["query"]).otherwise(hq)
            return F.concat(origin, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                             F.when(hf != "", F.concat(F.lit("#"), hf)).otherwise(F.lit("")))

        def split_rel(head):
            return F.struct(F.substring_index(head, "?", 1).alias("p"),
                            _after_first(head, F.substring_index(head, "?", 1), "?").alias("q"),
                            _after_first(rel, head, "#").alias("f"))
        rel_result = let(split_rel(F.substring_index(rel, "#", 1)), relative)
        same = has_net & (hsch == bp["scheme"])
        return (F.when(h.isNull() | base.isNull(), F.lit(None).cast("string"))
                .when(h.rlike(SCHEME_RE), F.when(same, F.concat(hsch, F.substring(_tidy_markers(h), F.length(hsch) + 1,
                                                                                   F.length(h)))).otherwise(h))
                .when(pr_net, F.concat(bp["scheme"], F.lit(":"), _tidy_markers(h)))
                .when(h == "", base)
                .otherwise(rel_result))
    bp = base_parts if base_parts is not None else url_parts(base)
    return let(F.struct(F.trim(_col(href)).alias("h"), bp.alias("bp")), build)
