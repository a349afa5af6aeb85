"""DuckDB twins of the column functions, as SQL text, for the correctness oracle.

Each helper adds columns to a relation in stages (``SELECT *, expr AS name
FROM (...)``) so long expressions are written once. The SQL restates the
same rules as ``urlatlas.functions``; it never calls Spark.
"""

from __future__ import annotations

import re
from html.entities import html5
from typing import Iterable, Sequence

from ..functions.url import _ipv6_pattern
from ..functions.validate import (R_BLOCKED, R_ERROR, R_EXTENSION, R_FORMAT, R_LENGTH,
                                  R_SCHEME)
from ..spec import (BLOCKED_DOMAINS, DEDUP_TRACKING_PARAMS, HOST_VARIATIONS,
                    LINK_SCHEMES, MAX_URL_LENGTH, SKIP_EXTENSIONS, TRACKING_PARAMS,
                    USES_NETLOC, USES_PARAMS)

# The names the tables hold, and some more; the full table is checked against literal values in the tests.
ORACLE_NAMES = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;", "eacute;", "hellip;")

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
IPV6_SQL = "^" + _ipv6_pattern() + "$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values: Iterable) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def stage(src: str, cols: Sequence[tuple]) -> str:
    sel = ", ".join(f"{e} AS {a}" for a, e in cols)
    return f"(SELECT *, {sel} FROM {src})"


def parts(src: str, col: str, p: str) -> str:
    """Add ``{p}_scheme, {p}_auth, {p}_path, {p}_query, {p}_ok`` parsed from ``col``."""
    s = stage(src, [(f"{p}_u", f"regexp_replace(regexp_replace({col}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')")])
    s = stage(s, [(f"{p}_hs", f"regexp_matches({p}_u, {q(SCHEME)})")])
    s = stage(s, [(f"{p}_scheme", f"CASE WHEN {p}_hs THEN lower(regexp_extract({p}_u, {q('^([A-Za-z][A-Za-z0-9+.\\-]*):')}, 1)) ELSE '' END"),
                  (f"{p}_rest", f"CASE WHEN {p}_hs THEN regexp_replace({p}_u, {q(SCHEME)}, '') ELSE {p}_u END")])
    s = stage(s, [(f"{p}_auth", f"CASE WHEN starts_with({p}_rest, '//') THEN regexp_extract({p}_rest, '^//([^/?#]*)', 1) ELSE '' END"),
                  (f"{p}_after", f"CASE WHEN starts_with({p}_rest, '//') THEN regexp_replace({p}_rest, '^//[^/?#]*', '') ELSE {p}_rest END")])
    s = stage(s, [(f"{p}_head", f"regexp_extract({p}_after, '^([^#]*)', 1)"),
                  (f"{p}_frag", f"regexp_extract({p}_after, '(?s)^[^#]*#(.*)$', 1)")])
    s = stage(s, [(f"{p}_query", f"regexp_extract({p}_head, '(?s)^[^?]*\\?(.*)$', 1)"),
                  (f"{p}_pall", f"regexp_extract({p}_head, '^([^?]*)', 1)")])
    inner = f"regexp_extract({p}_auth, '\\[([^\\]]*)', 1)"
    ok = (f"(contains({p}_auth, '[') = contains({p}_auth, ']')) AND (NOT contains({p}_auth, '[') OR "
          f"CASE WHEN starts_with({inner}, 'v') THEN regexp_matches({inner}, '^v[a-fA-F0-9]+\\..+$') "
          f"ELSE regexp_matches({inner}, {q(IPV6_SQL)}) END)")
    cut = f"({p}_scheme IN {in_list(USES_PARAMS)} AND contains({p}_pall, ';'))"
    s = stage(s, [(f"{p}_path", f"CASE WHEN {cut} THEN regexp_replace({p}_pall, ';[^/]*$', '') ELSE {p}_pall END"),
                  (f"{p}_params", f"CASE WHEN {cut} THEN regexp_extract({p}_pall, ';([^/]*)$', 1) ELSE '' END"),
                  (f"{p}_ok", ok)])
    return s


def host_variations(x: str) -> str:
    for old, new in HOST_VARIATIONS:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def strip_ports(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, ':80$', ''), ':443$', '')"


def dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def canonical_query(query: str, drop: Sequence[str], keep_blank: bool) -> str:
    keep = "lambda x: x <> ''" if keep_blank else "lambda x: regexp_matches(x, '(?s)^[^=]*=.')"
    key = dec("regexp_extract(x, '^([^=]*)', 1)")
    val = dec("regexp_extract(x, '(?s)^[^=]*=(.*)$', 1)")
    pairs = (f"list_transform(list_filter(string_split({query}, '&'), {keep}), "
             f"lambda x, i: {{'k': {key}, 'p': i, 'v': {val}}})")
    kept = f"list_filter({pairs}, lambda s: s.k NOT IN {in_list(drop)})"
    return f"array_to_string(list_transform(list_sort({kept}), lambda s: {enc('s.k')} || '=' || {enc('s.v')}), '&')"


def unsplit(scheme: str, netloc: str, path: str, query: str) -> str:
    body = (f"CASE WHEN {netloc} <> '' THEN '//' || {netloc} || CASE WHEN starts_with({path}, '/') OR {path} = '' THEN {path} ELSE '/' || {path} END "
            f"WHEN starts_with({path}, '//') THEN '//' || {path} "
            f"WHEN {scheme} <> '' AND {scheme} IN {in_list(USES_NETLOC)} AND ({path} = '' OR starts_with({path}, '/')) THEN '//' || {path} "
            f"ELSE {path} END")
    return (f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || {body} || "
            f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)")


def normalize(src: str, col: str, out: str, p: str) -> str:
    """Add ``out`` = canonical URL of ``col``."""
    s = parts(src, col, p)
    s = stage(s, [(f"{p}_host", host_variations(strip_ports(f"lower({p}_auth)"))),
                  (f"{p}_np0", f"rtrim(lower({p}_path), '/')"),
                  (f"{p}_cq", canonical_query(f"{p}_query", TRACKING_PARAMS, False))])
    s = stage(s, [(f"{p}_np", f"CASE WHEN {p}_np0 = '' THEN '/' ELSE {p}_np0 END")])
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN {unsplit(f'{p}_scheme', f'{p}_host', f'{p}_np', f'{p}_cq')} END")])


def query_pass(src: str, col: str, out: str, p: str) -> str:
    """Add ``out`` = second (dedup) query pass over ``col``."""
    s = parts(src, col, p)
    s = stage(s, [(f"{p}_q2", canonical_query(f"{p}_query", DEDUP_TRACKING_PARAMS, True))])
    base = f"{p}_scheme || '://' || {p}_auth || {p}_path"
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN CASE WHEN {p}_q2 <> '' THEN {base} || '?' || {p}_q2 ELSE {base} END END")])


def domain(src: str, col: str, out: str, p: str) -> str:
    s = parts(src, col, p)
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN {host_variations(f'split_part(lower({p}_auth), {q(':')}, 1)')} END")])


def strip(src: str, col: str, out: str, p: str) -> str:
    s = parts(src, col, p)
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN {p}_scheme || '://' || {strip_ports(f'{p}_auth')} || {p}_path ELSE {col} END")])


def authority(src: str, col: str, out: str, p: str) -> str:
    s = parts(src, col, p)
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN {p}_auth END")])


def hostname(src: str, col: str, out: str, p: str) -> str:
    s = parts(src, col, p)
    s = stage(s, [(f"{p}_hp", f"regexp_extract({p}_auth, '(?s)^(?:.*@)?(.*)$', 1)")])
    s = stage(s, [(f"{p}_hn", f"lower(CASE WHEN starts_with({p}_hp, '[') THEN regexp_extract({p}_hp, '^\\[([^\\]]*)\\]', 1) ELSE split_part({p}_hp, ':', 1) END)")])
    return stage(s, [(out, f"CASE WHEN {p}_ok AND {p}_hn <> '' THEN {p}_hn END")])


def validate(src: str, col: str, out_valid: str, out_reason: str, p: str,
             blocked: Sequence[str] = BLOCKED_DOMAINS, max_length: int = MAX_URL_LENGTH) -> str:
    s = parts(src, col, p)
    s = stage(s, [(f"{p}_hp", f"regexp_extract({p}_auth, '(?s)^(?:.*@)?(.*)$', 1)"),
                  (f"{p}_in", f"regexp_extract({p}_auth, '\\[([^\\]]*)', 1)")])
    s = stage(s, [(f"{p}_rh", f"regexp_replace(CASE WHEN starts_with({p}_hp, '[') THEN regexp_extract({p}_hp, '^(\\[[^\\]]*\\])', 1) ELSE split_part({p}_hp, ':', 1) END, '\\.$', '')")])
    lb, rb = f"contains({p}_auth, '[')", f"contains({p}_auth, ']')"
    inner = f"{p}_in"
    err = (f"CASE WHEN {lb} <> {rb} THEN 'Invalid IPv6 URL' "
           f"WHEN {lb} AND starts_with({inner}, 'v') AND NOT regexp_matches({inner}, '^v[a-fA-F0-9]+\\..+$') THEN 'IPvFuture address is invalid' "
           f"WHEN {lb} AND regexp_matches({inner}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN 'An IPv4 address cannot be in brackets' "
           f"WHEN {lb} AND NOT starts_with({inner}, 'v') AND NOT regexp_matches({inner}, {q(IPV6_SQL)}) "
           f"THEN '''' || {inner} || ''' does not appear to be an IPv4 or IPv6 address' END")
    blk = " OR ".join(f"({p}_rh = {q(d)} OR ends_with({p}_rh, {q('.' + d)}))" for d in blocked) or "FALSE"
    ext = "(" + "|".join(re.escape(e) for e in SKIP_EXTENSIONS) + ")$"
    s = stage(s, [(f"{p}_err", err)])
    reason = (f"CASE WHEN {col} IS NULL THEN {q(R_FORMAT)} "
              f"WHEN {p}_err IS NOT NULL THEN {q(R_ERROR)} || {p}_err "
              f"WHEN {p}_scheme = '' OR {p}_auth = '' THEN {q(R_FORMAT)} "
              f"WHEN {p}_scheme NOT IN ('http', 'https') THEN {q(R_SCHEME)} "
              f"WHEN {blk} THEN {q(R_BLOCKED)} "
              f"WHEN regexp_matches(lower({col}), {q(ext)}) THEN {q(R_EXTENSION)} "
              f"WHEN length({col}) > {max_length} THEN {q(R_LENGTH)} ELSE '' END")
    s = stage(s, [(out_reason, reason)])
    return stage(s, [(out_valid, f"{out_reason} = ''")])


REFERENCE = r"&(#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)"


def decode_entities(x: str) -> str:
    """References cut out, decoded one by one, and put back between the texts around them."""
    point = "CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN chr(CAST(n AS INTEGER)) ELSE chr(65533) END"
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(html5.items()) if k in ORACLE_NAMES) + "}"
    ref = (f"CASE WHEN regexp_matches(r, '^&#[xX]') THEN list_transform([CAST('0x' || regexp_replace(r, '[^0-9A-Fa-f]', '', 'g') AS BIGINT)], "
           f"lambda n: {point})[1] "
           f"WHEN starts_with(r, '&#') THEN list_transform([CAST(regexp_replace(r, '[^0-9]', '', 'g') AS BIGINT)], lambda n: {point})[1] "
           f"ELSE coalesce({names}[r[2:]], r) END")
    refs = f"list_transform(regexp_extract_all({x}, {q(REFERENCE)}), lambda r: {ref})"
    texts = f"string_split_regex({x}, {q(REFERENCE)})"
    return f"array_to_string(list_transform(list_zip({texts}, {refs}), lambda p: p[1] || coalesce(p[2], '')), '')"


def title(x: str) -> str:
    t = f"regexp_extract({x}, '(?is)<title\\b[^>]*>([^<]+)', 1)"
    return f"CASE WHEN {t} <> '' THEN {decode_entities(t)} END"


ATTR_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attr(tag: str, name: str) -> str:
    rx = q(r"(?is)[\s\"'/]" + name + ATTR_VALUE)
    val = f"(regexp_extract({tag}, {rx}, 1) || regexp_extract({tag}, {rx}, 2) || regexp_extract({tag}, {rx}, 3))"
    return f"CASE WHEN regexp_matches({tag}, {rx}) THEN {decode_entities(val)} END"


DESCRIPTION_META_RE = r"""(?is)[\s"'/]name\s*=\s*("description"|'description'|description[\s/>])"""


def description(x: str) -> str:
    metas = f"regexp_extract_all({x}, '(?is)<meta\\b[^>]*>', 0)"
    named = f"list_filter({metas}, lambda m: regexp_matches(m, {q(DESCRIPTION_META_RE)}))"
    return f"CASE WHEN len({named}) > 0 THEN {attr(named + '[1]', 'content')} END"


COMMENT_RE = r"(?s)<!--.*?(-->|$)"
TAG_RE = r"<[A-Za-z/!?][^>]*>?"


def body_text(x: str) -> str:
    inner = f"regexp_extract({x}, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1)"
    inner = f"regexp_replace({inner}, {q(COMMENT_RE)}, '<!>', 'g')"
    inner = f"regexp_replace(regexp_replace({inner}, {q(TAG_RE)}, chr(1), 'g'), '\\x01+', chr(1), 'g')"
    inner = f"regexp_replace(regexp_replace({inner}, '^\\x01', ''), '\\x01$', '')"
    return f"lower({decode_entities(f'replace({inner}, chr(1), {q(chr(32))})')})"


def find_keywords(text: str, keywords: Sequence[str]) -> str:
    if not keywords:
        return "[]::VARCHAR[]"
    arr = "[" + ", ".join(q(k) for k in keywords) + "]"
    return f"list_filter({arr}, lambda k: instr({text}, lower(k)) > 0)"


def hrefs(x: str) -> str:
    h = f"regexp_replace({x}, {q(COMMENT_RE)}, '', 'g')"
    tags = f"regexp_extract_all({h}, '(?is)<(?:a|area)\\s[^>]*>', 0)"
    return f"list_filter(list_transform({tags}, lambda t: trim({attr('t', 'href')})), lambda x: x IS NOT NULL)"


def remove_dot_segments(path: str, squeeze: bool) -> str:
    segs = f"string_split({path}, '/')"
    if squeeze:
        segs = (f"CASE WHEN len({segs}) > 2 THEN [{segs}[1]] || list_filter({segs}[2:len({segs}) - 1], lambda s: s <> '') "
                f"|| [{segs}[len({segs})]] ELSE {segs} END")
    red = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
           f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    red = f"CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END"
    joined = f"CASE WHEN array_to_string({red}, '/') = '' THEN '/' ELSE array_to_string({red}, '/') END"
    return f"CASE WHEN starts_with({joined}, '/') THEN {joined} ELSE '/' || {joined} END"


def tidy_markers(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^([^?#]*)\\?(#|$)', '\\1\\2'), '^([^#]*)#$', '\\1')"


def resolve(src: str, base: str, href: str, out: str, p: str) -> str:
    """Add ``out`` = ``href`` made absolute against ``base`` (same rules as ``resolve_url``)."""
    s = stage(src, [(f"{p}_h", f"trim({href})")])
    s = parts(s, base, p)
    s = stage(s, [(f"{p}_rel", f"CASE WHEN starts_with({p}_h, '//') THEN {p}_h[3:] ELSE {p}_h END"),
                  (f"{p}_hsch", f"lower(regexp_extract({p}_h, {q('^([A-Za-z][A-Za-z0-9+.-]*):')}, 1))")])
    s = stage(s, [(f"{p}_rhead", f"split_part({p}_rel, '#', 1)")])
    s = stage(s, [(f"{p}_rf", f"CASE WHEN contains({p}_rel, '#') THEN {p}_rel[length({p}_rhead) + 2:] ELSE '' END"),
                  (f"{p}_rp", f"split_part({p}_rhead, '?', 1)")])
    s = stage(s, [(f"{p}_rq", f"CASE WHEN contains({p}_rhead, '?') THEN {p}_rhead[length({p}_rp) + 2:] ELSE '' END"),
                  (f"{p}_bdir", f"regexp_extract({p}_path, '(?s)^(.*/)', 1)"),
                  (f"{p}_bpath", f"CASE WHEN {p}_params <> '' THEN {p}_path || ';' || {p}_params ELSE {p}_path END")])
    merged = remove_dot_segments(f"(CASE WHEN {p}_bdir = '' THEN '/' ELSE {p}_bdir END || {p}_rp)", True)
    rooted = remove_dot_segments(f"{p}_rp", False)
    s = stage(s, [(f"{p}_np", f"CASE WHEN {p}_rp = '' THEN {p}_bpath WHEN starts_with({p}_rp, '/') THEN {rooted} ELSE {merged} END"),
                  (f"{p}_nq", f"CASE WHEN {p}_rp = '' AND {p}_rq = '' THEN {p}_query ELSE {p}_rq END")])
    rel_result = (f"{p}_scheme || '://' || {p}_auth || {p}_np || CASE WHEN {p}_nq <> '' THEN '?' || {p}_nq ELSE '' END "
                  f"|| CASE WHEN {p}_rf <> '' THEN '#' || {p}_rf ELSE '' END")
    same = f"(regexp_matches({p}_h, {q('^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')}) AND {p}_hsch = {p}_scheme)"
    expr = (f"CASE WHEN {p}_h IS NULL OR {base} IS NULL THEN NULL "
            f"WHEN regexp_matches({p}_h, {q(SCHEME)}) THEN CASE WHEN {same} THEN "
            f"{p}_hsch || ({tidy_markers(f'{p}_h')})[length({p}_hsch) + 1:] ELSE {p}_h END "
            f"WHEN regexp_matches({p}_h, '^//[^/?#]') THEN {p}_scheme || ':' || {tidy_markers(f'{p}_h')} "
            f"WHEN {p}_h = '' THEN {base} "
            f"ELSE {rel_result} END")
    return stage(s, [(out, expr)])


def scheme_of(src: str, col: str, out: str, p: str) -> str:
    s = parts(src, col, p)
    return stage(s, [(out, f"CASE WHEN {p}_ok THEN {p}_scheme END")])


def links(pages_src: str, unique: bool = True) -> str:
    """``(page_id, src_url, pos, url)`` rows, same rules as ``extract_links``."""
    raw = (f"(SELECT page_id, src_url, unnest(hr) AS href, generate_subscripts(hr, 1) AS hi FROM "
           f"(SELECT page_id, url AS src_url, {hrefs('html')} AS hr FROM {pages_src}))")
    s = resolve(raw, "src_url", "href", "abs_url", "r")
    s = scheme_of(s, "abs_url", "abs_scheme", "sc")
    kept = f"(SELECT page_id, src_url, hi, abs_url FROM {s} WHERE abs_scheme IN {in_list(LINK_SCHEMES)})"
    if unique:
        kept = (f"(SELECT page_id, src_url, hi, abs_url FROM (SELECT *, row_number() OVER "
                f"(PARTITION BY page_id, abs_url ORDER BY hi) AS rn FROM {kept}) WHERE rn = 1)")
    return (f"(SELECT page_id, src_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY hi) - 1 AS INTEGER) AS pos, "
            f"abs_url AS url FROM {kept})")


def raw_host(src: str, col: str, out: str, p: str) -> str:
    """Add ``out`` = host as written (user info, port, trailing dot dropped)."""
    s = parts(src, col, p)
    s = stage(s, [(f"{p}_hp", f"regexp_extract({p}_auth, '(?s)^(?:.*@)?(.*)$', 1)")])
    return stage(s, [(out, f"regexp_replace(CASE WHEN starts_with({p}_hp, '[') THEN regexp_extract({p}_hp, '^(\\[[^\\]]*\\])', 1) ELSE split_part({p}_hp, ':', 1) END, '\\.$', '')")])


def registrable(src: str, col: str, out: str, p: str, suffixes) -> str:
    """Add ``out`` = registrable domain (longest suffix match against ``suffixes``)."""
    s = raw_host(src, col, f"{p}_rh", p)
    # rules with a label beyond ASCII, and their ASCII spelling (fixed values)
    ascii_form = {"рф": "xn--p1ai", "公司.cn": "xn--55qx5d.cn"}
    psl = "(SELECT DISTINCT lower(unnest([" + ", ".join(q(x) for s in suffixes for x in (s, ascii_form.get(s, s))) + "])) AS suffix)"
    hosts = f"(SELECT DISTINCT {p}_rh AS h FROM {s} WHERE {p}_rh IS NOT NULL AND {p}_rh <> '')"
    ends = (f"(SELECT h, i - 1 AS i, array_to_string(string_split(lower(h), '.')[i:], '.') AS e, "
            f"array_to_string(['*'] || string_split(lower(h), '.')[i + 1:], '.') AS w FROM "
            f"(SELECT h, unnest(generate_series(1, len(string_split(h, '.')))) AS i FROM {hosts}))")
    cands = (f"(SELECT h, i, e AS suffix, FALSE AS x FROM {ends} UNION ALL SELECT h, i, w, FALSE FROM {ends} "
             f"UNION ALL SELECT h, i + 1, '!' || e, TRUE FROM {ends})")
    best = f"(SELECT h AS bh, coalesce(min(i) FILTER (WHERE x), min(i)) AS bi FROM {cands} JOIN {psl} USING (suffix) GROUP BY h)"
    lab = "string_split(h, '.')"
    sfx = f"array_to_string({lab}[bi + 1:], '.')"
    reg = (f"CASE WHEN regexp_matches(h, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN h || '.' "
           f"WHEN bi IS NULL THEN {lab}[-1] || '.' WHEN bi = 0 THEN '.' || {sfx} "
           f"ELSE {lab}[bi] || '.' || {sfx} END")
    hmap = f"(SELECT h AS mh, {reg} AS {out} FROM {hosts} LEFT JOIN {best} ON bh = h)"
    return f"(SELECT * FROM {s} LEFT JOIN {hmap} ON mh = {p}_rh)"
