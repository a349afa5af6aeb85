"""Harvest settings and the fixed values the results depend on.

Everything here is plain data: thresholds and word lists that must keep the
values below for results to agree with the crawler this toolkit re-expresses.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional, Sequence

from pyspark.sql import Column

# ---------------------------------------------------------------------------
# Fixed values (must stay as they are for matching results)
# ---------------------------------------------------------------------------

# Query parameters dropped by the canonical URL.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign",
    "utm_term", "utm_content", "fbclid",
    "gclid", "ref", "source",
)

# Query parameters dropped by the second (dedup) query pass.
DEDUP_TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "fbclid", "ref")

# Host rewrites, applied in this order, anywhere in the host.
HOST_VARIATIONS = (("www.", ""), (".m.", "."), ("-mobile.", "."))

# File extensions a URL may not end with (validator, case-blind).
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".zip", ".rar", ".tar", ".gz", ".jpg",
    ".jpeg", ".png", ".gif", ".mp4", ".mp3",
)

# Registrable domains the validator rejects.
BLOCKED_DOMAINS = (
    "facebook.com", "twitter.com", "instagram.com",
    "youtube.com", "linkedin.com",
)

# Link deny pattern of the link extractor (case-sensitive, anchored at end).
DENY_PATTERN = r".*\.(pdf|zip|rar|tar|gz|doc|docx|xls|xlsx|jpg|jpeg|png|gif|mp4|mp3)$"

MAX_URL_LENGTH = 2000

# HTTP status sets.
RETRY_HTTP_CODES = (500, 502, 503, 504, 408, 429)
CACHE_IGNORE_HTTP_CODES = (401, 403, 404, 429, 500, 502, 503, 504)
PROXY_BAN_CODES = (403, 429)

# Capacity settings.
MAX_DEPTH = 3
MAX_URLS = 250_000
DEDUP_CACHE_SIZE = 1_000_000
EVICTION_KEEP = 0.75
CONCURRENT_REQUESTS = 32
PER_HOST_REQUESTS = 16
PER_ADDRESS_REQUESTS = 16
DOWNLOAD_DELAY_S = 0.5
RETRY_TIMES = 3
CACHE_TTL_S = 86_400
WRITE_BUFFER = 100

# Default seeds and keywords of the sample configuration.
DEFAULT_SEEDS = ("https://example.com", "https://example.org")
DEFAULT_ALLOWED = ("example.com", "example.org")
DEFAULT_KEYWORDS = ("python", "web crawling", "data mining")

# URL schemes whose last path segment may carry ";params" (stdlib URL parser).
USES_PARAMS = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)
# URL schemes that take "//" before an empty authority when rebuilt.
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)
# Link schemes the link extractor keeps.
LINK_SCHEMES = ("http", "https", "file", "ftp")

# A small public-suffix table in the list's rule syntax ("*." any label, "!" exception); pass the full list as a DataFrame for real use.
DEFAULT_PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io",
    "co", "de", "fr", "es", "it", "nl", "uk", "co.uk", "org.uk", "ac.uk",
    "gov.uk", "jp", "co.jp", "cn", "com.cn", "ru", "br", "com.br", "au",
    "com.au", "in", "co.in", "ca", "us", "eu", "ch", "se", "no", "dk", "fi",
    "pl", "be", "at", "cz", "pt", "gr", "ie", "nz", "co.nz", "mx", "com.mx",
    "ar", "com.ar", "kr", "co.kr", "tw", "com.tw", "hk", "com.hk", "sg",
    "com.sg", "za", "co.za", "tr", "com.tr", "il", "co.il", "me", "tv", "cc",
    "ly", "ai", "app", "dev", "ua", "com.ua", "*.ck", "!www.ck",
    "*.kawasaki.jp", "!city.kawasaki.jp", "рф", "公司.cn",
)
# Characters whose compatibility form (NFKC) holds one of / ? # @ : and which no authority may have (fixed values).
AUTHORITY_CONFUSABLES = "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
# Suffixes that private companies registered; used only on request.
PRIVATE_SUFFIXES = ("blogspot.com", "github.io", "appspot.com")


@dataclass(frozen=True)
class HarvestSpec:
    """What a harvest replay is allowed to do.

    ``allowed_domains=None`` means every domain (the ``*`` wildcard); an empty
    tuple means "derive from the seeds" (their raw authorities); a list, or
    a one-column DataFrame of domains, allows those domains and their
    sub-domains.
    """

    allowed_domains: Optional[Sequence[str]] = ()
    keywords: Sequence[str] = ()
    max_depth: int = MAX_DEPTH
    max_urls: Optional[int] = None  # None: no cap; the sample configuration of a single crawler is MAX_URLS
    deny_pattern: Optional[str] = DENY_PATTERN
    max_url_length: int = MAX_URL_LENGTH
    blocked_domains: Sequence[str] = BLOCKED_DOMAINS
    unique_links: bool = True
    hash_algo: str = "sha256"
    link_filter: Optional[Callable[[Column], Column]] = field(default=None, compare=False)
