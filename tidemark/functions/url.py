"""URL column functions (N1), as regular-expression splits in the JVM.

``parse_url`` is not used: it raises on a space and ``try_parse_url`` turns such
URLs into null, while the canonical form must keep them.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import whitespace_class

# RFC 3986 appendix B split, with the scheme restricted to valid scheme chars.
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Schemes that take a network location when rebuilt without one.
NETLOC_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
    "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh",
    "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)
# Query-parameter prefixes dropped as tracking (case-insensitive).
TRACKING_PREFIX = "^(utm_|fbclid|gclid)"


def _strip(col: Column) -> Column:
    ws = whitespace_class()
    stripped = F.regexp_replace(col, "^" + ws + "+|" + ws + "+$", "")
    return F.regexp_replace(stripped, "[\\t\\r\\n]", "")


def canonical_url(col: Column) -> Column:
    """Lower scheme and host, strip trailing ``/`` (empty path -> ``/``), drop
    tracking and empty query pairs keeping the order of the rest, drop the
    fragment. Null stays null."""
    url = _strip(col)
    scheme = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    netloc = F.lower(F.regexp_extract(url, URL_PARTS, 2))
    path = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(url, URL_PARTS, 4)
    kept = F.array_join(
        F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING_PREFIX),
        ),
        "&",
    )
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, path))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin(*NETLOC_SCHEMES) & path.startswith("/"), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    with_scheme = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    out = F.when(kept != "", F.concat(with_scheme, F.lit("?"), kept)).otherwise(with_scheme)
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(out)


def url_host(col: Column) -> Column:
    """Network location of a URL as ``urlsplit`` reports it (case kept)."""
    return F.regexp_extract(_strip(col), URL_PARTS, 2)


def is_http_url(col: Column) -> Column:
    """null/empty, or scheme http(s) with a non-empty host."""
    scheme = F.lower(F.regexp_extract(_strip(col), URL_PARTS, 1))
    host = F.regexp_extract(_strip(col), URL_PARTS, 2)
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(True)).otherwise(
        scheme.isin("http", "https") & (host != "")
    )
