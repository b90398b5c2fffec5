"""URL scalar functions as column expressions (no Python in the row path, except normalization and resolution).

Every function takes and gives string columns; NULL gives NULL.
"""

from __future__ import annotations

from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P

# The repository that moved its handles.
_MOVED, _OLD_HANDLE, _NEW_HANDLE = "ir.lib.u-ryukyu.ac.jp", "/123456789/", "/20.500.12000/"

_TRIPLE = "(?i)" + P.full(P.URL_TRIPLE)


def _group(c: Column, pattern: str, k: int) -> Column:
    """Group ``k`` of the first match, NULL if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _match(c: Column) -> Column:
    """The url as it is matched: one trailing slash removed."""
    return F.regexp_replace(c, r"/\z", "")


def is_url(c: Column) -> Column:
    return _match(c).rlike(_TRIPLE)


def domain(c: Column) -> Column:
    """Host without a leading www, in lower case; NULL if the url does not match."""
    return F.lower(_group(_match(c), _TRIPLE, 2))


def path(c: Column) -> Column:
    """Scheme, host and directories up to the last slash."""
    return _group(_match(c), _TRIPLE, 1)


def doc_id(c: Column) -> Column:
    """The last path segment without its parameters."""
    return _group(_match(c), _TRIPLE, 3)


def top_three_levels(d: Column) -> Column:
    """The last three labels of a domain; the domain itself if it has fewer."""
    return F.coalesce(_group(d, P.full(P.TOP_THREE), 1), d)


def has_temporal_id(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("token") | low.contains("jsessionid")


def strip_temporal_id(c: Column) -> Column:
    """Without session or token parameter; what follows it stays, with ``?`` if it is now the first parameter.

    The cheap test for the words guards the regular expression.
    """
    pattern = "(?i)" + P.full(P.TEMPORAL_ID)
    before, after = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    mended = F.when(after.startswith("&") & ~before.contains("?"), F.concat(F.lit("?"), F.substring(after, 2, 1 << 20))).otherwise(after)
    return F.when(has_temporal_id(c) & (before != ""), F.concat(before, mended)).otherwise(c)


def strip_anchor(c: Column) -> Column:
    """Without a trailing ``#anchor``; ``#/`` is a directory and stays."""
    return F.when(c.contains("#"), F.coalesce(_group(c, P.full(P.ANCHOR), 1), c)).otherwise(c)


def repair_ampersands(c: Column) -> Column:
    """``amp;`` becomes ``&`` everywhere; so ``&amp;`` becomes ``&&``, as downstream sites accept."""
    return F.replace(c, F.lit("amp;"), F.lit("&"))


def drop_encoded_ampersands(c: Column) -> Column:
    return F.replace(c, F.lit("amp%3B"), F.lit(""))


def needs_get(c: Column) -> Column:
    return c.contains("amp%3B")


def rewrite_handle(c: Column) -> Column:
    """One repository moved its handles; every other url gets its ampersands repaired."""
    moved = c.contains(_MOVED) & c.contains("/handle" + _OLD_HANDLE)
    return F.when(moved, F.replace(c, F.lit(_OLD_HANDLE), F.lit(_NEW_HANDLE))).otherwise(repair_ampersands(c))


def same_but_protocol(a: Column, b: Column) -> Column:
    x, y = _group(a, P.full(P.PROTOCOL_FREE), 1), _group(b, P.full(P.PROTOCOL_FREE), 1)
    return F.coalesce(x == y, F.lit(False))


def https_redirect(a: Column, b: Column) -> Column:
    return a.startswith("http://") & b.startswith("https://") & same_but_protocol(a, b)


def slash_redirect(a: Column, b: Column) -> Column:
    return ~a.endswith("/") & (b == F.concat(a, F.lit("/")))


def direct_link(source: Column, page: Column, target: Column, for_page: Column, special: Column) -> Column:
    """'true', 'false' or 'null' (not known): did the source lead to the target by itself?"""
    by_page = ~special & ((page == target) | same_but_protocol(page, target))
    by_source = (source == target) | same_but_protocol(source, target)
    return F.when(~for_page, "false").when(by_page | by_source, "true").when(special, "false").otherwise("null")


def upgrade_https(c: Column, known: Column) -> Column:
    return F.when(known & ~c.startswith("https:"), F.regexp_replace(c, r"^([^:]*?)http:", "$1https:")).otherwise(c)


def append_slash(c: Column, known: Column) -> Column:
    return F.when(known & ~c.rlike(P.full(P.SLASH_OR_EXTENSION)), F.concat(c, F.lit("/"))).otherwise(c)


def replace_localhost(c: Column, page_domain: Column) -> Column:
    """The first local host name becomes the page's domain."""
    m = r"^(.*?)://(?:localhost|127.0.0.1)(?::\d+)?(.*)$"
    return F.when(c.rlike(m), F.concat(F.regexp_extract(c, m, 1), F.lit("://"), page_domain, F.regexp_extract(c, m, 2))).otherwise(c)


def view_to_download(c: Column) -> Column:
    """The first ``/view/`` becomes ``/download/``."""
    at = F.instr(c, "/view/")
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit("/download/"), F.substring(c, at + 6, F.length(c)))).otherwise(c)


def extension(c: Column) -> Column:
    return _group(c, P.EXTENSION, 1)


def escape_for_output(c: Column) -> Column:
    """Backslashes and quotes escaped once more, before JSON does."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


# Python in Arrow batches: two operations without a built-in equivalent ------------------------------------

_UNRESERVED = "-._~"
_DEFAULT_PORT = {"http": 80, "https": 443}


def normalize_text(url: str | None) -> str | None:
    """Canonical url, or None if it cannot be one.

    Lower-case scheme and host, no default port, no fragment, dot segments resolved, duplicate percent-encoding
    of unreserved characters undone and unsafe characters encoded, empty path as ``/``.
    """
    if not url or not url.strip():
        return None
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname, u.port
    except ValueError:
        return None
    if u.scheme.lower() not in _DEFAULT_PORT or not host:
        return None
    try:
        host = host.encode("ascii").decode() if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    out: list[str] = []
    parts = u.path.split("/")
    for k, seg in enumerate(parts):
        if seg == "..":
            if len(out) > 1:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        elif seg == ".":
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(seg)
    clean = lambda s, safe: quote(_decode_unreserved(s), safe=safe + "%")
    path_ = clean("/".join(out), "/:@!$&'()*+,;=" + _UNRESERVED) or "/"
    query = "?" + clean(u.query, "/:@!$&'()*+,;=?[]" + _UNRESERVED) if u.query else ""
    where = host if port in (None, _DEFAULT_PORT[u.scheme.lower()]) else f"{host}:{port}"
    user = f"{u.username}{':' + u.password if u.password else ''}@" if u.username else ""
    return f"{u.scheme.lower()}://{user}{where}{path_ if path_.startswith('/') else '/' + path_}{query}"


def _decode_unreserved(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        if s[i] == "%" and i + 2 < len(s) + 0 and len(s) - i >= 3:
            c = unquote(s[i : i + 3])
            if len(c) == 1 and c.isascii() and (c.isalnum() or c in _UNRESERVED):
                out.append(c)
            else:
                out.append(s[i : i + 3].upper())
            i += 3
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def _normalize(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_text, na_action="ignore")


def normalize(c: Column | str) -> Column:
    """Canonical form of each url; NULL where it has none.  Plain addresses are canonical as they are and stay out of Python."""
    c = F.col(c) if isinstance(c, str) else c
    plain = c.rlike(r"\Ahttps?://[a-z0-9.-]+(?:/[A-Za-z0-9/_~-]*(?:\.[A-Za-z0-9/_~-]+)*)?\z") & ~c.contains("/./") & ~c.contains("/../")
    return F.when(plain, F.when(c.rlike(r"\Ahttps?://[^/]+\z"), F.concat(c, F.lit("/"))).otherwise(c)).otherwise(_normalize(F.when(~plain, c)))


def resolve_text(base: str | None, link: str | None) -> str | None:
    if not base or link is None:
        return None
    link = link.replace("amp;", "&")
    if link.startswith("?"):
        return base + link
    try:
        return urljoin(base, link)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve_exact(base: pd.Series, link: pd.Series) -> pd.Series:
    """``resolve`` in Python only."""
    return pd.Series([resolve_text(b, x) for b, x in zip(base, link)], dtype=object)


def resolve(base: Column, link: Column) -> Column:
    """A link made absolute against its page; a link of parameters only is appended to the page's url.

    What ``resolve_simple`` knows stays out of Python."""
    simple = resolve_simple(base, link)
    return F.coalesce(simple, resolve_exact(F.when(simple.isNull(), base), F.when(simple.isNull(), link)))


def resolve_simple(base: Column, link: Column) -> Column:
    """The common cases of ``resolve`` as built-in expressions: parameters, and absolute, rooted and relative links in plain
    characters without dot segments or empty endings; NULL for the rest."""
    x = repair_ampersands(link)
    plain = ~x.rlike(r"(?:^|/)\.\.?(?:[/?#]|$)|[^\x21-\x7e]|[?#;\\]$|[?#][?#]|;|[\[\]]") & (x != "")
    place = F.regexp_replace(base, r"[?#].*$", "")
    on_host = plain & base.rlike(r"^https?://[a-z0-9.:-]+(?:[/?#]|$)")
    in_folder = on_host & ~place.rlike(r"/\.\.?(?:/|$)|;|[^\x21-\x7e]") & ~x.contains(":") & ~x.startswith("#")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(place, r"^(https?://[^/]+(?:/.*)?/)", 1), F.lit("")), F.concat(root, F.lit("/")))
    return (
        F.when(x.startswith("?"), F.concat(base, x)).when(x.rlike("^https?://"), F.when(plain, x)).when(x.startswith("//"), F.when(on_host, F.concat(F.regexp_extract(base, "^(https?:)", 1), x)))
        .when(x.startswith("/"), F.when(on_host, F.concat(root, x))).when(in_folder, F.concat(folder, x))
    )


@F.pandas_udf(StringType())
def _ascii_encode(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else quote(u, safe="%/:=&?~#+!$,;'@()*[]-._"))


def ascii_encode(c: Column) -> Column:
    """Percent-encode characters outside ASCII and blanks before a request; addresses without any stay out of Python."""
    plain = c.rlike(r"\A[A-Za-z0-9%/:=&?~#+!$,;'@()*\[\]._-]*\z")
    return F.when(plain, c).otherwise(_ascii_encode(F.when(~plain, c)))
