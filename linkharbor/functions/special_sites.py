"""Rewrites of addresses of sites whose landing pages need no visit: an ordered choice, first match wins.

Each rule gives NULL for other sites.  The rules stay Column expressions, so all of them are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from ..shared import let
from .urls import doc_id

# Addresses of the sites.
RENDER = "http://europepmc.org/backend/ptpmcrender.fcgi?accid="
NASA = "https://ntrs.nasa.gov/"
IJCSE = "https://www.ijcseonline.org/pub_paper/"
STAMP = "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber="
WILEY = "https://onlinelibrary.wiley.com/doi/pdfdirect/"


def _first(c: Column, old: str, new: str) -> Column:
    """Replace the first occurrence."""
    return F.regexp_replace(c, rf"(?s)\A(.*?)\Q{old}\E", "$1" + new)


def _all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def europepmc(c: Column) -> Column:
    i = doc_id(c)
    made = F.concat(F.lit(RENDER), F.when(i.startswith("PMC"), i).otherwise(F.concat(F.lit("PMC"), i)), F.lit("&blobtype=pdf"))
    return F.when(F.lower(c).rlike(r"\Ahttps?://europepmc.org/a(?:rticle|bstract)s?/pmc.*\z"), F.coalesce(made, c))


def manuscript_http(c: Column) -> Column:
    return F.when(c.contains("manuscript.elsevier.com"), _first(c, "https", "http"))


def nasa(c: Column) -> Column:
    rest = F.regexp_replace(F.concat(_first(c, NASA, ""), F.lit("/")), r"//\z", "/")
    made = F.concat(F.lit(NASA + "api/"), rest, F.lit("downloads/"), doc_id(c), F.lit(".pdf"))
    return F.when(c.contains("ntrs.nasa.gov/citations") & ~c.contains("api/"), F.coalesce(made, c))


def frontiersin(c: Column) -> Column:
    made = F.when(c.endswith("/pdf") | doc_id(c).isNull(), c).when(c.endswith("/full"), _all(c, "/full", "/pdf")).otherwise(F.concat(c, F.lit("/pdf")))
    return F.when(c.contains("www.frontiersin.org"), made)


def is_known_dead(c: Column) -> Column:
    """Addresses of a site that never lead to a document; the caller reports an error instead of asking."""
    return c.contains("www.frontiersin.org") & ~c.endswith("/pdf") & ~c.contains("/article")


def psyarxiv(c: Column) -> Column:
    made = F.when(c.contains("/download"), c).when(c.endswith("/"), F.concat(c, F.lit("download"))).otherwise(F.concat(c, F.lit("/download")))
    return F.when(c.contains("psyarxiv.com"), made)


def ijcseonline(c: Column) -> Column:
    name = F.nullif(F.regexp_extract(c, r"\A.+/[^/]+&(.+)\z", 1), F.lit(""))
    return F.when(c.contains("www.ijcseonline.org"), F.when(c.contains("pdf_paper_view.php"), F.coalesce(F.concat(F.lit(IJCSE), name), c)).otherwise(c))


def ieee(c: Column) -> Column:
    return F.when(c.contains("ieeexplore.ieee.org"), F.when(c.contains("/stampPDF/"), c).otherwise(F.coalesce(F.concat(F.lit(STAMP), doc_id(c)), c)))


def osf(c: Column) -> Column:
    made = F.when(c.contains("/download"), c).when(c.endswith("/"), F.concat(c, F.lit("download"))).otherwise(F.concat(c, F.lit("/download")))
    return F.when(c.contains("://osf.io"), made)


def _wiley_pdf(u: Column) -> Column:
    """A page address of the library, without its journal, made the address of the pdf."""
    short = F.when(u.endswith("/abstract"), _all(u, "/abstract", "")).when(u.endswith("/fullpdf"), _all(u, "/fullpdf", "")).otherwise(u)
    return let(short, lambda s: (
        F.when(s.contains("epdf/"), _first(s, "epdf/", "pdfdirect/")).when(s.contains("pdf/"), _first(s, "pdf/", "pdfdirect/"))
        .when(s.contains("full/"), _first(s, "full/", "pdfdirect/")).when(s.contains("abs/"), _first(s, "/doi/abs/", "/doi/pdfdirect/"))
        .when(s.contains("full-xml/"), _first(s, "/full-xml/", "/full/")).otherwise(_first(s, "/doi/", "/doi/pdfdirect/"))
    ))


def wiley(c: Column) -> Column:
    pattern = r"\Ahttp[s]?://[^/]*onlinelibrary.wiley.com/([^/]+/)?doi/.*\z"
    bare = let(F.regexp_extract(c, pattern, 1), lambda j: F.when(j != "", F.replace(c, j, F.lit(""))).otherwise(c))
    final = let(bare, lambda u: F.when(u.contains("/pdfdirect/"), u).otherwise(_wiley_pdf(u)))
    done = let(final, lambda f: F.when(f.contains("download=true"), f).otherwise(F.concat(f, F.when(f.contains("?"), "&").otherwise("?"), F.lit("download=true"))))
    api = F.when(c.contains("api.wiley.com/onlinelibrary"), F.concat(F.lit(WILEY), doc_id(c), F.lit("?download=true")))
    return F.when(c.contains("onlinelibrary.wiley.com/") & c.rlike(pattern), done).otherwise(api)


def embopress(c: Column) -> Column:
    """Defined, but not part of the choice."""
    return F.when(c.contains("://www.embopress.org"), F.when(c.contains("/pdf/"), c).otherwise(_first(c, "/pdfdirect/", "/pdf/")))


def scielo(c: Column) -> Column:
    return F.when(c.contains("scielo.br"), _all(c, "amp;", "&"))


def doi_inner_link(c: Column) -> Column:
    inner = F.nullif(F.regexp_extract(c, r"\Ahttp[s]?://(?:dx.)?doi.org/(http.*)\z", 1), F.lit(""))
    return _all(inner, ":/", "://")


def dergipark(c: Column) -> Column:
    return _all(c, "dergipark.gov.tr", "dergipark.org.tr")


def rewrite(c: Column, config: Config = Config()) -> Column:
    """The address to ask instead; the address itself for ordinary sites."""
    bypass = not config.download_html
    rules = [manuscript_http] if not bypass else [europepmc, manuscript_http, nasa, frontiersin, psyarxiv, ijcseonline, ieee, osf, wiley]
    return F.coalesce(*[r(c) for r in [*rules, scielo, doi_inner_link, dergipark]])


def turk_pdf_path(html: Column) -> Column:
    """The pdf path that a page of one journal keeps in a plain ``div``."""
    return F.nullif(F.regexp_extract(html, r"<div[\s]*>[\s]*(/content/files/[^<>]+.pdf)[\s]*</div>", 1), F.lit(""))


def aup_action(elements: Column) -> Column:
    """The form action of the first element whose data title offers a download; NULL: unavailable."""
    hit = F.filter(elements, lambda e: e["data_title"].contains("ownload") & (F.trim(e["action"]) != ""))
    return F.trim(F.get(hit, F.lit(0))["action"])
