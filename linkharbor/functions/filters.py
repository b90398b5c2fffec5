"""Predicates on addresses, link texts and document structure.

Matching is of whole strings in Java regular expressions inside whole-stage plans; look-behind rules out Python
here.  All ``*_url`` predicates expect lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from ..shared import let
from . import patterns as P

_DEFAULT = Config()


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(P.full(pattern))


def directory(low: Column, config: Config = _DEFAULT) -> Column:
    return _is(low, P.directory(config))


def specific_domain(low: Column, config: Config = _DEFAULT) -> Column:
    return _is(low, P.specific_domain(config))


def plain_domain(low: Column) -> Column:
    return _is(low, P.PLAIN_DOMAIN)


def irrelevant_extension(low: Column) -> Column:
    return _is(low, P.irrelevant_extension())


def unsupported_document(low: Column) -> Column:
    return _is(low, P.unsupported_document())


def link_keywords(low: Column) -> Column:
    return _is(low, P.LINK_WORDS)


def plain_page(low: Column) -> Column:
    return _is(low, P.plain_page())


def file_format(low: Column, config: Config = _DEFAULT) -> Column:
    return _is(low, P.file_format(config))


def document_candidate(low: Column) -> Column:
    return _is(low, P.document_url())


def dataset_candidate(low: Column, config: Config = _DEFAULT) -> Column:
    return _is(low, P.dataset_url(config.strict_reference))


def target_candidate(low: Column, config: Config = _DEFAULT) -> Column:
    """Candidate of an enabled kind."""
    out = F.lit(False)
    if config.documents:
        out = out | document_candidate(low)
    if config.datasets:
        out = out | dataset_candidate(low, config)
    return out


def not_a_document(low: Column) -> Column:
    return _is(low, P.not_a_document())


def document_text(low: Column) -> Column:
    """The whole text of a link names a document: "pdf", but not "download pdf" (Q6)."""
    return _is(low, P.DOCUMENT_TEXT)


def link_prefix(low: Column) -> Column:
    return _is(low, P.LINK_STARTS)


def dynamic_link(c: Column) -> Column:
    return c.contains("{{") | c.contains("<?")


def unfit_meta_url(low: Column, config: Config = _DEFAULT) -> Column:
    return _is(low, P.unfit_meta_url(config))


def page_mime(mime: Column, config: Config = _DEFAULT) -> Column:
    """Mime types that are treated as pages, up to 255 characters (Q12 holds)."""
    return (F.length(mime) <= 255) & _is(mime, P.page_mime(config.strict_reference))


def no_access(rights: Column) -> Column:
    """The reason why rights forbid access, ``prohibited`` if unnamed, NULL if they don't."""
    low = F.lower(rights)
    return F.when(low.rlike(P.full(P.NO_ACCESS)), F.coalesce(F.nullif(F.regexp_extract(low, P.full(P.NO_ACCESS), 1), F.lit("")), F.lit("prohibited")))


def content_page_skip(c: Column) -> Column:
    return c.contains("viewcontent.cgi")


def content_size(length: Column, full_text: Column, config: Config = _DEFAULT) -> Column:
    """The accepted size, -2 if the server names none, -1 if it is not acceptable."""
    most = F.when(full_text, config.max_document_bytes).otherwise(config.max_html_bytes)
    return F.when(length.isNull(), F.lit(-2)).when((length <= 0) | (length > most), F.lit(-1)).otherwise(length).cast("bigint")


def shared_site_session(c: Column) -> Column:
    return F.lower(c).contains("sharedsitesession")


def same_site(link: Column, page_domain: Column) -> Column:
    return link.contains(page_domain)


def retry_domain(low: Column) -> Column:
    return _is(low, P.RETRY_DOMAINS)


def cross_domain_state(cls: Column, link: Column, page_url: Column) -> Column:
    from .urls import domain

    d = domain(link)
    return (F.trim(cls) == "state-published") & link.startswith("http") & d.isNotNull() & ~page_url.contains(d)


def bad_ancestors(ancestors: Column) -> Column:
    """Any ancestor is a header or footer, or has a class or id of navigation and the like.

    ``ancestors`` is an array of structs (tag, cls, id), the parent first.
    """
    def bad(a: Column) -> Column:
        cls, id_ = F.lower(F.trim(a["cls"])), F.lower(a["id"])
        return F.trim(a["tag"]).isin("footer", "header") | ((cls != "") & _is(cls, P.ancestor_class())) | ((id_ != "") & _is(id_, P.ancestor_id()))

    return F.exists(ancestors, bad)


# Reasons -------------------------------------------------------------------------------------------------


def _group_hit(low: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(low, P.full(pattern), k) != ""


def reject_reason(c: Column, config: Config = _DEFAULT) -> Column:
    """Why a page address is not accepted; NULL if it is.  First match wins.

    Q1: a literal reading shifts the three named directory groups by one; Q2: a literal reading keeps the
    group numbers of the domain rules although html-only mode drops groups.  Both only with ``strict_reference``.
    """
    return let(F.lower(c), lambda low: _reason(low, config))


def _reason(low: Column, config: Config) -> Column:
    d, s = P.directory(config), P.specific_domain(config)
    html, strict = config.download_html, config.strict_reference
    by_dir = F.when(_group_hit(low, d, 1), "endless redirection")
    if not html:
        by_dir = by_dir.when(_group_hit(low, d, 2), "larger depth").when(_group_hit(low, d, 3), "pangaea form")
    by_dir = by_dir.otherwise("directory")
    reasons = ["script domain", "result page"] + ([] if html else ["text in html", "no documents", "login", "larger depth"]) + ["connectivity"]
    if html and strict:
        reasons[2] = "text in html"
    by_domain = F
    for k, r in enumerate(reasons, 1):
        by_domain = by_domain.when(_group_hit(low, s, k), r)
    by_domain = by_domain.otherwise("domain")
    out = (
        F.when(_is(low, d), by_dir).when(_is(low, s), by_domain).when(not_a_document(low), "invalid document")
        .when(plain_domain(low), "plain domain").when(irrelevant_extension(low), "irrelevant extension")
    )
    return out.when(unsupported_document(low), "unsupported document") if config.download_docs else out


def _rejected(low: Column, config: Config) -> Column:
    bad = directory(low, config) | specific_domain(low, config) | not_a_document(low) | plain_domain(low) | irrelevant_extension(low)
    return bad | unsupported_document(low) if config.download_docs else bad


def accept_page(c: Column, config: Config = _DEFAULT) -> Column:
    """True if the address is accepted as a page: the same rules as ``reject_reason`` without naming one."""
    return let(F.lower(c), lambda low: ~_rejected(low, config))


def accept_internal_link(c: Column, config: Config = _DEFAULT) -> Column:
    return let(F.lower(c), lambda low: ~(_rejected(low, config) | link_keywords(low) | file_format(low, config) | plain_page(low)))
