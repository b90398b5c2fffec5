"""Outcome flags, error texts, retry classification and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from . import patterns as P
from .filters import retry_domain
from .urls import doc_id

_DEFAULT = Config()

# Flags (checked, valid, accessible, direct, retry) and url sentinel of each outcome.  '?' is computed.
OUTCOMES = {
    "rejected": ("true", "null", "false", "false", "false", "unreachable"),
    "no domain": ("true", "false", "false", "false", "false", "unreachable"),
    "blacklisted": ("true", "true", "false", "false", "false", "unreachable"),
    "duplicate": ("true", "null", "null", "null", "true", "duplicate"),
    "duplicate in batch": ("false", "null", "null", "null", "true", "duplicate"),
    "better url": ("false", "null", "null", "null", "true", "unreachable"),
    "found": ("true", "true", "true", "?", "true", "?"),
    "re-crossed": ("true", "true", "true", "?", "true", "?"),
    "unwanted type": ("true", "true", "false", "false", "true", "unreachable"),
    "not a page": ("true", "true", "false", "false", "false", "unreachable"),
    "html unavailable": ("true", "true", "false", "false", "true", "unreachable"),
    "html stored": ("true", "true", "null", "null", "true", "null"),
    "restricted": ("true", "true", "false", "false", "true", "unreachable"),
    "meta url unfit": ("true", "true", "false", "false", "false", "unreachable"),
    "no link": ("true", "true", "false", "false", "false", "unreachable"),
    "domain blocked": ("true", "true", "false", "false", "?", "unreachable"),
    "link timeout": ("true", "true", "false", "false", "true", "unreachable"),
    "load error": ("true", "?", "false", "false", "?", "unreachable"),
}
FLAGS = ("wasUrlChecked", "wasUrlValid", "wasDocumentOrDatasetAccessible", "wasDirectLink", "couldRetry")

# Retry classification, (was valid, could retry, message tail) by case.
RETRY = {
    "invalid": ("false", "false", "the url is invalid and lead to http-client-error."),
    "again": ("true", "true", "the url had a non-fatal http-error."),
    "serious": ("true", "false", "there is a serious unspecified error."),
    "silent": ("true", "false", "there is an unspecified runtime error."),
    "timeout": ("true", "true", "the url had a connection-timeout."),
    "head_unsupported": ("true", "true", "the url does not support HEAD method for checking most of the internal links."),
    "blocked": ("true", "true", "the url had its initial or redirected domain blocked."),
}
# Texts and names that outputs carry.
DOWNLOADED, DETECTED, AND_URL = "This file is probably already downloaded by ID=", "This url was already detected by ID=", " and SourceUrl="
LOST_NAME = "unretrievableDocName.pdf"

# What an outcome of link extraction is called.
LINK_ERRORS = {
    "no links": "no internal links were found", "too many links": "more internal links than are checked", "dynamic links": "its domain gives dynamic links",
    "invalid link": "the document link is not valid", "unavailable link": "the document link is not available", "found": None, "error": "the page could not be read",
}


def outcome(kind: Column, target: Column, direct: Column, valid: Column, retry: Column) -> Column:
    """struct of the flags and the target url text for an outcome kind."""
    def pick(k: int, computed: Column) -> Column:
        out = F
        for name, row in OUTCOMES.items():
            out = out.when(kind == name, computed if row[k] == "?" else F.lit(row[k]))
        return out.otherwise(F.lit(None).cast("string"))

    computed = (F.lit("true"), valid, F.lit("true"), direct, retry, target)
    return F.struct(*[pick(k, computed[k]).alias(n) for k, n in enumerate((*FLAGS, "target_url"))])


def retry_class(kind: Column, message: Column, url: Column, config: Config = _DEFAULT) -> Column:
    """struct(was_valid, could_retry, tail) of an error.

    ``kind`` is runtime, timeout, head_unsupported, blocked or anything else; a valid url of certain publishers may
    always be retried.
    """
    low = F.lower(url)
    server = r".*503 Server Error.*" if config.block_most_5xx else r".*(?<!511) Server Error.*"
    invalid, again = message.rlike(P.full(P.INVALID_STATUS)), message.rlike(P.full(P.RETRY_CLIENT)) | message.rlike(P.full(server))

    def row(case: str) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(RETRY[case], ("was_valid", "could_retry", "tail"))])

    runtime = F.when(message.isNull(), row("silent")).when(invalid, row("invalid")).when(again, row("again")).otherwise(row("serious"))
    r = F.when(kind == "runtime", runtime)
    for case in ("timeout", "head_unsupported", "blocked"):
        r = r.when(kind == case, row(case))
    r = r.otherwise(row("serious"))
    raised = (r["was_valid"] == "true") & F.coalesce(retry_domain(low), F.lit(False))
    return F.struct(r["was_valid"].alias("was_valid"), F.when(raised, "true").otherwise(r["could_retry"]).alias("could_retry"), r["tail"].alias("tail"))


def status_action(url: Column, domain: Column, status: Column, for_page: Column, error_text: Column, retry_after: Column, config: Config = _DEFAULT) -> Column:
    """struct(message, event) of an HTTP error status.

    ``event`` feeds the breakers: http_403, http_5xx, block_now (a status that is no HTTP error), or NULL.  A 500
    of the handle resolver counts as 404.  Error texts longer than 10 000 characters are left out.
    """
    s = F.when((status == 500) & domain.contains("handle.net"), 404).otherwise(status)
    text = F.when(F.length(error_text) <= 10_000, F.nullif(F.trim(error_text), F.lit("")))
    head = F.concat(F.lit('Url: "'), url, F.lit('" seems to be unreachable. Received'))
    with_text = F.coalesce(F.concat(F.lit(" Error-text: "), text), F.lit(""))
    client = F.concat(
        head, F.lit(": HTTP "), s.cast("string"), F.lit(" Client Error."), F.when(for_page & ~s.isin(404, 410), with_text).otherwise(""),
        F.when(s == 429, F.coalesce(F.concat(F.lit(" | Retry-After:"), retry_after), F.lit(""))).otherwise(""),
    )
    server = F.concat(head, F.lit(": HTTP "), s.cast("string"), F.lit(" Server Error."))
    other = F.concat(head, F.lit(" unexpected responseCode: "), s.cast("string"), F.when(for_page, with_text).otherwise(""))
    counted = (s != 503) if config.block_most_5xx else (s == 511)
    message = F.when(s.between(400, 499), client).when(s.between(500, 599), server).otherwise(other)
    event = F.when(s == 403, "http_403").when(s.between(500, 599), F.when(counted, "http_5xx")).when(~s.between(400, 599), "block_now")
    return F.struct(message.alias("message"), event.alias("event"))


# File names ----------------------------------------------------------------------------------------------


def disposition_name(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, P.DISPOSITION_NAME, 1), F.lit(""))


def original_name(disposition: Column, url: Column, folder: str = "", longest: int = 250) -> Column:
    """File name from the disposition, else from the url; NULL if there is none or the path gets too long."""
    name = F.coalesce(disposition_name(disposition), doc_id(url))
    name = F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.when(F.length(name) + len(folder) <= longest, name)


def numbered_name(name: Column, nth: Column) -> Column:
    """``name(k).ext`` for the k-th later file of a name, the name itself for k = 0."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(nth > 0, F.concat(stem, F.lit("("), nth.cast("string"), F.lit(")"), ext)).otherwise(name)


def md5_hex(body: Column) -> Column:
    return F.md5(body)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two digits; NULL for an empty whole."""
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 2)
