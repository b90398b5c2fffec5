"""Mime types: cleaning, classification, body sniffing, and the download rules that depend on size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from . import patterns as P
from .filters import dataset_candidate

_DEFAULT = Config()
# Fixed value: a site that names the type of its files only in answers to GET.
_GET_ONLY = "meetingorganizer.copernicus.org"


def document_mimes(config: Config = _DEFAULT) -> tuple[str, ...]:
    """Pdf types always; others only if nothing is downloaded."""
    return P.PDF_MIMES if config.download_docs else P.PDF_MIMES + P.OTHER_DOCUMENT_MIMES


def mime_dimension(spark: SparkSession, config: Config = _DEFAULT) -> DataFrame:
    """(mimetype, category) of the known types, a fixed small table."""
    rows = [(m, "document") for m in document_mimes(config)] + [(m, "dataset") for m in P.DATASET_MIMES]
    return spark.createDataFrame(rows, "mimetype string, category string")


def plain_mime(c: Column) -> Column:
    """The bare type without charset, name or parentheses; NULL if longer than 255 or not a type."""
    return F.when(F.length(c) <= 255, F.nullif(F.regexp_extract(c, P.PLAIN_MIME, 1), F.lit("")))


def _result(mime: Column | str, category: str) -> Column:
    m = F.lit(mime) if isinstance(mime, str) else mime
    return F.struct(m.alias("mime_type"), F.lit(category).alias("category"))


def classify(url: Column, mime: Column, disposition: Column, config: Config = _DEFAULT) -> Column:
    """struct(mime_type, category) or NULL: what a response with this type and disposition is.

    ``mime`` and ``disposition`` are taken in lower case.  Rules in order: file info objects, types with
    parameters that cannot be cleaned, known documents, known datasets, octet streams by disposition or url, any
    other type by disposition (where a dataset name overrides), and no type at all by disposition.
    """
    mime, disp, low = F.lower(mime), F.lower(disposition), F.lower(url)
    no = F.lit(None).cast("struct<mime_type:string,category:string>")
    pdf, on = _result("application/pdf", "document"), F.lit(True)
    docs, sets = F.lit(config.documents), F.lit(config.datasets)
    bare_disp = F.regexp_replace(disp, "[\"']", "")
    dressed = mime.contains("charset") | mime.contains("name") | mime.startswith("(")
    plain = F.regexp_replace(F.when(dressed, plain_mime(mime)).otherwise(mime), "[\"']", "")
    named = disp.isNotNull() & (disp != "attachment")
    set_url, set_disp = dataset_candidate(low, config), dataset_candidate(bare_disp, config)

    info = F.when(F.when(disp.isNotNull(), named & disp.contains(".pdf")).otherwise(low.contains(".pdf")), pdf)
    unclean = F.when(low.contains("pdf"), pdf).when(set_url, _result("unspecified", "dataset"))
    is_set = plain.isin(*P.DATASET_MIMES) | plain.rlike(P.full(P.dataset_mime(config.strict_reference)))
    octet = (
        F.when(named, F.when(docs & disp.contains(".pdf"), pdf).when(sets & set_disp, _result(plain, "dataset")))
        .when(docs & low.contains("pdf"), pdf).when(sets & set_url, _result(plain, "dataset"))
    )
    other = F.when(sets & F.coalesce(set_disp, F.lit(False)), _result(plain, "dataset")).when(docs & disp.contains(".pdf"), pdf)
    typed = (
        F.when(mime.contains("system.io.fileinfo"), info).when(dressed & plain.isNull(), unclean).when(docs & plain.isin(*document_mimes(config)), _result(plain, "document"))
        .when(sets & is_set, _result(plain, "dataset")).when(plain.rlike(P.full(P.OCTET_STREAM)), octet).otherwise(other)
    )
    untyped = F.when(named, F.when(docs & disp.contains(".pdf"), pdf).when(sets & set_disp, _result("unspecified", "dataset")))
    return F.when(on & mime.isNotNull(), F.coalesce(typed, no)).otherwise(F.coalesce(untyped, no))


def sniff_body(body: Column) -> Column:
    """struct(kind, first_line): 'html', 'pdf' or 'undefined' from the first telling line; NULL without one.

    Skipped are empty and one-character lines, blank lines, and lines of an xml header or comment.
    """
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda x: (F.length(x) > 1) & ~x.rlike(P.full(P.BODY_SKIP)))
    first = F.get(lines, F.lit(0))
    low = F.lower(first)
    kind = F.when(low.rlike(P.HTML_START), "html").when(low.startswith("%pdf-"), "pdf").otherwise("undefined")
    return F.when(first.isNotNull(), F.struct(kind.alias("kind"), F.when(kind != "pdf", first).alias("first_line")))


def download_budget_ms(size: Column) -> Column:
    """Time allowed for a download, by megabytes; -2 or NULL (unknown) as for small ones."""
    mb = 1_048_576
    s = F.coalesce(size, F.lit(-2))
    return F.when(s <= 50 * mb, 45_000).when(s <= 100 * mb, 70_000).when(s <= 200 * mb, 140_000).when(s <= 300 * mb, 210_000).otherwise(330_000)


def request_method(for_page: Column, possible_target: Column, weird: Column, head_unsupported: Column, domain: Column, config: Config = _DEFAULT) -> Column:
    """GET where content is wanted or HEAD is useless, else HEAD."""
    get = (for_page & ~possible_target) | (possible_target & F.lit(config.download_docs)) | weird | head_unsupported | domain.contains(_GET_ONLY)
    return F.when(get, "GET").otherwise("HEAD")
