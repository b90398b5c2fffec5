"""Vectors for address functions and filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkharbor.config import Config, parse_args
from linkharbor.functions import filters, special_sites, urls

STRICT = Config(strict_reference=True)


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("url", "path", "domain", "doc"),
    [
        ("http://example.com/path/to/page?name=ferret&color=purple", "http://example.com/path/to/", "example.com", "page"),
        ("https://upcommons.upc.edu/bitstream/handle/2117/11500/?sequence=1&isAllowed=y", "https://upcommons.upc.edu/bitstream/handle/2117/11500/", "upcommons.upc.edu", None),
        ("https://hal.science/hal-03190416/file/d0ma00875c.pdf;", "https://hal.science/hal-03190416/file/", "hal.science", "d0ma00875c.pdf"),
        ("httpS://arxiv.org/abs/2009.11995", "httpS://arxiv.org/abs/", "arxiv.org", "2009.11995"), ("https://ww2.x.org:8080/p/q.pdf", "https://ww2.x.org:8080/p/", "x.org", "q.pdf"),
        ("https://a.org/x?redirect=http://b.org/y/z", "https://a.org/x?redirect=http://b.org/y/", "a.org", "z"), ("https:/articles/x.html", None, None, None), ("ftp://ftp.repec.org/opt/x.pdf", None, None, None),
        ("", None, None, None), (None, None, None, None),
    ],
)
def test_parts(spark, url, path, domain, doc):
    assert (one(spark, urls.path, url), one(spark, urls.domain, url), one(spark, urls.doc_id, url)) == (path, domain, doc)


@pytest.mark.parametrize(
    ("f", "args", "want"),
    [
        (urls.top_three_levels, ("a.b.c.d.org",), "c.d.org"), (urls.top_three_levels, ("www.bbk.ac.uk",), "bbk.ac.uk"), (urls.top_three_levels, ("x",), "x"),
        (urls.strip_temporal_id, ("http://x.org/a;jsessionid=AB12?x=1",), "http://x.org/a?x=1"), (urls.strip_temporal_id, ("https://x.org/d?token=1&p=2",), "https://x.org/d?p=2"),
        (urls.strip_temporal_id, ("https://x.org/d?p=2",), "https://x.org/d?p=2"), (urls.strip_anchor, ("http://x.org/a#b",), "http://x.org/a"), (urls.strip_anchor, ("http://x.org/#/a",), "http://x.org/#/a"),
        (urls.repair_ampersands, ("a?x=1&amp;y",), "a?x=1&&y"), (urls.view_to_download, ("a/view/b/view/c",), "a/download/b/view/c"), (urls.extension, ("x.tar.gz",), ".gz"),
        (urls.rewrite_handle, ("http://ir.lib.u-ryukyu.ac.jp/handle/123456789/8743",), "http://ir.lib.u-ryukyu.ac.jp/handle/20.500.12000/8743"), (urls.escape_for_output, ('a\\b"c',), 'a\\\\b\\"c'),
        (urls.https_redirect, ("http://a/b", "https://a/b"), True), (urls.https_redirect, ("https://a/b", "http://a/b"), False), (urls.slash_redirect, ("http://a", "http://a/"), True),
        (urls.same_but_protocol, ("http://a/b", "ftp://a/b"), True), (urls.same_but_protocol, ("a", "a"), False), (urls.normalize, ("HTTP://A.Org:80/x/../%7eb/./c?q=%41#f",), "http://a.org/~b/c?q=A"),
        (urls.normalize, ("https://a.org",), "https://a.org/"), (urls.normalize, ("https://a.org/ä b",), "https://a.org/%C3%A4%20b"), (urls.normalize, ("no url",), None), (urls.normalize, (None,), None),
        (urls.resolve, ("https://a.org/x/y?z", "../p.pdf"), "https://a.org/p.pdf"), (urls.resolve, ("https://a.org/x", "?p=1"), "https://a.org/x?p=1"), (urls.resolve, ("https://a.org/x", None), None),
        (special_sites.rewrite, ("https://europepmc.org/abstract/pmc/123",), special_sites.RENDER + "PMC123&blobtype=pdf"), (special_sites.rewrite, ("https://e.org/x",), "https://e.org/x"),
        (special_sites.turk_pdf_path, ("<div > /content/files/a b.pdf </div>",), "/content/files/a b.pdf"),
    ],
)
def test_functions(spark, f, args, want):
    assert one(spark, f, *args) == want


def test_direct_link(spark):
    t, f = F.lit(True), F.lit(False)
    d = lambda s, p, x, page, special: one(spark, lambda a, b, c: urls.direct_link(a, b, c, page, special), s, p, x)
    assert d("http://a/1", "http://a/2", "https://a/2", t, f) == "true" and d("http://a/1", "http://a/2", "http://a/3", t, f) == "null"
    assert d("http://a/1", "http://a/2", "http://a/2", t, t) == "false" and d("http://a/2", "x", "http://a/2", f, f) == "false"


@pytest.mark.parametrize(
    ("url", "normal", "strict"),
    [
        ("https://x.org/index.php/ethics/article/view/10/download", "directory", "endless redirection"),  # Q1
        ("https://x.org/article/view/123", "larger depth", "pangaea form"), ("https://x.org/a/getsharedsitesession?x", "endless redirection", "larger depth"),
        ("https://doaj.org/toc/123", None, None), ("https://doaj.org/toc/123/", "result page", "result page"),  # Q3
        ("https://mailman.x.org/a", "domain", "domain"), ("https://www.tandfonline.com/doi/1", "script domain", "script domain"), ("https://dlib.org/a", "text in html", "text in html"),  # Q4
        ("https://x.org/item/1.pdf", None, None), ("https://x.org/", "plain domain", "plain domain"), ("https://x.org/a/style.css", "irrelevant extension", "irrelevant extension"),
        ("https://x.org/a/user_manual.pdf", "invalid document", "invalid document"), ("https://x.org/login/a", "directory", "directory"), ("https://x.org/files/user/thesis.pdf", None, None), (None, None, None),
    ],
)
def test_reject_reason(spark, url, normal, strict):
    assert one(spark, filters.reject_reason, url) == normal
    assert one(spark, lambda c: filters.reject_reason(c, STRICT), url) == strict
    if url is not None:
        assert one(spark, filters.accept_page, url) == (normal is None)


def test_modes(spark):
    html = Config(download_html=True)
    assert one(spark, lambda c: filters.reject_reason(c, html), "https://x.org/article/view/123") is None
    assert one(spark, lambda c: filters.reject_reason(c, html), "https://200.17.137.108/a") == "connectivity"  # Q2
    assert one(spark, lambda c: filters.reject_reason(c, Config(download_html=True, strict_reference=True)), "https://200.17.137.108/a") == "text in html"
    assert one(spark, lambda c: filters.reject_reason(c, Config(datasets=False)), "https://x.org/a/bibtext") == "directory"
    assert one(spark, lambda c: filters.reject_reason(c, Config(download_docs=True)), "https://x.org/a.docx") == "unsupported document"


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (filters.document_text, "pdf", True), (filters.document_text, "full text", True), (filters.document_text, "download pdf", False), (filters.dataset_candidate, "https://x/a.grib", True),
        (filters.dataset_candidate, "https://x/a.grib]", False), (filters.link_prefix, "mailto:a", True), (filters.plain_page, "https://x/a.html", True), (filters.plain_page, "https://x/pdf.php", False),
        (filters.page_mime, "text/html", True), (filters.page_mime, "text/plain", False), (filters.page_mime, "text/css", True), (filters.no_access, "info:eu-repo/semantics/restrictedAccess", "restricted"),
        (filters.no_access, "inaccessible", "prohibited"), (filters.no_access, "open", None), (filters.unfit_meta_url, "https://x/a.", False), (filters.dynamic_link, "a{{b", True),
    ],
)
def test_predicates(spark, f, text, want):
    assert one(spark, f, text) == want


def test_strict_variants(spark):
    assert one(spark, lambda c: filters.dataset_candidate(c, STRICT), "https://x/a.grib]") is True  # Q5
    assert one(spark, lambda c: filters.unfit_meta_url(c, STRICT), "https://x/a.") is True  # Q8


def test_arguments():
    c, odd = parse_args(["-retrieveDataType", "document", "-downloadDocFiles", "-firstFileNum", "7", "-numOfThreads"])
    assert (c.documents, c.datasets, c.download_docs, c.first_file_number, c.target_key, odd) == (True, False, True, 7, "docUrl", ["-numOfThreads"])
    assert Config(storage="S3ObjectStore", file_name_type="originalName", download_docs=True).resolved().file_name_type == "idName"
    for bad in (["-firstFileNum"], ["-downloadDocFiles", "-downloadJustHtmlFiles"], ["-retrieveDataType", "x"], ["x"] * 13):
        with pytest.raises(ValueError):
            parse_args(bad)


def test_links_against_every_page(spark, tmp_path):
    from urllib.parse import urljoin

    from linkharbor.plans import registry

    pages = ["https://e.org/a/login?next=/x", "http://E.org:8080/d/detail?collection=1&item=2", "https://e.org/record/1?ln=it#top", "https://e.org", "https://e.org/é/b", "HTTP://e.org/A/B/", "https://e.org/#/detail/5"]
    links = ["/files/x.pdf", "?view=pdf&&n=1", "https://other.example/y.pdf", "//cdn.example/z.pdf"]
    rows = [(4 * i + k, p) for i, p in enumerate(pages) for k in range(4)]
    spark.createDataFrame([*rows, (900, None), (901, "null")], "record_id long, pageurl string").write.parquet(str(tmp_path / "output_record.parquet"))
    got = {r.record_id: r.target for r in registry.queries()["link_resolve_all"](spark, str(tmp_path)).collect()}
    # a link of parameters only is appended
    assert got == {n: p + links[n % 4] if n % 4 == 1 else urljoin(p, links[n % 4]) for n, p in rows}
