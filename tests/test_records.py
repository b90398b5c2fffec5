"""Selection, breakers, mime, outcomes, files, pages, sources and streaming on small fixtures."""

from __future__ import annotations

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from linkharbor.config import Config
from linkharbor.functions import html, mime, outcomes
from linkharbor.operators import breakers, files, learned, output, pages, select, stats
from linkharbor.sources import inputs, sinks
from linkharbor.streaming import breakers as stream

EVENT = "seq long, domain string, path string, kind string"


def test_best_url_order_does_not_matter(spark):
    rows = [(1, "a", "https://x.org/item/1", False), (2, "a", "https://x.org/handle/9/1", False), (3, "a", "https://x.org/handle/9/2", False), (4, "a", "https://doi.org/10.1/x", False)]
    rows += [(5, "b", "https://doi.org/10.1/y", False), (6, "b", "https://x.org/item/2", False), (7, "c", "https://x.org/item/3", False), (8, "c", "https://x.org/a.pdf", False), (9, "c", "https://x.org/b.pdf", True)]
    rows += [(10, "d", "https://x.org/item/4", True), (11, "d", "https://x.org/a.pdf", False), (12, "e", "https://doi.org/10.1/z", None), (13, None, "https://x.org/i", False)]
    want = {"a": (3, "handle"), "b": (6, "other"), "c": (8, "candidate"), "d": (10, "re-crossed"), "e": (12, "doi"), None: (13, "other")}
    for _ in range(2):
        random.Random(4).shuffle(rows)
        df = spark.createDataFrame(rows, "seq long, id string, url string, already_found boolean")
        best = select.best_urls(df)
        assert {r.id: (r.seq, r.choice) for r in best.collect()} == want
        assert {r.seq for r in select.skipped(df, best).collect()} == {1, 2, 4, 5, 7, 9, 11}
    assert select.best_urls(df.limit(0)).count() == 0


def test_acceptance_chain(spark):
    p = spark.createDataFrame([(1, "a", "https://b.org/x/1"), (2, "a", "https://c.org/y/1"), (3, "a", "https://d.org/z?token=1"), (4, "a", "bad"), (5, "a", None), (6, "a", "https://d.org/q/amp;w")], "seq long, id string, url string")
    got = select.checked(p, blacklisted=spark.createDataFrame([("b.org",)], "domain string"), blocked_paths=spark.createDataFrame([("c.org", "https://c.org/y/")], "domain string, path string"), seen=spark.createDataFrame([("https://d.org/z",)], "url string"))
    assert {r.seq: r.reject for r in got.collect()} == {1: "blacklisted", 2: "blocked path", 3: "duplicate", 4: "no domain", 5: "no domain", 6: None}
    assert got.filter("seq = 6").collect()[0].clean_url == "https://d.org/q/&w"


def test_big_groups_stay_rows(spark):
    df = spark.createDataFrame([("a", f"u{k}") for k in range(5)] + [("b", "v")] * 3, "id string, url string")
    assert {r.id: (r.n_urls, r.urls) for r in select.urls_per_id(df, most=3).collect()} == {"a": (5, None), "b": (1, ["v"])}


def reference_blocks(events, thresholds, pt, pn):
    out, state = {}, {}
    for seq, domain, path, kind in sorted(events, key=lambda e: e[0]):
        if domain is None or domain in breakers.NEVER or domain in out:
            continue
        s = state.setdefault(domain, {"good": 0, "bad": {}, "paths": {}, "n": 0})
        if kind == "ok_doc":
            s["good"] += 1
        elif kind == "block_now":
            out[domain] = (kind, seq)
        elif kind in thresholds:
            s["bad"][kind] = s["bad"].get(kind, 0) + 1
            if s["bad"][kind] > thresholds[kind] + s["good"]:
                out[domain] = (kind, seq)
        elif kind == "http_403" and path is not None:
            s["paths"][path] = s["paths"].get(path, 0) + 1
            if s["paths"][path] == pt + 1:
                s["n"] += 1
                if s["n"] == pn + 1:
                    out[domain] = (kind, seq)
    return out


def some_events(n=900):
    r = random.Random(5)
    kinds = ["ok_doc"] * 3 + ["http_403"] * 4 + ["http_5xx", "timeout", "no_type", "no_docs", "no_links", "not_doc_nor_page"] * 2
    return [(k, r.choice([None, "zenodo.org", *["hot.org"] * 4, *[f"d{i}.org" for i in range(12)]]), r.choice([None, "/p1", "/p2", "/p3"]), "block_now" if r.random() < 0.003 else r.choice(kinds)) for k in range(n)]


def test_breakers_batch_equals_stream_and_reference(spark, tmp_path):
    t, ev = {"http_5xx": 3, "timeout": 4, "no_type": 3, "not_doc_nor_page": 3, "no_links": 5, "no_docs": 4}, some_events()
    want = reference_blocks(ev, t, 2, 1)
    df = spark.createDataFrame(ev, EVENT)
    assert {r.domain: (r.kind, r.block_seq) for r in breakers.all_blocks(df, t, 2, 1).collect()} == want
    assert breakers.all_blocks(df.limit(0)).count() == 0
    src = tmp_path / "in"
    for k in range(0, 900, 300):
        spark.createDataFrame(ev[k : k + 300], EVENT).coalesce(1).write.mode("append").parquet(str(src))
    s = stream.blocks(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src)), t, 2, 1)
    q = s.writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.domain: (r.kind, r.block_seq) for r in spark.table("blocks").collect()} == want


def test_cutoff_and_capabilities(spark):
    c = spark.createDataFrame([(k, k < 3) for k in range(60)], "seq long, hit boolean")
    got = breakers.hit_cutoff(c, 20, 10.0).orderBy("seq").collect()
    assert [r.goes_on for r in got] == [True] * 30 + [False] * 30
    seen = spark.createDataFrame([("a.org", 200, "GET", "http://a.org/x", "https://a.org/x", False), ("a.org", 405, "HEAD", "u", "u", False), ("b.org", 406, "GET", "http://b/x", "http://b/x/", True)], "domain string, status int, method string, from_url string, to_url string, version_error boolean")
    k = {r.domain: (r.https, r.slash, r.no_head, r.no_language, r.http_1_1) for r in breakers.capabilities(seen).collect()}
    assert k == {"a.org": (True, False, True, False, False), "b.org": (False, True, False, True, True)}
    r = spark.createDataFrame([("a.org", "http://a.org/y"), ("b.org", "http://b.org/y"), ("b.org", "http://b.org/y.pdf"), (None, "z")], "domain string, url string")
    assert {x.url for x in breakers.upgraded(r, breakers.capabilities(seen)).collect()} == {"https://a.org/y", "http://b.org/y/", "http://b.org/y.pdf", "z"}


@pytest.mark.parametrize(
    ("url", "m", "d", "want"),
    [
        ("u", "application/pdf", None, ("application/pdf", "document")), ("u", "text/csv;charset=x", None, ("text/csv", "dataset")), ("u", "system.io.fileinfo", "attachment; x.pdf", ("application/pdf", "document")),
        ("a.pdf", "system.io.fileinfo", None, ("application/pdf", "document")), ("u", "system.io.fileinfo", "attachment", None), ("xpdf", "charset", None, ("application/pdf", "document")),
        ("u", "unknown", "x.csv", ("unknown", "dataset")), ("u/pdf", "application/octet-stream", "attachment", ("application/pdf", "document")), ("u", "text/html", "f.pdf", ("application/pdf", "document")),
        ("u", "text/html", "f.csv", ("text/html", "dataset")), ("u", None, "f.pdf", ("application/pdf", "document")), ("u", None, "attachment", None), ("u", None, None, None), ("u", "a" * 300 + ";charset=x", None, None),
    ],
)
def test_classify(spark, url, m, d, want):
    r = spark.createDataFrame([(url, m, d)], "u string, m string, d string").select(mime.classify(F.col("u"), F.col("m"), F.col("d")).alias("x")).collect()[0].x
    assert (tuple(r) if r else None) == want


def test_sniff_and_html(spark):
    s = lambda b: spark.createDataFrame([(b,)], "b string").select(mime.sniff_body(F.col("b")).alias("x")).collect()[0].x
    assert s("\n \n<?xml?>\n<!DOCTYPE html>").kind == "html" and s("%PDF-1.4").kind == "pdf" and s("x\nplain").kind == "undefined" and s("") is None and s(None) is None
    h = lambda f, b: spark.createDataFrame([(b,)], "b string").select(f(F.col("b")).alias("x")).collect()[0].x
    assert h(html.html_text, "ab\n\nx\n  \ncd") == "ab cd" and h(html.html_text, "\n") is None
    assert h(html.meta_document_url, '<META content="http://a/b.pdf" name="citation_pdf_url">') == "http://a/b.pdf" == h(html.meta_document_url, '<meta name="citation_pdf_url" content="http://a/b.pdf"/>')
    assert h(html.meta_rights, '<meta name="DC.Rights" content="closed"><meta content="http://x" name="DC.AccessRights"><meta content="b" name="DC.AccessRights">') == "closed -- b -- "
    assert h(html.error_text, "<html><b>No</b> page</html>") == "No page" and h(html.error_text, "x" * 10_001) is None and h(html.meta_rights, "") is None


PAGE = """<html><body><div class="main"><p>one<p>two<ul><li><a href="/a.pdf">The Paper</a><li><a href="/view/b">PDF</a></ul>
<footer><a href="/c.pdf">pdf</a></footer><a data-x="/d.pdf" href="#">Full Text</a><a>none</a><form action="/get/e.pdf"></form><link href="/f" type="application/pdf"><div id="related-product"><a href="/g.pdf">g</a></div></div>"""


def test_elements(spark):
    rows = html.elements_of(PAGE)
    by = {(r[1], r[4] or r[5] or r[6]): r for r in rows}
    assert [r[0] for r in rows] == list(range(8)) and by["a", "/view/b"][12][0]["tag"] == "li" and by["a", "/view/b"][12][1]["tag"] == "ul"
    assert by["a", "/a.pdf"][13] == "a\nli\nul\ndiv_main\nbody\nhtml\n"
    e = html.elements(spark.createDataFrame([(1, "https://e.org/p", PAGE), (2, "https://e.org/q", None)], "page_id long, url string, html string"))
    d = {r.pos: (r.decision, r.link) for r in html.element_decisions(e).collect()}
    assert d == {0: ("gather", "/a.pdf"), 1: ("found", "/download/b"), 2: ("skip", None), 3: ("found", "/d.pdf"), 4: ("skip", None), 5: ("found", "/get/e.pdf"), 6: ("found", "/f"), 7: ("skip", None)}


def test_many_links_discard_the_page(spark):
    page = "".join(f'<a href="/i/{k}.pdf">x{k}</a>' for k in range(501))
    p = spark.createDataFrame([(1, "https://e.org/p", page), (2, "https://e.org/q", page[:200])], "page_id long, url string, html string")
    links = pages.page_links(html.elements(p))
    assert {r.page_key: r.outcome for r in pages.link_outcomes(links).collect()} == {"1": "too many links", "2": "links"}
    c = pages.candidates(links).collect()
    assert {r.page_key for r in c} == {"2"} and max(r["rank"] for r in c) <= 5


def test_retry_status_and_outcomes(spark):
    def retry(kind, msg, url="https://x.org/a", **k):
        r = spark.createDataFrame([(kind, msg, url)], "k string, m string, u string").select(outcomes.retry_class(F.col("k"), F.col("m"), F.col("u"), Config(**k)).alias("x")).collect()[0].x
        return r.was_valid, r.could_retry

    assert retry("runtime", "HTTP 404 Client Error") == ("false", "false") and retry("runtime", "x HTTP 403 Client Error.") == ("true", "true") and retry("runtime", "HTTP 503 Server Error.") == ("true", "true")
    assert retry("runtime", "HTTP 500 Server Error.") == ("true", "false") and retry("runtime", "HTTP 500 Server Error.", block_most_5xx=False) == ("true", "true")
    assert retry("runtime", None) == ("true", "false") and retry("timeout", None) == ("true", "true") and retry(None, None) == ("true", "false") and retry("x", None, "https://a.elsevier.com/b") == ("true", "true")
    n = spark.createDataFrame([("a.b.pdf", 0), ("a.b.pdf", 2), ("noext", 1)], "n string, k long").select(outcomes.numbered_name(F.col("n"), F.col("k")).alias("x"))
    assert [r.x for r in n.collect()] == ["a.b.pdf", "a.b(2).pdf", "noext(1)"]


def test_files_plan(spark):
    rows = [(1, "i", "u/1", None, 3, b"abc"), (2, "i", "u/2", None, 3, b"abd"), (3, "j", "u/3", 'x; filename="n.pdf"', 3, b"abc"), (4, "j", "u/4", None, 0, b"z"), (5, None, "u/5", None, None, b""), (6, "k", "u/6", None, None, b"q")]
    df = spark.createDataFrame(rows, "seq long, id string, url string, disposition string, length long, body binary")
    got = {r.seq: r.final_name for r in files.plan_downloads(df).collect()}
    assert got == {1: "i.pdf", 2: "i(1).pdf", 3: None, 6: "k.pdf"}
    num = {r.seq: r.final_name for r in files.plan_downloads(df, Config(file_name_type="numberName", first_file_number=5)).collect()}
    assert num == {1: "5.pdf", 2: "6.pdf", 3: None, 6: "7.pdf"}


def test_store_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.pdf", b"abc"), (2, None, b"x"), (3, "b.pdf", None)], "seq long, final_name string, body binary")
    got = sinks.store_files(df, sinks.folder_put(str(tmp_path / "out"))).collect()
    assert [(r.seq, r.stored) for r in got] == [(1, True)] and (tmp_path / "out/a.pdf").read_bytes() == b"abc"
    assert [(r.file_hash, r.file_size) for r in sinks.hash_stored(spark, str(tmp_path / "out")).collect()] == [("900150983cd24fb0d6963f7d28e17f72", 3)]
    rec = spark.createDataFrame([(None, 's"\\', None, "http://t?token=1", "found", None, "true", "true", None, 5, None, None, None)], "id string, source_url string, page_url string, target_url string, outcome string, direct string, valid string, retry string, file_hash string, file_size long, mime_type string, file_path string, error string")
    sinks.write_json_lines(output.records(rec), str(tmp_path / "js"))
    back = inputs.text_lines(spark, str(tmp_path / "js")).collect()[0].line
    assert back.startswith('{"id":"unretrievable","sourceUrl":"s\\\\\\"\\\\\\\\","pageUrl":"null","docOrDatasetUrl":"http://t","wasUrlChecked":"true"') and '"fileSize":"5"' in back
    u = tmp_path / "u.txt"
    u.write_text("﻿url\n\"http://a\"\n\nhttp://b\n")
    assert [r.url for r in inputs.read_urls(spark, str(u), True).collect()] == ["http://a", "http://b"]
    j = tmp_path / "j.json"
    j.write_text('{"id":1,"url":"u"}\n{"id":"x"}\n\n{"id":"y","url":""}\n{"id":null,"url":"v"}\nno\n')
    assert sorted((r.id or "", r.url or "", r.status) for r in inputs.read_json_pairs(spark, str(j)).collect()) == [("", "", "bad"), ("", "", "bad"), ("", "", "empty"), ("1", "u", "ok"), ("null", "v", "ok"), ("y", "", "unreachable")]


def test_logs_and_mimes(spark, tmp_path):
    import zipfile

    (tmp_path / "a.log").write_text("2024-01-01 00:00:00.000 INFO x\n2024-01-01 00:00:31.500 ERROR y The maximum limit (\nno time\n2024-01-01 00:00:32.000 WARN The maximum limit (1)\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.log", "2024-01-01 00:00:00.000 INFO x\n")
    logs = inputs.read_logs(spark, str(tmp_path))
    assert {r.file_name: (r.n_lines, r.n_errors, r.n_watched) for r in stats.log_counts(logs).collect()} == {"a.log": (4, 1, 1), "b.zip": (1, 0, 0)}
    assert [(r.line_no, r.gap_ms) for r in stats.log_gaps(logs).collect()] == [(2, 31_500)]
    m = spark.createDataFrame([("text/csv",), ("application/x-sas-data  // file",), ("application/xml (schema)    // note",), ("",)], "line string")
    assert {r.mimetype for r in inputs.mime_lines(m).collect()} == {"text/csv", "application/x-sas-data", "application/xml (schema)"}
    with pytest.raises(ValueError):
        inputs.s3_conf("a,b")
    assert inputs.s3_conf("http://s,a,b,r,bk")["bucket"] == "bk"


def test_decode_and_fetch(spark):
    assert inputs.decode(gzip.compress(b"a"), "gzip") == b"a" == inputs.decode(zlib.compress(b"a"), "Deflate") and inputs.decode(b"x", None) == b"x" and inputs.decode(b"x", "odd") is None and inputs.decode(b"x", "gzip") is None

    def opener(url, method, timeout):
        if "bad" in url:
            raise TimeoutError
        return 200, {"Content-Type": ["text/html"]}, url, b"<html>"

    r = spark.createDataFrame([("http://a.org/1", "GET", "a.org"), ("http://a.org/bad", "GET", "a.org")], "url string, method string, domain string")
    assert sorted((x.url, x.status, x.error_kind) for x in inputs.fetch(r, opener).collect()) == [("http://a.org/1", 200, None), ("http://a.org/bad", None, "timeout")]


def test_snapshot_source(spark, tmp_path):
    from urllib.parse import quote

    (tmp_path / (quote("https://e.org/p", safe="") + ".html")).write_text("<p>x")
    spark.dataSource.register(inputs.SnapshotSource)
    assert [tuple(r) for r in spark.read.format("page_snapshot").option("path", str(tmp_path)).load().collect()] == [("https://e.org/p", "<p>x")]


def test_learned_paths(spark):
    found = [(k, f"https://a.org/item/{k}", f"https://a.org/dl/{k}.pdf") for k in range(3)] + [(9, "https://a.org/item/9", "https://a.org/item/9")]
    found += [(20 + k, f"https://b.org/x/{k}", f"https://b.org/d{k}/{k}.pdf") for k in range(6)]
    f = spark.createDataFrame(found, "seq long, page_url string, target_url string")
    m = learned.learned_paths(f)
    assert [tuple(r) for r in m.collect()] == [("https://a.org/item/", "https://a.org/dl/", ".pdf")]
    links = spark.createDataFrame([("https://a.org/item/77", "https://a.org/dl/77.pdf"), ("https://a.org/item/78", "https://a.org/other")], "page_url string, link string")
    assert [tuple(r) for r in learned.predicted(links.select("page_url"), m, links).collect()] == [("https://a.org/item/77", "https://a.org/dl/77.pdf")]


def test_all_urls_of_an_id(spark):
    rows = [("hot", f"u{k:05}") for k in range(12_000)] + [(None, "n"), ("empty", None), ("b", "v"), ("b", "v")]
    df = spark.createDataFrame(rows, "id string, url string")
    got = {r.id: (r.n_urls, r.urls) for r in select.urls_per_id(df).collect()}
    assert got == {"hot": (12_000, [f"u{k:05}" for k in range(12_000)]), None: (1, ["n"]), "empty": (0, []), "b": (1, ["v"])}
    assert {r.id: r.urls for r in select.urls_per_id(df, most=3).collect()}[None] == ["n"]


def test_names_of_all_files(spark, tmp_path):
    from linkharbor.plans import registry

    names = ["a.h5", "a.h5", "b.bin?x=1", "c", "c", "A.H5", "d.tar.zip", "d.tar.zip", "p.pdf", "p.pdf", ""] + ["hot"] * 20
    spark.createDataFrame([(k, f"https://e.org/{n}") for k, n in enumerate(names)] + [(99, "unreachable")], "record_id long, docordataseturl string").write.parquet(str(tmp_path / "output_record.parquet"))
    want, met = {}, {}
    for k, n in enumerate(names):
        n = n.lower().split("?")[0]
        c = met[n] = met.get(n, -1) + 1
        stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
        want[k] = f"{stem}({c}){dot}{ext}" if c else n
    got = {r.seq: r.final_name for r in registry.queries()["file_dup_suffix_all"](spark, str(tmp_path)).collect()}
    assert got == want
