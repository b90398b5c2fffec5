"""Crawl and whole run over small snapshots, redirects against a plain loop, and the spread of hot keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkharbor.config import Config
from linkharbor.operators import output, pages, pipeline, scale
from linkharbor.sources.inputs import RESOURCE

PAGE = "page_id long, url string, html string"


def answer(url, status=200, kind="application/pdf", body=None, error=None, **headers):
    h = {k.replace("_", "-"): [v] for k, v in headers.items()}
    return (url, "GET", status, {**({"content-type": [kind]} if kind else {}), **h}, url, body, error)


def crawl(spark, rows, answers, **kw):
    p, r = spark.createDataFrame(rows, PAGE), spark.createDataFrame(answers, RESOURCE)
    return {int(x.page_key): (x.outcome, x.target_url) for x in pages.crawl(p, r, **kw).collect()}


def page(*links):
    return "<html><body>" + "".join(f'<p><a href="{x}">go</a></p>' for x in links) + "</body></html>"


def test_sites_with_a_place_of_their_own(spark):
    rows = [
        (1, "https://www.turkjgastroenterol.org/a", '<div> /content/files/x.pdf </div><meta name="citation_pdf_url" content="https://t.org/m.pdf">'), (2, "https://turkjgastroenterol.org/b", page("/y.pdf")),
        (3, "https://www.aup-online.com/c", '<a href="/wrong/download">pdf</a><form action="/right.pdf" data-title="Download"></form>'), (4, "https://www.aup-online.com/d", page("/z.pdf")), (5, "https://e.org/e", None),
    ]
    files = [answer(f"https://{u}") for u in ("www.turkjgastroenterol.org/content/files/x.pdf", "turkjgastroenterol.org/y.pdf", "www.aup-online.com/wrong/download", "www.aup-online.com/right.pdf", "www.aup-online.com/z.pdf")]
    assert crawl(spark, rows, files) == {1: ("found", "https://www.turkjgastroenterol.org/content/files/x.pdf"), 2: ("no link", None), 3: ("found", "https://www.aup-online.com/right.pdf"), 4: ("no link", None), 5: ("no link", None)}


def test_limits_of_a_page(spark):
    many = [f"/files/{k}.pdf" for k in range(6)]
    rows = [(1, "https://a.org/p", page(*many[:5], "/item/late")), (2, "https://a.org/q", page(*many, "/item/late")), (3, "https://a.org/r", page("/item/moved", "/item/far"))]
    good = [answer("https://a.org/item/late"), answer("https://a.org/two")]
    assert crawl(spark, rows, good) == {1: ("found", "https://a.org/item/late"), 2: ("no link", None), 3: ("no link", None)}
    hops = spark.createDataFrame([("https://a.org/item/moved", "https://a.org/one"), ("https://a.org/one", "https://a.org/two"), ("https://a.org/item/far", "https://a.org/item/moved")], "from_url string, to_url string")
    assert crawl(spark, rows[2:], good, redirects=hops)[3] == ("found", "https://a.org/two")
    assert crawl(spark, rows[2:], good, redirects=hops.filter("from_url <> 'https://a.org/item/moved'"))[3] == ("no link", None)
    assert crawl(spark, rows[:1], good, config=Config(remaining_links=False))[1] == ("no link", None)
    seen = spark.createDataFrame([("https://a.org/item/late",)], "url string")
    assert crawl(spark, rows[:1], good, duplicates=seen)[1] == ("no link", None)


def test_predictions(spark):
    paths = spark.createDataFrame([("https://a.org/item/", "https://a.org/dl/", ".pdf")], "page_path string, doc_path string, extension string")
    rows = [(k, f"https://a.org/item/{k}", page(*[f"/files/{k}_{n}.pdf" for n in range(6)], f"/dl/{k}.pdf")) for k in range(3)]
    assert set(crawl(spark, rows, [answer(f"https://a.org/dl/{k}.pdf") for k in range(3)], paths=paths).values()) == {("found", f"https://a.org/dl/{k}.pdf") for k in range(3)}
    assert set(crawl(spark, rows, [answer(f"https://a.org/dl/{k}.pdf") for k in range(3)]).values()) == {("no link", None)}
    places = spark.createDataFrame([("https://a.org/item/", "a\np\nbody\nhtml\n")], "page_path string, structure string")
    odd = [(7, "https://a.org/item/7", page("/x/7", *[f"/files/{n}.pdf" for n in range(6)]))]
    assert crawl(spark, odd, [answer("https://a.org/x/7")], places=places)[7] == ("found", "https://a.org/x/7")


def test_remaining_links_stop_when_they_fail(spark):
    rows = [(k, f"https://a.org/p{k}", page(f"/item/{k}")) for k in range(1, 60)]
    got = crawl(spark, rows, [answer("https://a.org/item/5"), answer("https://a.org/item/50")])
    assert got[5][0] == "found" and got[50][0] == "found"
    got = crawl(spark, rows, [answer("https://a.org/item/50")])  # none of the first twenty
    assert got[50] == ("no link", None)


def test_redirects_against_a_loop(spark):
    rng = random.Random(4)
    step = {f"u{k}": f"u{rng.choice([k + 1, k + 1, 7, rng.randrange(200)])}" for k in range(200) if rng.random() < 0.8}
    start = [f"u{rng.randrange(210)}" for _ in range(400)] + ["u3"] * 200 + [None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(start)], "seq long, url string")
    r = spark.createDataFrame(list(step.items()), "from_url string, to_url string")
    for most in (1, 2, 7):
        want = {}
        for k, u in enumerate(start):
            at, hops = u, 0
            while at in step and hops < most:
                at, hops = step[at], hops + 1
            want[k] = (None if at in step else at, hops)
        assert {x.seq: (x.final_url, x.hops) for x in pages.follow_redirects(df, r, most).collect()} == want
    assert pages.follow_redirects(df, r.limit(0)).filter("hops > 0").count() == 0


def test_a_hot_key_is_spread(spark):
    """One key holds a third of the rows, and no task of the joined rows has more than twice the mean."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
        right = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
        j = scale.lookup(left, right, ["k"])
        sizes = [r.n for r in j.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 60_000 and max(sizes) <= 2 * 60_000 / 8 and j.filter("k = 'hot' and v = -1").count() == 20_000
        plain = left.join(right, "k", "left").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        assert max(r.n for r in plain.collect()) > 2 * 60_000 / 8
        for how in ("inner", "left_semi", "left_anti"):
            some = right.filter("v % 2 = 1 or v = -1")
            assert scale.lookup(left, some, ["k"], how).count() == left.join(some, "k", how).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_previous_against_a_window(spark):
    from pyspark.sql import Window

    rows = [(k, None if k % 13 == 0 else "hot" if k % 3 else f"d{k % 5}", None if k % 7 == 0 else k * 2) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, key string, v long").withColumn("block", F.floor(F.col("seq") / 50))
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("seq")))
    assert sorted(map(str, scale.previous(df, ["key"], "block", ["seq"], "v", "p").collect())) == sorted(map(str, want.collect()))


def test_a_whole_run(spark):
    pairs = [(1, "a", "https://a.org/doc/1.pdf"), (2, "b", "https://a.org/doc/1.pdf"), (3, "b", "https://a.org/doc/1.pdf"), (4, "c", None), (5, "d", "https://facebook.com/x/y"), (6, "e", "http://b.org/item/5"), (7, "f", "https://c.org/item/lost"), (8, None, "https://a.org/loop/1")]
    answers = [
        answer("https://a.org/doc/1.pdf"), answer("http://b.org/item/5", 301, None, location="https://b.org/item/5"), answer("https://b.org/item/5", 200, None, body=b"<html><a href='/files/5.pdf'>PDF</a></html>"),
        answer("https://b.org/files/5.pdf", 200, None, body=b"%PDF-1.4 x"), *[answer(f"https://a.org/loop/{k}", 302, None, location=f"/loop/{k + 1}") for k in range(1, 10)],
    ]
    p = spark.createDataFrame([(*r, "clash") for r in pairs], "seq long, id string, url string, outcome string")
    out = pipeline.run(p, spark.createDataFrame(answers, RESOURCE))
    rows = {r.seq: r for r in out.collect()}
    assert {k: r.outcome for k, r in rows.items()} == {1: "found", 2: "re-crossed", 3: "duplicate in batch", 4: "no domain", 5: "rejected", 6: "found", 7: "load error", 8: "load error"}
    assert rows[6].target_url == "https://b.org/files/5.pdf" and rows[6].page_url == "https://b.org/item/5" and rows[6].mime_type == "application/pdf" and rows[6].direct == "false"
    assert rows[2].file_path.startswith("This url was already detected by ID=a") and rows[8].error == "too many redirects" and rows[7].error == "no answer" and rows[1].direct == "true"
    assert output.records(out).count() == 8
    assert pipeline.run(p.limit(0), spark.createDataFrame([], RESOURCE)).count() == 0
