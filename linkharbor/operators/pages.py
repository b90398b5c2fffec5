"""From fetched pages to their document: metadata, link elements, candidates and fetched answers.

The network stands behind a snapshot of fetched resources (url, method, status, headers, final_url, body,
error_kind), so a run is a sequence of joins that can be repeated.  Where an online run asks a page's targets
one after another, all of them (its metadata, a site's own place, predictions, and at most 5 + 10 links) are looked up in
one join and the first success counts: the same result for more requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import filters, html, mime, special_sites, urls
from ..shared import materialize
from . import breakers, learned
from .scale import first_by_key, lookup, lookup_small

_DEFAULT = Config()
CANDIDATES, REMAINING, REDIRECTS_PAGE, REDIRECTS_LINK = 5, 10, 7, 2


def metadata_action(pages: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """``pages`` (page_id, url, html) with ``rights``, ``meta_url`` and ``action``.

    restricted: nothing more is done; fetch: the meta url is to be asked; dynamic and false positive: the page is
    given up; crawl: the links decide.
    """
    m = F.col("meta_url")
    low = F.lower(m)
    same = (m == F.col("url")) | urls.same_but_protocol(F.col("url"), m) | urls.slash_redirect(F.col("url"), m)
    unfit = filters.plain_page(low) | filters.directory(low, config) | filters.unfit_meta_url(low, config)
    if config.download_docs:
        unfit = unfit | filters.unsupported_document(low)
    action = F.when(F.col("no_access").isNotNull(), "restricted")
    if config.documents:
        action = action.when(m.isNull() | same, "crawl").when(filters.dynamic_link(m), "dynamic").when(unfit, "crawl").when(filters.not_a_document(low), "false positive").otherwise("fetch")
    else:
        action = action.otherwise("crawl")
    rows = pages.withColumns({"rights": html.meta_rights(F.col("html")), "meta_url": html.meta_document_url(F.col("html"))})
    return rows.withColumn("no_access", filters.no_access(F.col("rights"))).withColumn("action", action)


def page_links(elements: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Links of pages in order (page_key, page_url, pos, link, structure, decision), and how each page ends.

    The first found, invalid or dynamic element ends its page; links after it are not looked at.
    """
    d = html.element_decisions(elements, config)
    # one site keeps its document in a form of its own, and nowhere else
    own = F.col("page_url").contains("aup-online.com")
    named = F.col("data_title").contains("ownload") & (F.trim("action") != "")
    d = d.withColumns({"decision": F.when(own, F.when(named, "found").otherwise("skip")).otherwise(F.col("decision")), "link": F.when(own, F.trim("action")).otherwise(F.col("link"))})
    # parsed once; a filter before the write would run all patterns twice
    d = materialize(d.select("page_key", "page_url", "pos", "link", "structure", "decision")).filter(F.col("decision") != "skip")
    ends = first_by_key(d.filter(F.col("decision").isin("found", "invalid", "dynamic")), ["page_key"], "pos", ["decision"])
    ends = ends.select("page_key", F.col("pos").alias("end_pos__"))
    j = d.join(ends, "page_key", "left")
    return j.filter(F.col("end_pos__").isNull() | (F.col("pos") <= F.col("end_pos__"))).drop("end_pos__")


def link_outcomes(links: DataFrame) -> DataFrame:
    """(page_key, outcome, n_links): found, invalid link, dynamic links, too many links, or links."""
    g = links.groupBy("page_key").agg(
        F.count(F.when(F.col("decision") == "gather", 1)).alias("n_links"), F.max(F.when(F.col("decision") != "gather", F.col("decision"))).alias("end__")
    )
    outcome = F.when(F.col("n_links") > html.MAX_LINKS, "too many links").when(F.col("end__") == "found", "found").when(F.col("end__") == "invalid", "invalid link")
    return g.select("page_key", outcome.when(F.col("end__") == "dynamic", "dynamic links").otherwise("links").alias("outcome"), "n_links")


def candidates(links: DataFrame, config: Config = _DEFAULT, duplicates: DataFrame | None = None) -> DataFrame:
    """Up to five candidate and ten remaining links per page, absolute, with ``part`` and ``rank``.

    All are acceptable internal links and no duplicates, and remaining ones stay on the page's site.  A sixth candidate ends
    the page, whose remaining links are then not asked.  Pages with more than 500 links are given up, so the ranked groups
    are bounded.
    """
    out = link_outcomes(links).filter(F.col("outcome") == "links").select("page_key")
    g = links.filter(F.col("decision") == "gather").join(out, "page_key", "left_semi")
    full = urls.resolve(F.col("page_url"), F.col("link"))
    g = g.withColumn("target", full).filter("target is not null")
    g = first_by_key(g, ["page_key", "page_url", "target"], "pos", ["structure"])
    low = F.lower("target")
    likely = filters.target_candidate(low, config)
    site = urls.domain(F.col("page_url"))
    fits = filters.accept_internal_link(F.col("target"), config)
    # no filter before the window: it would run all patterns twice
    kept = g.withColumn("part", F.when(likely, F.when(fits, "candidate")).when(filters.same_site(F.col("target"), site), F.when(fits, "remaining")))
    if duplicates is not None:
        kept = lookup_small(kept, duplicates.select(F.col("url").alias("target")).distinct(), ["target"], "left_anti")
    w = Window.partitionBy("page_key").orderBy("pos")
    so_far = lambda part: F.count(F.when(F.col("part") == part, 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(F.when(F.col("part") == "candidate", 1)).over(Window.partitionBy("page_key"))
    r = kept.select("*", F.when(F.col("part") == "candidate", so_far("candidate")).otherwise(so_far("remaining")).alias("rank"), n.alias("n__"))
    late = (F.col("part") == "remaining") & (F.col("rank") <= REMAINING) & (F.col("n__") <= CANDIDATES)
    return r.filter(((F.col("part") == "candidate") & (F.col("rank") <= CANDIDATES)) | late).withColumn("rank", F.col("rank").cast("int")).drop("n__")


def redirect_ends(redirects: DataFrame, most: int = REDIRECTS_PAGE) -> DataFrame:
    """(from_url, final_url, hops): where each redirect ends after at most ``most`` hops; a longer chain has final_url NULL.

    ``redirects`` has one (from_url, to_url) per url.  Chains are composed from chains of 1, 2, 4, ... hops, so seven hops
    take five lookups of the redirects among themselves; a target that a third of them share is split off as hot.
    """
    step = materialize(redirects.select("from_url", F.col("to_url").alias("at"), F.lit(1).alias("hops")))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        more = b.select(F.col("from_url").alias("at"), F.col("at").alias("next__"), F.col("hops").alias("more__"))
        j = lookup(a, more, ["at"])
        return materialize(j.select("from_url", F.coalesce("next__", "at").alias("at"), (F.col("hops") + F.coalesce("more__", F.lit(0))).alias("hops")))

    out, power, left = None, step, most
    while left:
        if left & 1:
            out = power if out is None else then(out, power)
        left >>= 1
        power = then(power, power) if left else power
    open_ = lookup(out, step.select(F.col("from_url").alias("at"), F.lit(True).alias("open__")), ["at"])
    return open_.select("from_url", F.when(F.col("open__").isNull(), F.col("at")).alias("final_url"), "hops")


def follow_redirects(start: DataFrame, redirects: DataFrame, most: int = REDIRECTS_PAGE) -> DataFrame:
    """``start`` (url) with ``final_url`` and ``hops`` after at most ``most`` redirects; a longer chain is NULL."""
    ends = materialize(redirect_ends(redirects, most).select(F.col("from_url").alias("url"), F.col("final_url").alias("end__"), F.col("hops").alias("hops__")))
    hops = F.coalesce("hops__", F.lit(0)).alias("hops")
    return lookup(start, ends, ["url"]).select(*start.columns, F.when(F.col("hops__").isNull(), F.col("url")).otherwise(F.col("end__")).alias("final_url"), hops)


def redirects_of(resources: DataFrame) -> DataFrame:
    """(from_url, to_url) of the answers that lead elsewhere; a redirect into an endless session is none."""
    to = urls.resolve(F.col("url"), header("location"))
    r = resources.filter(F.col("status").isin(301, 302, 303, 307, 308)).select(F.col("url").alias("from_url"), to.alias("to_url"))
    return r.filter(F.col("to_url").isNotNull() & ~filters.shared_site_session(F.col("to_url")))


def header(name: str) -> Column:
    return F.get(F.col("headers")[name], F.lit(0))


def resolved(targets: DataFrame, resources: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Targets (…, target) joined to the snapshot and classified: category document, dataset, page or none.

    Bodies are sniffed only where the type is missing.
    """
    m = header("content-type")
    r = resources.select(
        F.col("url").alias("target"), "status", "error_kind", F.coalesce("final_url", "url").alias("final_url"), m.alias("mime"), header("content-disposition").alias("disposition"),
        header("content-length").try_cast("bigint").alias("length"), F.when(m.isNull(), mime.sniff_body(F.col("body").cast("string"))["kind"]).alias("sniff__"),
    )
    j = lookup(targets, r, ["target"])
    c = mime.classify(F.col("final_url"), F.col("mime"), F.col("disposition"), config)
    ok = (F.col("status") == 200) & F.col("error_kind").isNull()
    sniff = F.col("sniff__")
    category = (
        F.when(~F.coalesce(ok, F.lit(False)), None).when(F.col("c__").isNotNull(), F.col("c__.category")).when(sniff == "pdf", "document").when(sniff == "html", "page")
        .when(filters.content_page_skip(F.col("final_url")), "none").when(filters.page_mime(F.col("mime"), config), "page").otherwise("none")
    )
    return j.withColumn("c__", c).withColumn("category", category).withColumn("mime_type", F.coalesce("c__.mime_type", F.when((F.col("category") == "document") & (sniff == "pdf"), "application/pdf"))).drop("c__", "sniff__")


def page_documents(cands: DataFrame, resources: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """The first successful candidate of each page, candidates before remaining links: (page_key, target, …)."""
    got = resolved(cands, resources, config)
    wanted = [k for k, on in (("document", config.documents), ("dataset", config.datasets)) if on]
    order = F.when(F.col("part") == "candidate", 0).otherwise(REMAINING) + F.col("rank")
    return first_by_key(got.filter(F.col("category").isin(*wanted)).withColumn("order__", order), ["page_key"], "order__", ["page_url", "target", "final_url", "category", "mime_type", "structure"]).drop("order__")


def first_link(elements: DataFrame) -> DataFrame:
    """The first link of an HTTP 300 page, by position."""
    e = elements.withColumn("link", html.href_or_data()).filter("link is not null and link not in ('', '#')")
    return first_by_key(e, ["page_key", "page_url"], "pos", ["link"])


#: Order of a page's targets: what its metadata or site says, a place that led to documents before, a link that names the
#: document, a path that led to documents before, and the ranked links.
META, PLACE, NAMED, PATH, RANKED = range(5)


def crawl(pages: DataFrame, resources: DataFrame, config: Config = _DEFAULT, paths: DataFrame | None = None, places: DataFrame | None = None, redirects: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One outcome row per page (page_id, url, html): (page_key, page_url, outcome, target_url, mime_type, structure).

    ``paths`` (page_path, doc_path, extension) and ``places`` (page_path, structure) are learned models, ``redirects``
    (from_url, to_url), of which a link may take two, and ``duplicates`` (url) that aren't asked again.  Remaining links
    are asked page by page in order of page_id until their success rate drops below the cutoff.  A NULL html has no links.
    """
    u = F.col("url")
    rows = metadata_action(pages, config)
    own = F.coalesce(urls.domain(u), F.lit("")).contains("turkjgastroenterol.org") & F.lit(config.documents)
    place = special_sites.turk_pdf_path(F.col("html"))
    action = F.when(own, F.when(place.isNull(), "no link").otherwise("site")).otherwise(F.col("action"))
    first = F.when(F.col("action__") == "site", urls.resolve(u, F.col("place__"))).when(F.col("action__") == "fetch", F.col("meta_url"))
    rows = rows.withColumns({"action__": action, "place__": F.when(own, place)})
    # a few short columns; the pages themselves are never shuffled, and only those whose links decide are parsed
    meta = materialize(rows.select(F.col("page_id").cast("string").alias("page_key"), u.alias("page_url"), F.col("action__").alias("action"), first.alias("target")))
    elements = html.elements(rows.filter(F.col("action__").isin("crawl", "fetch")).select("page_id", "url", "html"))
    links = page_links(elements, config)
    ends = link_outcomes(links)
    target = lambda df, p, rank=F.lit(0), c="target": df.select("page_key", "page_url", F.col(c).alias("target"), F.lit(p).alias("p"), rank.alias("rank"), (F.col("structure") if "structure" in df.columns else F.lit(None).cast("string")).alias("structure"))
    named = links.filter(F.col("decision") == "found").withColumn("target", urls.resolve(F.col("page_url"), F.col("link")))
    ranked = candidates(links, config, duplicates)
    asked = [target(meta.filter("target is not null"), META), target(named, NAMED), target(ranked, RANKED, F.when(F.col("part") == "candidate", 0).otherwise(CANDIDATES) + F.col("rank"))]
    if places is not None:
        hit = learned.structure_predictions(links.filter("link is not null"), places).join(meta.select("page_key", "page_url"), "page_key")
        asked.append(target(hit.withColumn("target", urls.resolve(F.col("page_url"), F.col("link"))), PLACE))
    if paths is not None:
        full = links.filter("link is not null").select("page_key", "page_url", urls.resolve(F.col("page_url"), F.col("link")).alias("link"))
        made = learned.predicted(full.select("page_url").distinct(), paths, full)
        asked.append(target(made.join(meta.select("page_key", "page_url"), "page_url"), PATH, c="predicted"))
    every = asked[0]
    for x in asked[1:]:
        every = every.unionByName(x)
    if redirects is not None:
        every = follow_redirects(every.withColumnRenamed("target", "url"), redirects, REDIRECTS_LINK).withColumn("target", F.col("final_url")).drop("url", "final_url", "hops").filter("target is not null")
    got = resolved(materialize(every), resources, config)
    wanted = [k for k, on in (("document", config.documents), ("dataset", config.datasets)) if on]
    # a page's metadata names a document, whatever else it has
    good = F.coalesce(F.col("category").isin(*wanted) & ((F.col("p") != META) | (F.col("category") == "document")), F.lit(False))
    tried = materialize(got.select("page_key", "target", "mime_type", "structure", "p", (F.col("p") * 100 + F.col("rank")).alias("order__"), good.alias("hit")))
    tried = tried.join(_after_cutoff(tried, config), ["page_key", "order__"], "left_anti")
    best = first_by_key(tried.filter("hit"), ["page_key"], "order__", ["target", "mime_type", "structure"])
    j = meta.select("page_key", "page_url", "action").join(best, "page_key", "left").join(ends, "page_key", "left")
    outcome = (
        F.when(F.col("action") == "restricted", "restricted").when(F.col("action").isin("dynamic", "false positive"), "meta url unfit").when(F.col("target").isNotNull(), "found")
        .when(F.col("outcome") == "dynamic links", "domain blocked").otherwise("no link")
    )
    found = lambda c, n: F.when(outcome == "found", F.col(c)).alias(n)
    return j.select("page_key", "page_url", outcome.alias("outcome"), found("target", "target_url"), found("mime_type", "mime_type"), found("structure", "structure"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _after_cutoff(tried: DataFrame, config: Config) -> DataFrame:
    """(page_key, order__) of the remaining links that are asked no more: all after the success rate of such links, taken
    page by page up to each page's first success, fell below the cutoff."""
    if not config.remaining_links:
        return tried.filter(F.col("order__") > RANKED * 100 + CANDIDATES).select("page_key", "order__")
    late = F.col("order__") > RANKED * 100 + CANDIDATES
    done = tried.filter("hit").groupBy("page_key").agg(F.min("order__").alias("done__"))
    page = F.coalesce(F.col("page_key").try_cast("bigint"), F.xxhash64("page_key").bitwiseAND((1 << 52) - 1))
    checks = tried.filter(late).join(done, "page_key", "left").filter(F.col("done__").isNull() | (F.col("order__") <= F.col("done__")))
    checks = checks.select("page_key", "order__", "hit", (page * 32 + F.col("order__") - RANKED * 100 - CANDIDATES).alias("seq"))
    return breakers.hit_cutoff(checks).filter(~F.col("goes_on")).select("page_key", "order__")
