"""The whole run over a snapshot: from (id, url) pairs to one outcome per pair, as rows for ``output.records``.

Pairs are accepted or not, one url per id is chosen, rewritten and upgraded by what the domains taught, followed over its
redirects and classified; pages are crawled; breakers silence domains; targets found before point to their first
finder.  Each step is a join or an aggregation over all pairs, so a run is a plan and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import html, mime, outcomes, special_sites, urls
from ..shared import materialize
from . import breakers, learned, output, pages, select
from .scale import lookup, lookup_small

_DEFAULT = Config()
_COLUMNS = ("seq", "id", "source_url", "page_url", "target_url", "outcome", "direct", "valid", "retry", "file_hash", "file_size", "mime_type", "file_path", "error")


def _rows(df: DataFrame, **given: Column) -> DataFrame:
    """Outcome rows; columns not given are NULL."""
    size = F.lit(None).cast("bigint")
    return df.select(*[(given[c] if c in given else size if c == "file_size" else F.lit(None).cast("string")).alias(c) for c in _COLUMNS])


def learned_capabilities(resources: DataFrame) -> DataFrame:
    """What the answers of a snapshot taught about their domains."""
    u = F.col("url")
    return breakers.capabilities(resources.select(
        urls.domain(u).alias("domain"), "status", "method", u.alias("from_url"), F.when(F.col("status").between(300, 399), urls.resolve(u, pages.header("location"))).otherwise(F.col("final_url")).alias("to_url"),
        F.coalesce(F.col("error_kind") == "version", F.lit(False)).alias("version_error"),
    ))


def requests(chosen: DataFrame, known: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Chosen urls (seq, id, url) as they are asked: ``asked``, ``special``, ``dead``, ``domain`` and ``method``."""
    u = F.col("url")
    made = special_sites.rewrite(u, config)
    rows = chosen.select("seq", "id", F.col("url").alias("source_url"), made.alias("url"), (made != u).alias("special"), special_sites.is_known_dead(u).alias("dead"))
    rows = breakers.upgraded(materialize(rows.withColumn("domain", urls.domain(F.col("url")))), known)
    rows = lookup_small(rows, known.select("domain", "no_head"), ["domain"])
    method = mime.request_method(F.lit(True), pages.filters.target_candidate(F.lower("url"), config), urls.needs_get(F.col("url")), F.coalesce("no_head", F.lit(False)), F.coalesce("domain", F.lit("")), config)
    return rows.withColumn("method", method).withColumnRenamed("url", "asked").drop("no_head")


def run(pairs: DataFrame, resources: DataFrame, config: Config = _DEFAULT, blacklisted: DataFrame | None = None, blocked_paths: DataFrame | None = None, model: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """One outcome row per pair (seq, id, url): the columns of ``output.records`` and ``seq``.

    ``resources`` is the snapshot, one row per url.  ``blacklisted`` (domain) and ``blocked_paths`` (domain, path) come from
    earlier runs, ``model`` and ``places`` too.  Order is ``seq``, which is unique.  A pair with a NULL url has no domain; a
    url that the snapshot lacks is a load error; an empty table gives no rows.
    """
    first = materialize(select.duplicates_flagged(pairs.select("seq", "id", "url")))
    again = first.filter("is_duplicate")
    checked = materialize(select.checked(first.filter(~F.col("is_duplicate")).drop("is_duplicate"), config, blacklisted, blocked_paths))
    accepted = checked.filter("reject is null").select("seq", "id", F.col("clean_url").alias("url"), F.lit(False).alias("already_found"))
    chosen = materialize(select.best_urls(accepted, config))
    why = F.col("reject")
    kind = F.when(why == "no domain", "no domain").when(why.isin("blacklisted", "blocked path"), "blacklisted").when(why == "duplicate", "duplicate").otherwise("rejected")
    out = _rows(again, seq=F.col("seq"), id=F.col("id"), source_url=F.col("url"), outcome=F.lit("duplicate in batch"))
    out = out.unionByName(_rows(checked.filter(why.isNotNull()), seq=F.col("seq"), id=F.col("id"), source_url=F.col("url"), outcome=kind, error=why))
    rest = select.skipped(accepted, chosen)
    out = out.unionByName(_rows(rest, seq=F.col("seq"), id=F.col("id"), source_url=F.col("url"), outcome=F.col("outcome")))

    asked = requests(chosen, materialize(learned_capabilities(resources)), config)
    redirects = materialize(pages.redirects_of(resources))
    followed = materialize(pages.follow_redirects(asked.withColumnRenamed("asked", "url"), redirects, pages.REDIRECTS_PAGE))
    got = materialize(pages.resolved(followed.drop("hops").withColumnRenamed("final_url", "target"), resources, config).withColumn("final_url", F.coalesce("final_url", "target")))

    to_crawl = got.filter(F.col("category") == "page").select("seq", "final_url").distinct()
    # the pages' texts are looked up by the few columns a page needs
    texts = resources.filter("status = 200").select(F.col("url").alias("final_url"), F.col("body").cast("string").alias("html"))
    visits = lookup(to_crawl, texts, ["final_url"]).select(F.col("seq").alias("page_id"), F.col("final_url").alias("url"), "html")
    crawled = materialize(pages.crawl(visits, resources, config, model, places, redirects))
    j = got.join(crawled.select(F.col("page_key").cast("bigint").alias("seq"), F.col("outcome").alias("page_outcome"), "target_url", F.col("mime_type").alias("page_mime"), "n_links"), "seq", "left")

    wanted = [k for k, on in (("document", config.documents), ("dataset", config.datasets)) if on]
    status = outcomes.status_action(F.col("final_url"), F.coalesce("domain", F.lit("")), F.col("status"), F.lit(True), F.lit(None).cast("string"), F.lit(None).cast("string"), config)
    failed = F.col("category").isNull()
    error = F.when(F.col("dead"), "the url is known to lead nowhere").when(F.col("target").isNull(), "too many redirects").when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(failed & F.col("status").isNotNull(), F.col("st__.message")).when(failed, "no answer")
    said = F.when(failed & F.col("error_kind").isNull() & F.col("status").isNotNull(), F.col("st__.message")).otherwise("no HTTP answer")
    group = F.when(F.coalesce(F.col("error_kind") == "timeout", F.lit(False)), "timeout").otherwise("runtime")
    kind = (
        F.when(F.col("dead") | F.col("target").isNull() | failed, "load error").when(F.col("category").isin(*wanted), "found").when(F.col("category") == "page", F.col("page_outcome"))
        .when(F.col("category").isin("document", "dataset"), "unwanted type").otherwise("not a page")
    )
    r = j.withColumn("st__", F.when(failed & F.col("status").isNotNull(), status)).withColumns({"outcome": kind, "error": F.when(kind == "load error", error), "r__": outcomes.retry_class(group, said, F.col("source_url"), config)})
    event = (
        F.when(F.col("outcome") == "found", "ok_doc").when(F.col("outcome") == "load error", F.when(group == "timeout", "timeout").otherwise(F.col("st__.event")))
        .when(F.col("outcome") == "not a page", "not_doc_nor_page").when(F.col("outcome") == "domain blocked", "block_now").when(F.col("outcome") == "no link", F.when(F.col("n_links") == 0, "no_links").otherwise("no_docs"))
    )
    r = materialize(r.withColumn("event", event).withColumn("page", F.coalesce("final_url", "url")))
    # breakers: what came after a domain's block was never asked
    events = r.filter("event is not null").select("seq", "domain", urls.path(F.col("page")).alias("path"), F.col("event").alias("kind"))
    blocks = materialize(breakers.all_blocks(events).select("domain", "block_seq"))
    paths = materialize(breakers.blocked_paths(events).select("domain", "path", F.col("block_seq").alias("path_seq")))
    r = lookup_small(r, blocks, ["domain"])
    r = lookup_small(r.withColumn("path", urls.path(F.col("page"))), paths, ["domain", "path"])
    silent = F.coalesce((F.col("seq") > F.col("block_seq")) | (F.col("seq") > F.col("path_seq")), F.lit(False))
    blocked = outcomes.retry_class(F.lit("blocked"), F.lit(None).cast("string"), F.col("source_url"), config)
    r = r.withColumn("silent", silent).withColumn("b__", blocked)
    outcome = F.when(F.col("silent"), "load error").otherwise(F.col("outcome"))
    target = F.when(F.col("category") == "page", F.col("target_url")).otherwise(F.col("final_url"))
    direct = urls.direct_link(F.col("source_url"), F.col("page"), F.col("t__"), F.col("category") != "page", F.col("special"))
    r = r.withColumns({"o__": outcome, "t__": F.when(outcome == "found", target)})
    rows = _rows(
        r, seq=F.col("seq"), id=F.col("id"), source_url=F.col("source_url"), page_url=F.when(F.col("silent"), None).otherwise(F.col("page")), target_url=F.col("t__"), outcome=F.col("o__"), direct=direct,
        valid=F.when(F.col("silent"), F.col("b__.was_valid")).otherwise(F.col("r__.was_valid")), retry=F.when(F.col("silent"), F.col("b__.could_retry")).otherwise(F.col("r__.could_retry")),
        mime_type=F.when(F.col("o__") == "found", F.when(F.col("category") == "page", F.col("page_mime")).otherwise(F.col("mime_type"))), error=F.when(F.col("silent"), "the domain is blocked").otherwise(F.col("error")),
    )
    rows = materialize(rows)
    # targets that another id found first
    found = rows.filter("outcome = 'found'").drop("outcome", "file_path").withColumnRenamed("target_url", "url")
    crossed = output.recrossed(found, config=config)
    crossed = crossed.withColumnRenamed("url", "target_url").withColumn("file_path", F.coalesce("file_path", F.lit("document")))
    return out.unionByName(rows.filter("outcome <> 'found'")).unionByName(crossed.select(*_COLUMNS))


def learn(records: DataFrame) -> DataFrame:
    """The path model of a run's found rows, for the next one."""
    return learned.learned_paths(records.filter("outcome = 'found'").select("seq", "page_url", "target_url"))


def texts_of_errors(resources: DataFrame) -> DataFrame:
    """(url, error_text) of error pages."""
    return resources.filter("status >= 400").select("url", html.error_text(F.col("body").cast("string")).alias("error_text"))
