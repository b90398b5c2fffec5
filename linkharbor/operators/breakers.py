"""Circuit breakers in batch form: from when on is a domain (or path) no longer asked?

Events have (seq, domain, path, kind) with kind in ok_doc, http_403, http_5xx, timeout, no_type, not_doc_nor_page,
no_links, no_docs, block_now.  A domain is blocked at the first event where its bad count exceeds the threshold
plus its good hits so far.  Counts run in blocks (see ``scale.running``), so a domain with a third of all events
is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import running

# Thresholds per kind, and domains that are never blocked.
THRESHOLDS = {"http_5xx": 10, "timeout": 25, "no_type": 10, "not_doc_nor_page": 10, "no_links": 200, "no_docs": 100}
PATH_403, PATHS_403 = 10, 50
NEVER = ("zenodo.org", "doi.org", "dx.doi.org")
PREDICTION_FAILURES = 10


def counters(events: DataFrame, kind: str, buffered: bool = True) -> DataFrame:
    """Events of a kind and good hits with ``bad`` and ``good`` counts so far, per domain."""
    rows = events.filter(F.col("kind").isin(kind, "ok_doc") & F.col("domain").isNotNull())
    return running(rows, ["domain"], "seq", {"bad": (F.col("kind") == kind).cast("int"), "good": (F.col("kind") == "ok_doc").cast("int") if buffered else F.lit(0)})


def blocked(events: DataFrame, kind: str, threshold: int | None = None, buffered: bool = True) -> DataFrame:
    """(domain, kind, block_seq, bad, good) where a breaker opened, at its first event."""
    n = THRESHOLDS[kind] if threshold is None else threshold
    c = counters(events, kind, buffered).filter((F.col("bad") > F.lit(n) + F.col("good")) & (F.col("kind") == kind) & ~F.col("domain").isin(*NEVER))
    return c.groupBy("domain").agg(F.min(F.struct("seq", "bad", "good")).alias("x")).select("domain", F.lit(kind).alias("kind"), F.col("x.seq").alias("block_seq"), "x.bad", "x.good")


def blocked_paths(events: DataFrame, threshold: int = PATH_403) -> DataFrame:
    """(domain, path, block_seq) of paths with more than ``threshold`` 403 answers; no good buffer."""
    rows = events.filter((F.col("kind") == "http_403") & F.col("domain").isNotNull() & F.col("path").isNotNull())
    c = running(rows, ["domain", "path"], "seq", {"bad": F.lit(1)}).filter(F.col("bad") == threshold + 1)
    return c.select("domain", "path", F.col("seq").alias("block_seq"))


def blocked_by_paths(events: DataFrame, path_threshold: int = PATH_403, paths: int = PATHS_403) -> DataFrame:
    """(domain, kind, block_seq) of domains with more than ``paths`` blocked paths."""
    p = blocked_paths(events, path_threshold).withColumnRenamed("block_seq", "seq")
    c = running(p, ["domain"], "seq", {"n": F.lit(1)}).filter((F.col("n") == paths + 1) & ~F.col("domain").isin(*NEVER))
    return c.select("domain", F.lit("http_403").alias("kind"), F.col("seq").alias("block_seq"))


def blocked_now(events: DataFrame) -> DataFrame:
    """Domains blocked at once: unknown host, security error, dynamic links, endless redirects, odd status."""
    now = events.filter((F.col("kind") == "block_now") & F.col("domain").isNotNull() & ~F.col("domain").isin(*NEVER))
    return now.groupBy("domain").agg(F.min("seq").alias("block_seq")).select("domain", F.lit("block_now").alias("kind"), "block_seq")


def all_blocks(events: DataFrame, thresholds: dict[str, int] | None = None, path_threshold: int = PATH_403, paths: int = PATHS_403) -> DataFrame:
    """(domain, kind, block_seq): the first breaker that opened for each domain, all kinds together.

    Ties go to the kind that sorts first.  A blocked domain produces no later events, so breakers do not influence
    each other before the first one opens and each can be computed by itself.
    """
    t = thresholds or THRESHOLDS
    kind = F.col("kind")
    rows = events.filter(kind.isin(*t, "ok_doc", "block_now") & F.col("domain").isNotNull() & ~F.col("domain").isin(*NEVER)).select("seq", "domain", "kind")
    c = running(rows, ["domain"], "seq", {k: (kind == k).cast("int") for k in (*t, "ok_doc")})  # all counters in one pass
    opens = kind == "block_now"
    for k, n in t.items():
        opens = opens | ((kind == k) & (F.col(k) > F.col("ok_doc") + n))
    out = c.filter(opens).select("domain", F.col("seq").alias("block_seq"), "kind").unionByName(blocked_by_paths(events, path_threshold, paths))
    return out.groupBy("domain").agg(F.min(F.struct("block_seq", "kind")).alias("x")).select("domain", "x.kind", "x.block_seq")


def after_block(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events with ``suppressed``: they come after their domain's block.  Blocks are at most one row per domain."""
    from .scale import lookup

    return lookup(events, blocks.select("domain", "block_seq"), ["domain"]).withColumn("suppressed", F.coalesce(F.col("seq") > F.col("block_seq"), F.lit(False))).drop("block_seq")


def capabilities(seen: DataFrame) -> DataFrame:
    """Per domain what its answers taught: https and slash redirects, no HEAD, no Accept-Language, HTTP/1.1 only.

    ``seen`` has (domain, status, method, from_url, to_url, version_error).
    """
    from ..functions import urls

    a, b = F.col("from_url"), F.col("to_url")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return seen.filter("domain is not null").groupBy("domain").agg(
        some(urls.https_redirect(a, b)).alias("https"), some(urls.slash_redirect(a, b)).alias("slash"),
        some(F.col("status").isin(405, 501) & (F.col("method") == "HEAD")).alias("no_head"), some(F.col("status") == 406).alias("no_language"),
        some(F.col("version_error")).alias("http_1_1"),
    )


def upgraded(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (…, domain, url) changed offline by what is known of their domain."""
    from ..functions import urls
    from .scale import lookup

    rows = lookup(requests, known.select("domain", "https", "slash"), ["domain"])
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("url", urls.append_slash(urls.upgrade_https(F.col("url"), no("https")), no("slash"))).drop("https", "slash")


def hit_cutoff(checks: DataFrame, at_least: int = 20, percent: float = 0.20) -> DataFrame:
    """``checks`` (seq, hit) with running ``n_checked``, ``n_hits`` and ``goes_on``.

    From the 20th check on, looking goes on while the hits are at least 0.2 percent (Q7) of the checks so far and
    it was never stopped before.
    """
    c = running(checks.withColumn("all__", F.lit(1)), ["all__"], "seq", {"n_checked": F.lit(1), "n_hits": F.col("hit").cast("int")})
    bad = (F.col("n_checked") >= at_least) & (F.col("n_hits") * 100.0 / F.col("n_checked") < percent)
    stop = c.agg(F.min(F.when(bad, F.col("seq"))).alias("s")).scalar()
    return c.drop("all__").withColumn("goes_on", F.coalesce(F.col("seq") < stop, F.lit(True)))


def model_phase(n: Column, rate: Column, total: int) -> Column:
    """Phase of the path model after ``n`` pages: learn, run while it succeeds in half of the cases, or sleep.

    Sizes follow the input: 5000 pages to learn, checked every 1000, asleep for 30 000, scaled down to a tenth, a
    fiftieth and three fifths for smaller inputs.
    """
    learn, run, sleep = (5000, 1000, 30_000) if total >= 50_000 else (max(1, total // 10), max(1, total // 50), max(1, total * 3 // 5))
    inside = (n - learn) % (run + sleep)
    return F.when(n <= learn, "learn").when(inside <= run, "run").when(rate >= 51.0, "run").otherwise("sleep")


def path_predictions_blocked(outcomes: DataFrame) -> DataFrame:
    """Domains whose path predictions failed more than ten times; no good buffer.  ``outcomes``: (seq, domain, hit)."""
    rows = outcomes.select("seq", "domain", F.lit(None).cast("string").alias("path"), F.when(F.col("hit"), "ok_doc").otherwise("prediction").alias("kind"))
    return blocked(rows, "prediction", PREDICTION_FAILURES, buffered=False)
