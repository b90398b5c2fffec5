"""From (id, url) pairs to the one url per id that is followed, and rows for all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import filters, urls
from ..shared import materialize
from .scale import first_by_key, lookup, lookup_small

_DEFAULT = Config()


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("id", "url").distinct()


def urls_per_id(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, n_urls, urls): distinct urls of each id, sorted; NULL is an id, but no url.

    All urls of an id are one array, so an id's urls must fit into a task; ``distinct_pairs`` has them as rows.  With
    ``most``, an id with more urls has NULL instead and its urls are not gathered.
    """
    d = distinct_pairs(pairs)
    lists = F.array_sort(F.collect_list("url")).alias("urls")
    n = F.count("url").alias("n_urls")
    if most is None:
        return d.groupBy("id").agg(n, lists)
    n = d.groupBy("id").agg(n)
    a, b = d.alias("a"), n.filter(F.col("n_urls") <= most).select("id").alias("b")
    small = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi").groupBy("id").agg(lists).alias("s")
    return n.alias("n").join(small, F.col("n.id").eqNullSafe(F.col("s.id")), "left").select("n.id", "n_urls", "urls")


def duplicates_flagged(pairs: DataFrame, batch: Column | None = None) -> DataFrame:
    """``pairs`` (seq, id, url) with ``is_duplicate``: a pair met before, within a batch if one is given.

    Flags come from a join on the unique ``seq``, so a pair delivered a million times is no hot key.
    """
    rows = pairs if batch is None else pairs.withColumn("batch__", batch)
    keys = ["id", "url"] + ([] if batch is None else ["batch__"])
    firsts = rows.groupBy(*keys).agg(F.min("seq").alias("seq")).select("seq", F.lit(False).alias("is_duplicate"))
    return pairs.join(firsts, "seq", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(True)))


def batch_number(n: Column, size: int = 3000) -> Column:
    """Batch of the n-th row, from 1."""
    return (F.floor((n - 1) / size) + 1).cast("bigint")


def progress_percent(batch: Column, total_rows: Column, size: int = 3000) -> Column:
    return F.round(F.least(batch * size, total_rows) * 100.0 / total_rows, 2)


def checked(pairs: DataFrame, config: Config = _DEFAULT, blacklisted: DataFrame | None = None, blocked_paths: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Input acceptance in order: domain, blacklist, blocked path, address form, token removal, duplicate, rewrites.

    Adds ``domain``, ``clean_url`` and ``reject`` (NULL if accepted).  ``blacklisted`` (domain), ``blocked_paths``
    (domain, path) and ``seen`` (url) hold distinct rows.  All of this depends on the url alone, so it is decided once per
    distinct url and looked up by the rows.  A NULL url has no domain.
    """
    u = F.col("url")
    rows = pairs.select("url").filter(u.isNotNull()).distinct().select("url", urls.domain(u).alias("domain"), urls.path(u).alias("path__"), urls.strip_temporal_id(u).alias("bare__"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sides = (("black__", ["domain"], blacklisted), ("path__on", ["domain", "path__"], blocked_paths and blocked_paths.select("domain", F.col("path").alias("path__"))), ("dup__", ["bare__"], seen and seen.select(u.alias("bare__"))))
    for name, keys, side in sides:
        rows = lookup_small(rows, side.withColumn(name, F.lit(True)), keys) if side is not None else rows.withColumn(name, F.lit(False))
    reject = (
        F.when(F.col("domain").isNull(), "no domain").when(flag("black__"), "blacklisted").when(flag("path__on"), "blocked path")
        .otherwise(F.coalesce(filters.reject_reason(u, config), F.when(flag("dup__"), "duplicate")))
    )
    # written once, for the lookup reads it twice and the patterns are dear
    decided = materialize(rows.select("url", "domain", urls.rewrite_handle(F.col("bare__")).alias("clean_url"), reject.alias("reject")))
    out = lookup(pairs, decided, ["url"])
    return out.select(*pairs.columns, "domain", "clean_url", F.when(u.isNull(), "no domain").otherwise(F.col("reject")).alias("reject"))


def best_urls(accepted: DataFrame, config: Config = _DEFAULT, by: str = "id") -> DataFrame:
    """One row per id: (id, n_urls, seq, url, choice) of the url to follow.

    ``accepted`` has (seq, id, url, already_found).  The first url that was already found, or is a document or
    dataset candidate, ends the scan; else the last handle, else the last that is no doi, else the last.  Order is
    ``seq``.  One aggregation of composite maxima; no id's urls are gathered.
    """
    low, seq, url = F.lower("url"), F.col("seq"), F.col("url")
    found = F.coalesce(F.col("already_found"), F.lit(False))
    stop = F.when(found, "re-crossed").when(filters.target_candidate(low, config), "candidate")
    rows = accepted.select(by, "seq", "url", stop.alias("stop__"), url.contains("/handle/").alias("handle__"), url.contains("doi.org").alias("doi__"))
    at = F.struct(seq, url)
    got = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_urls"), F.min(F.when(F.col("stop__").isNotNull(), F.struct(seq, url, F.col("stop__").alias("why")))).alias("s"),
        F.max(F.when(F.col("handle__"), at)).alias("h"), F.max(F.when(~F.col("doi__"), at)).alias("o"), F.max(at).alias("l"),
    )
    choice = F.when(F.col("s").isNotNull(), F.col("s.why")).when(F.col("h").isNotNull(), "handle").when(F.col("o").isNotNull(), "other").otherwise("doi")
    pick = lambda f: F.coalesce(F.col(f"s.{f}"), F.col(f"h.{f}"), F.col(f"o.{f}"), F.col(f"l.{f}")).alias(f)
    return got.select(by, "n_urls", pick("seq"), pick("url"), choice.alias("choice"))


def every_pair(accepted: DataFrame) -> DataFrame:
    """The alternate modes: each accepted pair is followed."""
    return accepted.select("id", "seq", "url", F.lit("every").alias("choice"))


def url_only(urls_: DataFrame) -> DataFrame:
    """Input without ids: each url under the id text ``null``."""
    return urls_.withColumn("id", F.lit("null"))


def skipped(pairs: DataFrame, chosen: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Pairs neither chosen nor logged, with the outcome "better url"; an anti join on the unique ``seq``."""
    out = pairs.join(chosen.select("seq"), "seq", "left_anti")
    if logged is not None:
        out = out.join(logged.select("seq"), "seq", "left_anti")
    return out.withColumn("outcome", F.lit("better url"))


def next_best(accepted: DataFrame, failed: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """The next choice of ids whose chosen url failed: the same selection without the failed urls."""
    again = lookup(accepted, failed.select("id").distinct(), ["id"], "left_semi").join(failed.select("seq"), "seq", "left_anti")
    return best_urls(again, config)


def ids_without_url(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    return pairs.select("id").distinct().join(chosen.select("id"), "id", "left_anti")


def first_finders(found: DataFrame) -> DataFrame:
    """(url, seq, id, source_url, mime_type) of the record that found a url first."""
    return first_by_key(found, ["url"], "seq", ["id", "source_url", "mime_type"])


def error_rows(failed: DataFrame, logged: DataFrame | None = None, config: Config = _DEFAULT) -> DataFrame:
    """Failed urls (seq, id, url, kind, message) to outcome rows with their retry class; those already logged (or whose
    message says so) are left out."""
    from ..functions import outcomes

    out = failed.filter(~F.coalesce(F.col("message").contains("__LOGGED__"), F.lit(False)))
    if logged is not None:
        out = out.join(logged.select("seq"), "seq", "left_anti")
    r = outcomes.retry_class(F.col("kind"), F.col("message"), F.col("url"), config)
    return out.withColumn("r__", r).select("seq", "id", "url", F.lit("load error").alias("outcome"), F.col("r__.was_valid").alias("valid"), F.col("r__.could_retry").alias("retry"), F.col("r__.tail").alias("tail"))
