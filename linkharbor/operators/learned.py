"""Learned models: which document paths a page path led to, and where on the page the link stood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters, urls
from .scale import first_by_key, lookup, lookup_small

MAX_PATHS = 5


def training_pairs(found: DataFrame) -> DataFrame:
    """(seq, page_path, doc_path, extension) of found documents (seq, page_url, target_url) other than the page itself."""
    page, doc = F.col("page_url"), F.col("target_url")
    d = found.filter(page != doc).select("seq", urls.path(page).alias("page_path"), urls.path(doc).alias("doc_path"), urls.doc_id(doc).alias("i"))
    return d.filter("page_path is not null and doc_path is not null and i is not null").select("seq", "page_path", "doc_path", urls.extension(F.col("i")).alias("extension"))


def learned_paths(found: DataFrame) -> DataFrame:
    """(page_path, doc_path, extension): pairs seen, without page paths that led to more than five document paths.

    The extension is the latest one seen for the document path.
    """
    t = training_pairs(found)
    pairs = t.select("page_path", "doc_path").distinct()
    many = pairs.groupBy("page_path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MAX_PATHS).select("page_path")
    ext = first_by_key(t.filter("extension is not null"), ["doc_path"], "seq", ["extension"], last=True).select("doc_path", "extension")
    return pairs.join(many, "page_path", "left_semi").join(ext, "doc_path", "left").select("page_path", "doc_path", "extension")


def predicted(pages: DataFrame, model: DataFrame, links: DataFrame) -> DataFrame:
    """(page_url, predicted) of predictions that are links of their page.

    ``pages`` (page_url), ``links`` (page_url, link).  A page path has at most five document paths, so the join
    multiplies a page by five at most.
    """
    i = urls.doc_id(F.col("page_url"))
    bare = F.when(filters.plain_page(F.lower(i)), F.regexp_replace(i, r"\.[^._-]+$", "")).otherwise(i)
    p = pages.select("page_url", urls.path(F.col("page_url")).alias("page_path"), bare.alias("i")).filter("page_path is not null and i is not null")
    per = model.groupBy("page_path").agg(F.collect_list(F.struct("doc_path", "extension")).alias("m__"))  # five at most
    made = lookup_small(p, per, ["page_path"], "inner").select("page_url", "i", F.explode("m__").alias("m__"))
    made = made.select("page_url", F.concat("m__.doc_path", "i", F.coalesce("m__.extension", F.lit(""))).alias("predicted"))
    return made.join(links.select("page_url", F.col("link").alias("predicted")).distinct(), ["page_url", "predicted"], "left_semi")


def learned_structures(found_links: DataFrame) -> DataFrame:
    """(page_path, structure) of links that led to a document; ``found_links`` has (page_url, structure)."""
    return found_links.select(urls.path(F.col("page_url")).alias("page_path"), "structure").filter("page_path is not null").distinct()


def structure_predictions(elements: DataFrame, model: DataFrame) -> DataFrame:
    """First element of each page whose structure the page's path has led to before: (page_key, pos, link)."""
    e = elements.withColumn("page_path", urls.path(F.col("page_url")))
    hit = lookup_small(e, model.select("page_path", "structure"), ["page_path", "structure"], "left_semi")
    return first_by_key(hit, ["page_key"], "pos", ["link", "structure"])


def times_predicted(outcomes: DataFrame) -> DataFrame:
    """(n, hits, rate) of predictions; ``outcomes`` has (hit)."""
    return outcomes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits")).withColumn("rate", F.col("hits") * 100.0 / F.nullif(F.col("n"), F.lit(0)))


def repeat_lookup(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to a one-row-per-key model, hot keys by broadcast."""
    return lookup(rows, model, keys)
