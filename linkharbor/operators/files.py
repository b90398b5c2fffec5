"""Files of found documents: sizes, hashes, numbers and names, planned relationally before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import filters, mime, outcomes
from .scale import first_by_key, lookup, ranked, running

_DEFAULT = Config()


def hashed(files: DataFrame, body: str = "body") -> DataFrame:
    """``files`` with ``file_hash`` (md5 in lower hex) and ``file_size`` in bytes; empty bodies are errors and left out."""
    b = F.col(body)
    return files.filter(b.isNotNull() & (F.octet_length(b) > 0)).withColumns({"file_hash": outcomes.md5_hex(b), "file_size": F.octet_length(b).cast("bigint")})


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """``files`` (seq, file_hash, location) with ``original``: the location of the first file with the hash, and
    ``is_duplicate``.  NULL hashes are no duplicates of each other."""
    firsts = first_by_key(files.filter("file_hash is not null"), ["file_hash"], "seq", ["location"]).select("file_hash", F.col("seq").alias("first_seq__"), F.col("location").alias("original"))
    j = lookup(files, firsts, ["file_hash"])
    return j.withColumn("is_duplicate", F.coalesce(F.col("seq") > F.col("first_seq__"), F.lit(False))).drop("first_seq__")


def numbered(files: DataFrame, first: int = 1) -> DataFrame:
    """Stored files (seq, stored) with ``file_number``; only successes consume numbers."""
    ok = ranked(files.filter("stored"), "seq", "file_number")
    return ok.withColumn("file_number", F.col("file_number") + (first - 1))


def suffixed(files: DataFrame, name: str = "file_name") -> DataFrame:
    """``files`` (seq, name) with ``final_name``: ``name(k).ext`` for the k-th later file of the name."""
    r = running(files, [name], "seq", {"k__": F.lit(1)})
    return r.withColumn("final_name", outcomes.numbered_name(F.col(name), F.col("k__") - 1)).drop("k__")


def original_names(files: DataFrame, folder: str = "") -> DataFrame:
    """``files`` (seq, disposition, url) with ``file_name``: from the disposition, else the url; files whose name is
    missing or too long are ``unretrievableDocName(k).pdf``."""
    named = files.withColumn("name__", outcomes.original_name(F.col("disposition"), F.col("url"), folder))
    r = running(named.withColumn("all__", F.lit(1)), ["all__"], "seq", {"k__": F.col("name__").isNull().cast("int")})
    lost = outcomes.numbered_name(F.lit(outcomes.LOST_NAME), F.col("k__") - 1)
    return r.withColumn("file_name", F.coalesce("name__", lost)).drop("name__", "k__", "all__")


def id_names(files: DataFrame) -> DataFrame:
    """``files`` (seq, id) with names after their ids, numbered where an id has several files."""
    return suffixed(files.withColumn("file_name", F.concat(F.regexp_replace("id", r"[/\\]", "_"), F.lit(".pdf"))))


def plan_downloads(found: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Found documents (seq, id, url, disposition, length, body) to file rows: size gate, hash, one file per hash,
    a name by the configured kind, and the time a download may take."""
    size = filters.content_size(F.col("length"), F.lit(True), config)
    ok = found.withColumn("accepted_size", size).filter(F.col("accepted_size") != -1)
    h = duplicate_hashes(hashed(ok).withColumn("location", F.col("url")))
    h = h.withColumn("budget_ms", mime.download_budget_ms(F.col("accepted_size")))
    keep, again = h.filter(~F.col("is_duplicate")), h.filter("is_duplicate")
    kind = config.resolved().file_name_type
    if kind == "numberName":
        n = numbered(keep.withColumn("stored", F.lit(True)), config.first_file_number)
        named = n.withColumn("final_name", F.concat(F.col("file_number").cast("string"), F.lit(".pdf"))).drop("stored", "file_number")
    elif kind == "originalName":
        named = suffixed(original_names(keep)).drop("file_name")
    else:
        named = id_names(keep).drop("file_name")
    return named.unionByName(again.withColumn("final_name", F.lit(None).cast("string")))
