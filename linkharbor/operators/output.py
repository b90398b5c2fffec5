"""Assembly of output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import outcomes, urls
from .scale import first_by_key, lookup

_DEFAULT = Config()
#: Columns of a record before it becomes text; the fourth key is named by the configuration.
COLUMNS = ("id", "sourceUrl", "pageUrl", "target", *outcomes.FLAGS, "fileHash", "fileSize", "mimeType", "filePath", "error")


def records(rows: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Outcome rows to text records.

    ``rows`` has (id, source_url, page_url, target_url, outcome, direct, valid, retry, file_hash, file_size,
    mime_type, file_path, error); all may be NULL.  Temporal ids are removed from found urls.
    """
    o = outcomes.outcome(F.col("outcome"), urls.strip_temporal_id(F.col("target_url")), F.col("direct"), F.col("valid"), F.col("retry"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    r = rows.withColumn("o__", o)
    flags = [text(F.col(f"o__.{f}")).alias(f) for f in outcomes.FLAGS]
    return r.select(
        F.coalesce("id", F.lit("unretrievable")).alias("id"), F.col("source_url").alias("sourceUrl"), text(F.col("page_url")).alias("pageUrl"),
        text(F.col("o__.target_url")).alias("target"), *flags, text(F.col("file_hash")).alias("fileHash"), text(F.col("file_size")).alias("fileSize"),
        text(F.col("mime_type")).alias("mimeType"), text(F.col("file_path")).alias("filePath"), text(F.col("error")).alias("error"),
    )


def json_lines(recs: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """One JSON text per record, keys in their fixed order; ``id`` only in id mode."""
    fields: list[Column] = [F.col("id")] if config.id_mode else []
    fields += [urls.escape_for_output(F.col("sourceUrl")).alias("sourceUrl"), urls.escape_for_output(F.col("pageUrl")).alias("pageUrl"), F.col("target").alias(config.target_key)]
    fields += [F.col(c) for c in COLUMNS[4:]]
    return recs.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def recrossed(targets: DataFrame, for_page: bool = True, config: Config = _DEFAULT) -> DataFrame:
    """Found targets (seq, id, source_url, page_url, url, mime_type) with what their first finder says.

    ``is_first`` marks the first finder; others get its id, source url and mime type and a ready ``file_path`` text.
    """
    f = first_by_key(targets, ["url"], "seq", ["id", "source_url", "mime_type"])
    f = f.select("url", F.col("seq").alias("first_seq"), F.col("id").alias("first_id"), F.col("source_url").alias("first_source"), F.col("mime_type").alias("first_mime"))
    j = lookup(targets, f, ["url"])
    verb = outcomes.DOWNLOADED if config.downloads else outcomes.DETECTED
    said = F.concat(F.lit(verb), F.coalesce("first_id", F.lit("null")), F.lit(outcomes.AND_URL), F.col("first_source"))
    first = F.col("seq") == F.col("first_seq")
    return j.withColumns({"is_first": first, "outcome": F.when(first, "found").otherwise("re-crossed"), "file_path": F.when(~first, said)})


def union(parts: list[DataFrame]) -> DataFrame:
    """All outcome streams in one, by column name; missing columns are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
