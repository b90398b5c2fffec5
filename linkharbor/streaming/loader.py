"""Loading input as a stream: one micro-batch stands for one batch of the input, flushed before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import output, select
from ..sources import inputs, sinks

_DEFAULT = Config()
_NONE = lambda c: F.lit(None).cast("string").alias(c)


def batch_outcomes(lines: DataFrame, config: Config = _DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The urls to follow, and the outcome rows of all other pairs, of one batch of JSON lines.

    ``lines`` has (file_name, line); the order inside the batch comes from a hash of both, so it does not depend on how
    the batch was read.  Unreadable lines have no outcome, as in a batch run.
    """
    parsed = inputs.parse_json_pairs(lines.select("file_name", "line")).filter(F.col("status").isin("ok", "unreachable"))
    numbered = parsed.select("*", F.row_number().over(Window.partitionBy("file_name", "line").orderBy("line")).alias("again__"))
    pairs = numbered.select((F.xxhash64("file_name", "line", "again__").bitwiseAND((1 << 62) - 1)).alias("seq"), "id", "url", "status")
    flagged = select.duplicates_flagged(pairs.select("seq", "id", "url")).join(pairs.select("seq", "status"), "seq")
    fresh = select.checked(flagged.filter((F.col("status") == "ok") & ~F.col("is_duplicate")).select("seq", "id", "url"), config)
    accepted = fresh.filter("reject is null").select("seq", "id", F.col("clean_url").alias("url"), F.lit(False).alias("already_found"))
    chosen = select.best_urls(accepted, config)
    kind = (
        F.when(F.col("is_duplicate"), "duplicate in batch").when(F.col("status") == "unreachable", "no domain").when(F.col("reject") == "no domain", "no domain")
        .when(F.col("reject").isin("blacklisted", "blocked path"), "blacklisted").when(F.col("reject") == "duplicate", "duplicate").when(F.col("reject").isNotNull(), "rejected").otherwise("better url")
    )
    rest = flagged.join(fresh.select("seq", "reject"), "seq", "left").join(chosen.select("seq"), "seq", "left_anti")
    rows = rest.select(
        "id", F.col("url").alias("source_url"), _NONE("page_url"), _NONE("target_url"), kind.alias("outcome"), _NONE("direct"), _NONE("valid"), _NONE("retry"), _NONE("file_hash"),
        F.lit(None).cast("bigint").alias("file_size"), _NONE("mime_type"), _NONE("file_path"), F.col("reject").alias("error"),
    )
    return chosen, output.records(rows, config)


def load(spark: SparkSession, folder: str, chosen_path: str, records_path: str, checkpoint: str, config: Config = _DEFAULT, files_per_batch: int = 1):
    """Start the stream over a folder of JSON-lines files.

    Each micro-batch appends its chosen urls as Parquet and its outcome records as JSON lines; a restart continues
    after the last finished batch.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    lines = lines.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))

    def flush(df: DataFrame, batch: int) -> None:
        df = df.persist()
        chosen, recs = batch_outcomes(df, config)
        chosen.withColumn("batch", F.lit(batch)).write.mode("append").parquet(chosen_path)
        sinks.write_json_lines(recs, records_path, config)
        df.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(flush).trigger(availableNow=True).start()
