"""Run statistics, hit counts, connection counts, politeness and log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.outcomes import percent
from ..shared import missing
from .scale import previous

# Log lines and what is searched in them.
LOG_LINE = r"^(.*)\s(?:INFO|DEBUG|WARN|ERROR).*$"
LOG_WATCHED = "The maximum limit ("
LOG_GAP_SECONDS = 30
MIN_DELAY_MS = 3000


def run_statistics(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one per group): totals of outcomes and their percentages of the checked rows.

    ``records`` are output records.  With ``by`` a grand total row with NULL groups is added (rollup).
    """
    yes = lambda c: F.count(F.when(c, 1))
    found = F.col("docordataseturl").startswith("http") & (F.col("wasdocumentordatasetaccessible") == "true")
    err = F.col("error")
    aggs = [
        F.count(F.lit(1)).alias("n_rows"), yes(F.col("wasurlchecked") == "true").alias("n_checked"), yes(found).alias("n_found"),
        yes(found & (F.col("wasdirectlink") == "true")).alias("n_direct"), yes(F.col("docordataseturl") == "duplicate").alias("n_duplicates"),
        yes(F.col("docordataseturl") == "unreachable").alias("n_unreachable"), yes(F.col("wasurlvalid") == "false").alias("n_invalid"),
        yes(F.col("couldretry") == "true").alias("n_retry"), yes(~missing(F.col("filehash"))).alias("n_files"), yes(~missing(err)).alias("n_errors"),
        yes(err.contains("timed out") | err.contains("no answer")).alias("n_timeouts"), yes(err.rlike("status [0-9]{3}")).alias("n_status"),
    ]
    grouped = records.rollup(*by).agg(*aggs) if by else records.agg(*aggs)
    rest = F.greatest(F.col("n_checked") - F.col("n_found") - F.col("n_errors"), F.lit(0))
    shares = [percent(F.col(f"n_{k}"), F.col("n_checked")).alias(f"pct_{k}") for k in ("found", "direct", "duplicates", "unreachable", "invalid", "files", "errors")]
    return grouped.select("*", *shares, rest.alias("n_rest"))


def domain_hits(found: DataFrame) -> DataFrame:
    """(domain, hits): one for the page's domain, one for the target's if it is another.

    ``found`` has (page_url, target_url).  Domains are computed once per row and counted with map-side combining.
    """
    d = found.select("page_url", "target_url", urls.domain(F.col("page_url")).alias("p"), urls.domain(F.col("target_url")).alias("t"))
    other = F.when((F.col("page_url") != F.col("target_url")) & F.col("t").isNotNull() & ~F.col("t").eqNullSafe(F.col("p")), F.col("t"))
    return d.select(F.explode(F.array("p", other)).alias("domain")).filter("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("hits"))


def connections(requests: DataFrame) -> DataFrame:
    """(site, n) of the last three domain levels; order by ``n`` descending for the report."""
    return requests.filter("domain is not null").groupBy(urls.top_three_levels(F.col("domain")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


def by_value(counts: DataFrame, value: str, key: str, descending: bool = True) -> DataFrame:
    v = F.col(value)
    return counts.orderBy(v.desc() if descending else v.asc(), F.col(key).asc())


def average_of_sorted(values: Column) -> Column:
    """Mean of an array summed from small to large; NULL for an empty one."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))


def sorted_means(df: DataFrame, keys: list[str], value: str, slices: int = 64) -> DataFrame:
    """(*keys, mean): means of values summed from small to large, also where a key has too many for one task.

    Values are cut into slices by their hash, each slice is summed in order, and the slices' sums are added in order.
    """
    part = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(slices)).alias("slice__"), F.col(value).alias("v__")).agg(F.count(F.lit(1)).alias("n__"))
    sums = part.groupBy(*keys, "slice__").agg(F.array_sort(F.collect_list(F.struct("v__", "n__"))).alias("vs__"), F.sum("n__").alias("n__"))
    sums = sums.select(*keys, "n__", F.aggregate("vs__", F.lit(0.0), lambda a, x: a + x["v__"] * x["n__"]).alias("s__"))
    per = sums.groupBy(*keys).agg(F.array_sort(F.collect_list("s__")).alias("ss__"), F.sum("n__").alias("n__"))
    return per.select(*keys, (F.aggregate("ss__", F.lit(0.0), lambda a, x: a + x) / F.col("n__")).alias("mean"))


def success_rate(hits: Column, tries: Column) -> Column:
    return hits * 100.0 / F.nullif(tries, F.lit(0))


def politeness(requests: DataFrame, target_ms: int = 5000) -> DataFrame:
    """``requests`` (seq, domain, ts) with ``gap_ms`` since the site's previous request (-1: none) and the ``delay_ms`` owed.

    Delay: none for the first request and for gaps from 3 s on, else the target minus the gap (a fixed target where
    a random one between 3 and 7 s would not repeat).  The previous request is looked up in blocks of an hour, so a hot
    site is no single task.
    """
    site = F.coalesce(urls.top_three_levels(F.col("domain")), F.lit(""))
    rows = requests.select("*", site.alias("site"), F.date_trunc("hour", F.col("ts")).alias("hour__"))
    j = previous(rows, ["site"], "hour__", ["ts", "seq"], "ts", "prev__")
    gap = ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev__").cast("timestamp"))) / 1000).cast("bigint")
    return j.select(*requests.columns, "site", F.coalesce(gap, F.lit(-1)).alias("gap_ms")).withColumn(
        "delay_ms", F.when(F.col("gap_ms").between(0, MIN_DELAY_MS - 1), F.lit(target_ms) - F.col("gap_ms")).otherwise(0).cast("bigint")
    )


def log_counts(lines: DataFrame) -> DataFrame:
    """(file_name, n_lines, n_errors, n_watched): an error line is not also counted as watched."""
    err = F.col("line").contains("ERROR")
    return lines.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(F.when(err, 1)).alias("n_errors"), F.count(F.when(~err & F.col("line").contains(LOG_WATCHED), 1)).alias("n_watched")
    )


def log_time(line: Column) -> Column:
    """Timestamp before the level; NULL where there is none."""
    return F.try_to_timestamp(F.regexp_extract(line, LOG_LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def log_gaps(lines: DataFrame, seconds: int = LOG_GAP_SECONDS, block_lines: int = 10_000) -> DataFrame:
    """Lines (file_name, line_no, line) whose time is more than ``seconds`` off the previous timed line of the file.

    The previous line is looked up in blocks of line numbers, so a file with a third of all lines is no single task.
    """
    t = lines.withColumn("ts", log_time(F.col("line"))).filter("ts is not null").withColumn("block__", F.floor(F.col("line_no") / block_lines))
    p = previous(t.select("file_name", "line_no", "ts", "block__"), ["file_name"], "block__", ["line_no"], "ts", "prev__")
    gap = F.abs(F.unix_millis("ts") - F.unix_millis("prev__"))
    return p.select("file_name", "line_no", "ts", gap.alias("gap_ms")).filter(F.col("gap_ms") > seconds * 1000)


def elapsed(start: Column, end: Column) -> Column:
    """struct(days, hours, minutes, seconds) between two times."""
    s = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    part = lambda x, n: x.cast("bigint").alias(n)
    return F.struct(part(F.floor(s / 86400), "days"), part(F.floor(s % 86400 / 3600), "hours"), part(F.floor(s % 3600 / 60), "minutes"), part(s % 60, "seconds"))


def failed_tasks(tasks: DataFrame, batch: Column) -> DataFrame:
    """(batch, n_tasks, n_failed) of tasks with a ``failed`` flag, and their total in the row with batch NULL.

    Every failed task counts (Q15: a literal reading counts failing batches).
    """
    return tasks.withColumn("batch", batch).rollup("batch").agg(F.count(F.lit(1)).alias("n_tasks"), F.count(F.when(F.col("failed"), 1)).alias("n_failed"))
