"""Queries over input pairs, outcome records and events: selection, lookups, breakers, statistics, files, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import filters, html, mime, outcomes, urls
from ..operators import breakers, files, learned, output, pages, pipeline, scale, select, stats
from ..shared import materialize, missing, table
from ..sources import inputs
from . import filter_sql
from .address_queries import _TOK, _did, _dom, _pth, _q

S, D = SparkSession, DataFrame


# Input ---------------------------------------------------------------------------------------------------


def parse_json_input(spark: S, d: str) -> D:
    """SRC1-2: lines with a missing key, an empty url, a null, an empty line and a broken object among them."""
    k, q = F.pmod("seq", F.lit(10)), F.to_json(F.struct("id", "url"))
    s = F.col("seq").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit('{"id":"'), s, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"id":"'), s, F.lit('","url":""}'))).when(k == 2, F.concat(F.lit('{"id":null,"url":"u'), s, F.lit('"}')))
        .when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit('{"id":'), s, F.lit(',"url":"u"}'))).when(k == 5, F.lit('{"id":"broken')).otherwise(q)
    )
    t = table(spark, d, "sample_input").select("seq", line.alias("line"))
    return inputs.parse_json_pairs(t).select("seq", "id", "url", "status")


def plain_url_input(spark: S, d: str) -> D:
    """SRC3: quotes and a byte order mark removed."""
    t = table(spark, d, "sample_input").select("seq", F.concat(F.lit('﻿"'), F.lower(F.regexp_replace("url", r"[^\x21-\x7e]", "")), F.lit('"')).alias("line"))
    return inputs.plain_urls(t, skip_header=True).select("seq", "url")


def loaded_accounting(spark: S, d: str) -> D:
    """SRC6-7: lines and loaded rows per file."""
    t = table(spark, d, "sample_input_raw")
    bad = F.count(F.when(F.coalesce(F.trim("line"), F.lit("")) == "", 1))
    return t.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_lines"), inputs.loaded_rows(F.count(F.lit(1)), bad, header=True).alias("n_loaded"))


def input_dedup_emit(spark: S, d: str) -> D:
    """AG2, SET3, WN8: pairs met before in their batch of 3000 (Q14)."""
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    return select.duplicates_flagged(t, select.batch_number(F.col("seq"))).select("seq", "is_duplicate")


def group_urls_by_id(spark: S, d: str) -> D:
    """AG1: distinct urls per id as a sorted array."""
    t = table(spark, d, "sample_input").select("id", F.lower(F.regexp_replace("url", r"[^\x21-\x7e]", "")).alias("url"))
    return select.urls_per_id(t).select("id", "n_urls", F.when(F.col("n_urls") > 0, F.array_join("urls", " ")).alias("urls"))


def _accepted(spark: S, d: str) -> D:
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    c = select.checked(t)
    return c.filter("reject is null").select("seq", "id", F.col("clean_url").alias("url"), F.lit(False).alias("already_found"))


def input_acceptance(spark: S, d: str) -> D:
    """FLT22: pairs per reason they are not followed."""
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    black = materialize(breakers.all_blocks(table(spark, d, "domain_event")).select("domain"))
    paths = materialize(breakers.blocked_paths(table(spark, d, "domain_event")).select("domain", "path"))
    return select.checked(t, blacklisted=black, blocked_paths=paths).groupBy("reject").agg(F.count(F.lit(1)).alias("n_rows"))


def best_url_per_id(spark: S, d: str) -> D:
    """MAC1, WN2: the url that is followed for each id, from all pairs with a plain rule for acceptance."""
    t = table(spark, d, "sample_input").filter(~filters.plain_domain(F.lower("url"))).select("seq", "id", "url", (F.pmod("seq", F.lit(50)) == 0).alias("already_found"))
    return select.best_urls(t)


def best_url_accepted(spark: S, d: str) -> D:
    """MAC1 after the full acceptance chain: ids per kind of choice."""
    return select.best_urls(_accepted(spark, d)).groupBy("choice").agg(F.count(F.lit(1)).alias("n_ids"))


def skipped_urls(spark: S, d: str) -> D:
    """JN11, SET2: pairs of an id that were not followed."""
    t = table(spark, d, "sample_input").filter(~filters.plain_domain(F.lower("url"))).select("seq", "id", "url", (F.pmod("seq", F.lit(50)) == 0).alias("already_found"))
    return select.skipped(t, select.best_urls(t)).select("seq", "outcome")


def ids_without_url(spark: S, d: str) -> D:
    """Ids of which no url is acceptable."""
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    return select.ids_without_url(t, select.best_urls(_accepted(spark, d)))


def next_best_url(spark: S, d: str) -> D:
    """The second choice of ids whose first choice failed."""
    a = table(spark, d, "sample_input").filter(~filters.plain_domain(F.lower("url"))).select("seq", "id", "url", F.lit(False).alias("already_found"))
    first = select.best_urls(a)
    return select.next_best(a, first.filter(F.pmod("seq", F.lit(3)) == 0)).select("id", "seq")


def every_pair(spark: S, d: str) -> D:
    """MAC2-3: the alternates without selection."""
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    a = select.every_pair(t).select("id", "seq")
    return a.unionByName(select.url_only(t.select("seq")).select("id", "seq"))


def batch_progress(spark: S, d: str) -> D:
    """WN8: batch and progress of each input row."""
    t = scale.ranked(table(spark, d, "sample_input").select("seq"), "seq")
    n = table(spark, d, "sample_input").agg(F.count(F.lit(1)).alias("n")).scalar()
    b = select.batch_number(F.col("nth"))
    return t.select("seq", b.alias("batch"), select.progress_percent(b, n).alias("progress"))


# Lookups -------------------------------------------------------------------------------------------------


def recrossed_urls(spark: S, d: str) -> D:
    """JN1, WN1, MAC12: found urls that another record found first."""
    t = table(spark, d, "output_record").filter("docordataseturl like 'http%'")
    t = t.select(F.col("record_id").alias("seq"), "id", F.col("sourceurl").alias("source_url"), F.col("pageurl").alias("page_url"), F.col("docordataseturl").alias("url"), F.col("mimetype").alias("mime_type"))
    return output.recrossed(t).filter("not is_first").select("seq", "first_seq", "first_mime")


def anti_duplicate(spark: S, d: str) -> D:
    """JN2: input pairs whose url was not already unreachable in an outcome."""
    seen = table(spark, d, "output_record").filter("docordataseturl = 'unreachable'").select(F.col("sourceurl").alias("url"))
    return scale.lookup_small(table(spark, d, "sample_input").select("seq", "url"), seen.distinct(), ["url"], "left_anti").select("seq")


def anti_blacklist(spark: S, d: str) -> D:
    """JN3: pairs outside blocked domains."""
    black = breakers.all_blocks(table(spark, d, "domain_event")).select("domain")
    t = table(spark, d, "sample_input").select("seq", urls.domain(F.col("url")).alias("domain"))
    return scale.lookup_small(t, materialize(black), ["domain"], "left_anti").select("seq")


def anti_403_path(spark: S, d: str) -> D:
    """JN4: pairs outside blocked paths."""
    p = materialize(breakers.blocked_paths(table(spark, d, "domain_event"), 3).select("domain", "path"))
    t = table(spark, d, "sample_input").select("seq", urls.domain(F.col("url")).alias("domain"), urls.path(F.col("url")).alias("path"))
    return scale.lookup_small(t, p, ["domain", "path"], "left_anti").select("seq")


def known_mime(spark: S, d: str) -> D:
    """JN5, SRC9-10: records of a known type and their category."""
    from ..shared import small_or_plain

    t = table(spark, d, "output_record").filter("mimetype is not null").select("record_id", "mimetype")
    return t.join(small_or_plain(table(spark, d, "known_mimetype")), "mimetype").select("record_id", "category")


def hash_dedup(spark: S, d: str) -> D:
    """JN8: files whose hash was stored before, and where."""
    t = table(spark, d, "output_record").select(F.col("record_id").alias("seq"), F.when(~missing(F.col("filehash")), F.col("filehash")).alias("file_hash"), F.col("filepath").alias("location"))
    return files.duplicate_hashes(t).filter("is_duplicate").select("seq", "original")


# Mime and outcomes ---------------------------------------------------------------------------------------

_MIMES = (
    ("application/pdf", None), ("text/csv; charset=utf-8", None), ("application/octet-stream", "attachment; filename=\"a.pdf\""), ("application/octet-stream", "attachment"),
    ("text/html; charset=utf-8", None), (None, "attachment; filename=b.csv"), ("('application/pdf', none)", None), ("application/x-unknown", "inline; filename='c.pdf'"), (None, None),
)
_CLASSES = (
    ("application/pdf", "document"), ("text/csv", "dataset"), ("application/pdf", "document"), None, None, ("unspecified", "dataset"), ("application/pdf", "document"), ("application/pdf", "document"), None,
)


def mime_classify(spark: S, d: str) -> D:
    """MAC6-7: types and dispositions of answers, numbered by the rows."""
    k = (F.pmod("seq", F.lit(len(_MIMES))) + 1).cast("int")
    m, p = (F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in _MIMES]), k) for i in (0, 1))
    t = table(spark, d, "sample_input").select("seq", F.concat(F.lit("https://e.org/item/"), F.col("seq").cast("string")).alias("u"), m.alias("m"), p.alias("p"))
    c = mime.classify(F.col("u"), F.col("m"), F.col("p"))
    return t.select("seq", c["mime_type"].alias("mime_type"), c["category"].alias("category"))


def mime_plain(spark: S, d: str) -> D:
    """MAC7, FLT20 on the types of outcome records."""
    m = F.col("mimetype")
    return table(spark, d, "output_record").filter(m.isNotNull()).select("record_id", mime.plain_mime(m).alias("plain"))


def body_sniff(spark: S, d: str) -> D:
    """MAC8 on bodies made of the documents."""
    k = F.pmod("doc_id", F.lit(4))
    head = F.when(k == 0, "<?xml version='1.0'?>\n\n  <!DOCTYPE html><html>\n").when(k == 1, "%PDF-1.6 binary\n").when(k == 2, "<!-- made -->\n<html>\n").otherwise("")
    s = mime.sniff_body(F.concat(head, F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", k.alias("k"), s["kind"].alias("kind"))


def retry_classify(spark: S, d: str) -> D:
    """MAC4 on error texts of the outcome records."""
    code = F.regexp_extract("error", "status ([0-9]{3})", 1)
    kind = F.when(code != "", "runtime").when(F.col("error").contains("timed out") | F.col("error").contains("no answer"), "timeout").when(F.col("error").contains("blocked"), "blocked").otherwise("other")
    text = F.concat(F.lit("HTTP "), code, F.when(code.startswith("4"), " Client Error.").otherwise(" Server Error."))
    r = outcomes.retry_class(kind, F.when(code != "", text), F.col("sourceurl"))
    t = table(spark, d, "output_record").filter(~missing(F.col("error")))
    return t.select("record_id", r["was_valid"].alias("was_valid"), r["could_retry"].alias("could_retry"), r["tail"].alias("tail"))


def status_action(spark: S, d: str) -> D:
    """MAC11 on the codes in error texts."""
    code = F.regexp_extract("error", "status ([0-9]{3})", 1).try_cast("int")
    t = table(spark, d, "output_record").withColumn("code", code).filter("code is not null")
    a = outcomes.status_action(F.lit("u"), F.lit("e.org"), F.col("code"), F.lit(True), F.lit("some text"), F.lit("30"))
    return t.select("record_id", a["message"].alias("message"), a["event"].alias("event"))


def outcome_flags(spark: S, d: str) -> D:
    """The flag table of all outcome kinds."""
    rows = [(k,) for k in outcomes.OUTCOMES]
    t = spark.createDataFrame(rows, "kind string")
    o = outcomes.outcome(F.col("kind"), F.lit("target"), F.lit("direct"), F.lit("valid"), F.lit("retry"))
    return t.select("kind", *[o[f].alias(f) for f in (*outcomes.FLAGS, "target_url")])


def output_json(spark: S, d: str) -> D:
    """SNK1-2, MAC12: records as JSON lines, parsed again."""
    t = table(spark, d, "output_record")
    r = t.select(
        "record_id", "id", F.col("sourceurl").alias("source_url"), F.col("pageurl").alias("page_url"), F.col("docordataseturl").alias("target_url"), F.lit("found").alias("outcome"), F.col("wasdirectlink").alias("direct"),
        F.lit("true").alias("valid"), F.lit("true").alias("retry"), F.col("filehash").alias("file_hash"), F.col("filesize").alias("file_size"), F.col("mimetype").alias("mime_type"), F.col("filepath").alias("file_path"), "error",
    )
    j = output.json_lines(output.records(r))
    m = F.from_json("value", "map<string,string>")
    return j.select(m["id"].alias("id"), m["docOrDatasetUrl"].alias("target"), m["fileHash"].alias("hash"), F.array_join(F.map_keys(m), ",").alias("keys")).groupBy("id", "target", "hash", "keys").agg(F.count(F.lit(1)).alias("n"))


# Files ---------------------------------------------------------------------------------------------------


def file_md5_size(spark: S, d: str) -> D:
    """SNK5-6, SNK10: hash and size of each text as a file body."""
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    return files.hashed(t).select("doc_id", "file_hash", "file_size")


def file_number(spark: S, d: str) -> D:
    """WN3: numbers of stored files, starting with 100."""
    t = table(spark, d, "output_record").select(F.col("record_id").alias("seq"), (~missing(F.col("filepath"))).alias("stored"))
    return files.numbered(t, 100).select("seq", "file_number")


def _found_names(spark: S, d: str) -> D:
    name = F.element_at(F.split(F.regexp_replace(F.lower("docordataseturl"), r"[?#].*", ""), "/"), -1)
    return table(spark, d, "output_record").filter("docordataseturl like 'http%'").select(F.col("record_id").alias("seq"), name.alias("file_name"))


def file_dup_suffix(spark: S, d: str) -> D:
    """WN4: names of pdf files numbered where they repeat, as its SQL has it; all files are in ``file_dup_suffix_all``."""
    return files.suffixed(_found_names(spark, d).filter("file_name like '%.pdf'")).select("seq", "final_name")


def file_dup_suffix_all(spark: S, d: str) -> D:
    """WN4: names of all found files numbered where they repeat, with any extension and with none."""
    return files.suffixed(_found_names(spark, d)).select("seq", "final_name")


def original_filename(spark: S, d: str) -> D:
    """MAC13, LM6: names from dispositions, else urls."""
    k = F.pmod("record_id", F.lit(3))
    disp = F.when(k == 0, F.concat(F.lit('attachment; filename="f'), F.col("record_id").cast("string"), F.lit('.pdf"')))
    url = F.when(k == 1, F.concat(F.lit("https://e.org/d/x"), F.col("record_id").cast("string"))).when(k == 2, F.concat(F.lit("https://e.org/d/"), F.repeat(F.lit("y"), 260)))
    t = table(spark, d, "output_record").select(F.col("record_id").alias("seq"), disp.alias("disposition"), url.alias("url"))
    return files.original_names(t).select("seq", "file_name")


def download_plan(spark: S, d: str) -> D:
    """MAC19, NAM: one file per hash with a name by id."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.coalesce("id", F.lit("none")).alias("id"), F.concat(F.lit("https://"), "host", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("disposition"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").cast("binary").alias("body"))
    return files.plan_downloads(t).select("seq", "final_name", "is_duplicate")


# Breakers ------------------------------------------------------------------------------------------------


def _events(spark: S, d: str) -> D:
    return table(spark, d, "domain_event")


def breaker_5xx(spark: S, d: str) -> D:
    """CB1."""
    return breakers.blocked(_events(spark, d), "http_5xx")


def breaker_timeout(spark: S, d: str) -> D:
    """CB2, AG3-4, WN5: without the buffer of good hits, too."""
    e = _events(spark, d)
    return breakers.blocked(e, "timeout").unionByName(breakers.blocked(e, "timeout", 25, buffered=False).withColumn("kind", F.lit("unbuffered")))


def breaker_content(spark: S, d: str) -> D:
    """CB3-6 with low thresholds, so that the data opens them."""
    e = _events(spark, d)
    out = None
    for k in ("no_type", "not_doc_nor_page", "no_links", "no_docs"):
        b = breakers.blocked(e, k, 2)
        out = b if out is None else out.unionByName(b)
    return out


def breaker_defaults(spark: S, d: str) -> D:
    """CB1-7 by themselves at their own thresholds: domains that each kind would block, and when."""
    e = _events(spark, d)
    out = breakers.blocked_by_paths(e)
    for k in breakers.THRESHOLDS:
        out = out.unionByName(breakers.blocked(e, k).select("domain", "kind", "block_seq"))
    return out


def breaker_403(spark: S, d: str) -> D:
    """CB7, AG5: paths, and domains with several blocked paths (low thresholds)."""
    e = _events(spark, d)
    p = breakers.blocked_paths(e, 1).select("domain", "path", "block_seq")
    return p.unionByName(breakers.blocked_by_paths(e, 1, 2).select("domain", F.lit("(domain)").alias("path"), "block_seq"))


def breaker_all(spark: S, d: str) -> D:
    """CB1-9: the first breaker that opens per domain."""
    return breakers.all_blocks(_events(spark, d))


def breaker_suppressed(spark: S, d: str) -> D:
    """Events per domain that come after its block."""
    e = _events(spark, d)
    return breakers.after_block(e, breakers.all_blocks(e)).groupBy("domain").agg(F.count(F.when(F.col("suppressed"), 1)).alias("n_suppressed"), F.count(F.lit(1)).alias("n_events"))


def adaptive_cutoff(spark: S, d: str) -> D:
    """WN9, CB11: does looking go on after each check?"""
    e = _events(spark, d).filter("kind in ('ok_doc', 'no_docs')").select("seq", (F.col("kind") == "ok_doc").alias("hit"))
    return breakers.hit_cutoff(e, 20, 45.0)


def adaptive_cutoff_default(spark: S, d: str) -> D:
    """WN9, CB11 at 0.2 percent: a hit in a thousand checks, which is too few."""
    e = table(spark, d, "output_record").select(F.col("record_id").alias("seq"), (F.pmod("record_id", F.lit(1000)) == 1).alias("hit"))
    return breakers.hit_cutoff(e)


def prediction_breaker(spark: S, d: str) -> D:
    """CB8 on events as prediction outcomes."""
    return breakers.path_predictions_blocked(_events(spark, d).filter("domain is not null").select("seq", "domain", (F.col("kind") == "ok_doc").alias("hit"))).select("domain", "block_seq")


def model_phases(spark: S, d: str) -> D:
    """CB12: phase of the path model along the input."""
    t = scale.ranked(table(spark, d, "sample_input").select("seq"), "seq", "n")
    return t.groupBy(breakers.model_phase(F.col("n"), F.lit(40.0), 100_000).alias("phase")).agg(F.count(F.lit(1)).alias("n_rows"))


# Statistics ----------------------------------------------------------------------------------------------


def run_statistics(spark: S, d: str) -> D:
    """AG6-7."""
    return stats.run_statistics(table(spark, d, "output_record"))


def run_statistics_by_load(spark: S, d: str) -> D:
    """AG6 per load with a grand total."""
    return stats.run_statistics(table(spark, d, "output_record"), ["load_id"]).select("load_id", "n_rows", "n_found", "pct_found")


def domain_hits(spark: S, d: str) -> D:
    """AG8."""
    t = table(spark, d, "output_record").filter("docordataseturl like 'http%'").select(F.col("pageurl").alias("page_url"), F.col("docordataseturl").alias("target_url"))
    return stats.domain_hits(t)


def domains_by_connections(spark: S, d: str) -> D:
    """AG9, ST1-2."""
    return stats.by_value(stats.connections(_events(spark, d)), "n", "site")


def politeness_delay(spark: S, d: str) -> D:
    """WN7 with a fixed target."""
    return stats.politeness(_events(spark, d).filter("event_ts is not null").select("seq", "domain", F.col("event_ts").alias("ts"))).select("seq", "gap_ms", "delay_ms")


def _logs(spark: S, d: str) -> D:
    e = _events(spark, d).filter("event_ts is not null")
    level = F.when(F.col("kind") == "timeout", "ERROR").when(F.col("kind") == "http_403", "WARN").otherwise("INFO")
    line = F.concat(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" x - "), F.when(F.col("kind") == "no_docs", "The maximum limit (5) was reached").otherwise("said"))
    return e.select(F.concat(F.lit("f"), F.pmod("seq", F.lit(7)).cast("string"), F.lit(".log")).alias("file_name"), F.col("seq").alias("line_no"), line.alias("line"))


def log_counts(spark: S, d: str) -> D:
    """AG13, SRC12."""
    return stats.log_counts(_logs(spark, d))


def log_gaps(spark: S, d: str) -> D:
    """WN6."""
    return stats.log_gaps(_logs(spark, d), 1800).select("file_name", "line_no", "gap_ms")


def sorted_average(spark: S, d: str) -> D:
    """ST3, AG10: means of sorted values and a success rate per domain block."""
    e = _events(spark, d).filter("domain is not null")
    g = e.groupBy("domain", F.floor(F.col("seq") / 1000).alias("block")).agg(F.count(F.when(F.col("kind") == "ok_doc", 1)).alias("hits"), F.count(F.lit(1)).alias("tries"))
    r = g.select("domain", "block", stats.success_rate(F.col("hits"), F.col("tries")).alias("rate"))
    return stats.sorted_means(r, ["domain"], "rate").select("domain", F.round("mean", 6).alias("mean_rate"))


def elapsed_time(spark: S, d: str) -> D:
    """MAC16 between the first and last event of each kind."""
    g = _events(spark, d).groupBy("kind").agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"))
    e = stats.elapsed(F.col("a"), F.col("b"))
    return g.select("kind", *[e[x].alias(x) for x in ("days", "hours", "minutes", "seconds")])


# Learned models ------------------------------------------------------------------------------------------


def _found(spark: S, d: str) -> D:
    return table(spark, d, "output_record").filter("docordataseturl like 'http%'").select(F.col("record_id").alias("seq"), F.col("pageurl").alias("page_url"), F.col("docordataseturl").alias("target_url"))


def learned_paths(spark: S, d: str) -> D:
    """AG11."""
    return learned.learned_paths(_found(spark, d)).select("page_path", "doc_path")


def path_predict(spark: S, d: str) -> D:
    """JN6: predictions that are links of their page."""
    f = _found(spark, d)
    return learned.predicted(f.select("page_url").distinct(), learned.learned_paths(f), f.select("page_url", F.col("target_url").alias("link")))


# Pages ---------------------------------------------------------------------------------------------------


def _pages(spark: S, d: str) -> D:
    """A page per record whose link text, place and metadata vary with the record."""
    k = F.pmod("record_id", F.lit(10))
    page = F.concat(F.lit("https://"), F.coalesce(urls.domain(F.col("sourceurl")), F.lit("e.org")), F.lit("/item/"), F.col("record_id").cast("string"))
    target = F.concat(F.lit("/files/"), F.col("record_id").cast("string"), F.lit(".pdf"))
    meta = F.when(k == 0, F.concat(F.lit('<meta name="citation_pdf_url" content="https://e.org/m/'), F.col("record_id").cast("string"), F.lit('.pdf">'))).when(k == 1, '<meta name="DC.Rights" content="restricted access">').otherwise("")
    link = (
        F.when(k == 2, F.concat(F.lit('<a href="'), target, F.lit('">PDF</a>'))).when(k == 3, F.concat(F.lit('<footer><a href="'), target, F.lit('">PDF</a></footer>')))
        .when(k == 4, F.concat(F.lit('<a href="{{url}}">x</a><a href="'), target, F.lit('">more</a>'))).when(k == 5, F.concat(F.lit('<form action="'), target, F.lit('"><input></form>')))
        .when(k == 6, F.concat(F.lit("<a href=\"javascript:pdflink('a','https://e.org"), target, F.lit("' , 1)\">get</a>"))).when(k == 7, F.lit('<a href="mailto:x@e.org">mail</a><a href="#top">top</a>'))
        .otherwise(F.concat(F.lit('<p>see<li><a href="'), target, F.lit('">the paper</a><li><a href="/item/'), F.col("record_id").cast("string"), F.lit('/more">more</a>')))
    )
    body = F.concat(F.lit("<html><head>"), meta, F.lit("</head><body><div class=main>"), link, F.lit("</div></body></html>"))
    # the keys are spread before the pages are made of them, for parsing pages is what takes time
    keys = table(spark, d, "output_record").select("record_id", "sourceurl").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a stored snapshot, as pages are
    return materialize(keys.select(F.col("record_id").alias("page_id"), page.alias("url"), body.alias("html")))


def html_meta(spark: S, d: str) -> D:
    """HT8-10, AG12: metadata of each page and what follows from it."""
    return pages.metadata_action(_pages(spark, d)).select("page_id", "meta_url", "rights", "action")


def html_links(spark: S, d: str) -> D:
    """HT2: link elements per page."""
    return html.elements(_pages(spark, d)).groupBy("page_key").agg(F.count(F.lit(1)).alias("n_elements"))


def html_decisions(spark: S, d: str) -> D:
    """HT3-7, HT16, FLT14-19: pages per decision of their elements."""
    e = html.element_decisions(html.elements(_pages(spark, d)))
    return e.groupBy(F.pmod(F.col("page_key").cast("bigint"), F.lit(10)).alias("k"), "tag", "decision").agg(F.count(F.lit(1)).alias("n"))


def html_text(spark: S, d: str) -> D:
    """HT1 on the texts."""
    return table(spark, d, "documents").select("doc_id", F.length(html.html_text(F.col("text"))).alias("n_chars"))


def html_error_text(spark: S, d: str) -> D:
    """HT17, LM8: text of small pages."""
    return _pages(spark, d).select("page_id", html.error_text(F.col("html")).alias("text"))


def dom_structures(spark: S, d: str) -> D:
    """HT11-12, LM7: signatures of link elements."""
    e = html.elements(_pages(spark, d))
    return e.groupBy("structure").agg(F.count(F.lit(1)).alias("n"))


def dom_predict(spark: S, d: str) -> D:
    """JN7: first element in a place that led to a document before."""
    e = html.element_decisions(html.elements(_pages(spark, d)))
    model = learned.learned_structures(e.filter("decision = 'found'").select("page_url", "structure"))
    return learned.structure_predictions(e, model).groupBy("structure").agg(F.count(F.lit(1)).alias("n"))


def candidate_links(spark: S, d: str) -> D:
    """LM1-3, HT13, HT15: ranked candidate and remaining links of each page."""
    c = pages.candidates(pages.page_links(html.elements(_pages(spark, d))))
    return c.select("page_key", "target", "part", "rank")


def first_page_link(spark: S, d: str) -> D:
    """LM5: the first link of each page."""
    return pages.first_link(html.elements(_pages(spark, d))).select("page_key", "link")


def _resources(spark: S, d: str) -> D:
    """Answers for the addresses of the made pages: every third file is missing."""
    r = table(spark, d, "output_record").select("record_id", F.coalesce(urls.domain(F.col("sourceurl")), F.lit("e.org")).alias("dom"))
    s = F.col("record_id").cast("string")
    t = r.select("record_id", F.explode(F.array(F.concat(F.lit("https://"), "dom", F.lit("/files/"), s, F.lit(".pdf")), F.concat(F.lit("https://e.org/m/"), s, F.lit(".pdf")), F.concat(F.lit("https://e.org/files/"), s, F.lit(".pdf")))).alias("url")).distinct()
    ok = F.pmod("record_id", F.lit(3)) != 0
    h = F.create_map(F.lit("content-type"), F.array(F.lit("application/pdf")))
    return materialize(t.select("url", F.lit("GET").alias("method"), F.when(ok, 200).otherwise(404).alias("status"), h.alias("headers"), F.col("url").alias("final_url"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("error_kind")))


def crawl_outcomes(spark: S, d: str) -> D:
    """MAC9, HT13-15, SRC8 over a snapshot: how each page ends."""
    return pages.crawl(_pages(spark, d), _resources(spark, d)).select("page_key", "outcome", "target_url", "mime_type")


_RUN_KEYS = ("id", "sourceUrl", "pageUrl", "docOrDatasetUrl", "wasUrlChecked", "wasUrlValid", "wasDocumentOrDatasetAccessible", "wasDirectLink", "couldRetry", "mimeType", "filePath", "error")


def _site_rows(spark: S, d: str) -> tuple[D, D]:
    """Pairs of the input on fifty invented hosts, two rows to an item, and a snapshot in which the host decides how an item
    answers: a file, an error, a page with a named link, a redirect, a page with metadata, an empty page, a refusal, no
    answer, a restricted page, or an image."""
    t = table(spark, d, "sample_input").select("seq", "id", F.floor(F.col("seq") / 2).cast("string").alias("i"), F.pmod(F.floor(F.col("seq") / 2), F.lit(50)).cast("int").alias("h"))
    host = F.concat(F.lit("https://h"), F.col("h").cast("string"), F.lit(".example.org"))
    pairs = t.select("seq", "id", F.concat(host, F.lit("/item/"), "i").alias("url"))
    k = F.col("h") % 10
    page = lambda head, body: F.concat(F.lit("<html><head>"), head, F.lit("</head><body><div class=main>"), body, F.lit("</div></body></html>")).cast("binary")
    html_ = (
        F.when(k == 2, page(F.lit(""), F.concat(F.lit('<a href="/files/'), "i", F.lit('.pdf">PDF</a>')))).when(k == 4, page(F.concat(F.lit('<meta name="citation_pdf_url" content="'), host, F.lit("/m/"), "i", F.lit('.pdf">')), F.lit("x")))
        .when(k == 5, page(F.lit(""), F.lit("nothing"))).when(k == 8, page(F.lit('<meta name="DC.Rights" content="restricted access">'), F.lit("x")))
    )
    status = F.when(k == 1, F.when(F.col("h").isin(11, 31), 500).otherwise(404)).when(k == 3, 301).when(k == 6, 403).when(k == 7, None).otherwise(200)
    kind = F.when(k == 0, "application/pdf").when(k == 9, "image/gif").otherwise("text/html; charset=utf-8")
    heads = F.create_map(F.lit("content-type"), F.array(kind), F.lit("location"), F.array(F.concat(F.lit("/moved/"), "i")))
    items = t.select("i", "h").distinct()
    row = lambda url, status, heads, body, error: F.struct(url.alias("url"), F.lit("GET").alias("method"), status.cast("int").alias("status"), heads.alias("headers"), url.alias("final_url"), body.alias("body"), error.alias("error_kind"))
    none = F.lit(None).cast("binary")
    file = row(F.concat(host, F.when(k == 2, "/files/").when(k == 3, "/moved/").otherwise("/m/"), "i", F.when(k != 3, ".pdf").otherwise("")), F.lit(200), F.create_map(F.lit("content-type"), F.array(F.lit("application/pdf"))), none, F.lit(None).cast("string"))
    own = row(F.concat(host, F.lit("/item/"), "i"), status, heads, html_, F.when(k == 7, "timeout"))
    return pairs, materialize(items.select(F.explode(F.array_compact(F.array(own, F.when(k.isin(2, 3, 4), file)))).alias("r")).select("r.*"))


def run_records(spark: S, d: str) -> D:
    """The whole run: MAC1, MAC4, MAC9-12, HT13-16, CB1-7, JN1-4, SNK1-2, from pairs to JSON records, which are read again."""
    pairs, resources = _site_rows(spark, d)
    j = output.json_lines(output.records(pipeline.run(pairs, resources)))
    m = F.from_json("value", "map<string,string>")
    return j.select(*[m[x].alias(x) for x in _RUN_KEYS])


def redirect_chains(spark: S, d: str) -> D:
    """MAC10, LM4: addresses followed over at most seven redirects; number n leads to n + 1 but for multiples of ten."""
    t = table(spark, d, "sample_input").select("seq", F.concat(F.lit("u"), F.col("seq").cast("string")).alias("url"))
    step = t.filter(F.pmod("seq", F.lit(10)) != 0).select(F.col("url").alias("from_url"), F.concat(F.lit("u"), (F.col("seq") + 1).cast("string")).alias("to_url"))
    return pages.follow_redirects(t, step).select("seq", "final_url", "hops")


def failed_tasks(spark: S, d: str) -> D:
    """AG14: failures per batch of the events and in total."""
    e = _events(spark, d).select("seq", F.col("kind").isin("timeout", "http_5xx").alias("failed"))
    return stats.failed_tasks(e, select.batch_number(F.col("seq")))


def error_rows(spark: S, d: str) -> D:
    """MAC5: outcome rows of errors that weren't logged before."""
    t = table(spark, d, "output_record").filter(~missing(F.col("error")))
    f = t.select(F.col("record_id").alias("seq"), "id", F.col("sourceurl").alias("url"), F.when(F.col("error").contains("timed out"), "timeout").otherwise("blocked").alias("kind"), F.col("error").alias("message"))
    logged = t.filter(F.pmod("record_id", F.lit(4)) == 0).select(F.col("record_id").alias("seq"))
    return select.error_rows(f, logged).select("seq", "outcome", "valid", "retry")


def outcome_union(spark: S, d: str) -> D:
    """SET1: several outcome streams as one."""
    t = table(spark, d, "output_record")
    a = t.filter("docordataseturl = 'unreachable'").select("record_id", F.lit("unreachable").alias("outcome"), "error")
    b = t.filter("docordataseturl = 'duplicate'").select("record_id", F.lit("duplicate").alias("outcome"))
    return output.union([a, b]).groupBy("outcome", F.col("error").isNull().alias("no_error")).agg(F.count(F.lit(1)).alias("n"))


def request_methods(spark: S, d: str) -> D:
    """MAC15 on the event domains."""
    k = F.pmod("seq", F.lit(4))
    m = mime.request_method(k == 0, k == 1, k == 2, F.lit(False), F.coalesce("domain", F.lit("")))
    return _events(spark, d).groupBy(m.alias("method")).agg(F.count(F.lit(1)).alias("n"))


def mime_table(spark: S, d: str) -> D:
    """SRC9-10: the known types and how many records have them."""
    t = table(spark, d, "output_record").groupBy("mimetype").agg(F.count(F.lit(1)).alias("n"))
    return mime.mime_dimension(spark).join(t, "mimetype").select("mimetype", "category", "n")


def page_mimes(spark: S, d: str) -> D:
    """FLT20: types that would be pages."""
    m = F.lower("mimetype")
    return table(spark, d, "output_record").filter(~missing(m)).groupBy("mimetype").agg(F.first(filters.page_mime(m)).alias("is_page"))


def link_rules(spark: S, d: str) -> D:
    """FLT14-16, 23, 25 and 26 on source and page urls."""
    u, p = F.col("sourceurl"), F.col("pageurl")
    return table(spark, d, "output_record").select(
        "record_id", filters.content_page_skip(u).alias("content_page"), filters.shared_site_session(u).alias("shared"), filters.dynamic_link(u).alias("dynamic"),
        F.coalesce(filters.same_site(u, urls.domain(p)), F.lit(False)).alias("same_site"), filters.document_text(F.lower(F.element_at(F.split(u, "/"), -1))).alias("named"),
    )


def flagship(spark: S, d: str) -> D:
    """Input pairs to outcomes: the followed url of each id, its site, and how records of that url ended."""
    best = materialize(select.best_urls(_accepted(spark, d)))  # the lookup reads it several times
    o = table(spark, d, "output_record").groupBy(F.col("sourceurl").alias("url")).agg(F.count(F.lit(1)).alias("n_records"), F.count(F.when(F.col("docordataseturl").startswith("http"), 1)).alias("n_found"))
    j = scale.lookup(best, o, ["url"])
    site = urls.top_three_levels(urls.domain(F.col("url")))
    return j.groupBy(site.alias("site"), "choice").agg(F.count(F.lit(1)).alias("n_ids"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"))


def best_sites(spark: S, d: str) -> D:
    """The flagship query."""
    return flagship(spark, d)


_NAMES = (
    parse_json_input, plain_url_input, loaded_accounting, input_dedup_emit, group_urls_by_id, input_acceptance, best_url_per_id, best_url_accepted, skipped_urls, ids_without_url, next_best_url, every_pair,
    batch_progress, recrossed_urls, anti_duplicate, anti_blacklist, anti_403_path, known_mime, hash_dedup, mime_classify, mime_plain, body_sniff, retry_classify, status_action, outcome_flags, output_json,
    file_md5_size, file_number, file_dup_suffix, file_dup_suffix_all, original_filename, download_plan, breaker_5xx, breaker_timeout, breaker_content, breaker_defaults, breaker_403, breaker_all, breaker_suppressed, adaptive_cutoff, adaptive_cutoff_default,
    prediction_breaker, model_phases, run_statistics, run_statistics_by_load, domain_hits, domains_by_connections, politeness_delay, log_counts, log_gaps, sorted_average, elapsed_time, learned_paths,
    path_predict, html_meta, html_links, html_decisions, html_text, html_error_text, dom_structures, dom_predict, candidate_links, first_page_link, crawl_outcomes, run_records, redirect_chains, best_sites, failed_tasks, error_rows, outcome_union,
    request_methods, mime_table, page_mimes, link_rules,
)
QUERIES = {f.__name__: f for f in _NAMES}

# SQL -----------------------------------------------------------------------------------------------------

from ..functions import patterns as P  # noqa: E402

_PD, _DOC, _SET = (_q(P.full(x)) for x in (P.PLAIN_DOMAIN, P.document_url(), P.dataset_url()))
_CAND = f"(regexp_matches(lower(url), '{_DOC}') OR regexp_matches(lower(url), '{_SET}'))"
_A = f"a AS (SELECT seq, id, url, seq % 50 = 0 AS f FROM sample_input WHERE NOT regexp_matches(lower(url), '{_PD}'))"
_BEST = f"""{_A},
c AS (SELECT *, CASE WHEN f THEN 're-crossed' WHEN {_CAND} THEN 'candidate' END AS s FROM a),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_urls, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN s IS NOT NULL THEN 0 WHEN contains(url, '/handle/') THEN 1 WHEN NOT contains(url, 'doi.org') THEN 2 ELSE 3 END,
  CASE WHEN s IS NOT NULL THEN seq ELSE -seq END) AS rn FROM c),
best AS (SELECT id, n_urls, seq, url, coalesce(s, CASE WHEN contains(url, '/handle/') THEN 'handle' WHEN NOT contains(url, 'doi.org') THEN 'other' ELSE 'doi' END) AS choice FROM r WHERE rn = 1)"""


def _breaker(kind: str, n: int, good: bool = True, name: str | None = None) -> str:
    g = "sum((kind = 'ok_doc')::INT) OVER w" if good else "0"
    return f"""SELECT domain, '{name or kind}' AS kind, min(seq) AS block_seq, arg_min(bad, seq) AS bad, arg_min(good, seq) AS good FROM (
  SELECT seq, domain, kind, (sum((kind = '{kind}')::INT) OVER w)::BIGINT AS bad, ({g})::BIGINT AS good FROM domain_event WHERE kind IN ('{kind}', 'ok_doc') AND domain IS NOT NULL
  WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE kind = '{kind}' AND bad > {n} + good AND domain NOT IN ('zenodo.org', 'doi.org', 'dx.doi.org') GROUP BY domain"""


def _paths(n: int) -> str:
    return f"""SELECT domain, path, seq AS block_seq FROM (SELECT *, row_number() OVER (PARTITION BY domain, path ORDER BY seq) AS k FROM domain_event
  WHERE kind = 'http_403' AND domain IS NOT NULL AND path IS NOT NULL) WHERE k = {n + 1}"""


def _by_paths(n: int, m: int) -> str:
    return f"SELECT domain, 'http_403' AS kind, block_seq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY block_seq) AS k FROM ({_paths(n)})) WHERE k = {m + 1}"


_ALL = (
    "al AS (SELECT domain, arg_min(kind, (block_seq, kind)) AS kind, min(block_seq) AS block_seq FROM ("
    + " UNION ALL ".join(f"SELECT domain, kind, block_seq FROM ({_breaker(k, n)})" for k, n in breakers.THRESHOLDS.items())
    + f" UNION ALL {_by_paths(breakers.PATH_403, breakers.PATHS_403)} UNION ALL SELECT domain, 'block_now', min(seq) FROM domain_event WHERE kind = 'block_now' AND domain IS NOT NULL GROUP BY domain) GROUP BY domain)"
)
_FOUND = "docordataseturl LIKE 'http%' AND wasdocumentordatasetaccessible = 'true'"
_MISS = "({0} IS NULL OR {0} = 'null')"


def _pct(x: str) -> str:
    return f"round({x} * 100.0 / nullif(n_checked, 0), 2)"


_STATS = f"""SELECT count(*) AS n_rows, count(*) FILTER (wasurlchecked = 'true') AS n_checked, count(*) FILTER ({_FOUND}) AS n_found, count(*) FILTER ({_FOUND} AND wasdirectlink = 'true') AS n_direct,
  count(*) FILTER (docordataseturl = 'duplicate') AS n_duplicates, count(*) FILTER (docordataseturl = 'unreachable') AS n_unreachable, count(*) FILTER (wasurlvalid = 'false') AS n_invalid,
  count(*) FILTER (couldretry = 'true') AS n_retry, count(*) FILTER (NOT {_MISS.format('filehash')}) AS n_files, count(*) FILTER (NOT {_MISS.format('error')}) AS n_errors,
  count(*) FILTER (contains(error, 'timed out') OR contains(error, 'no answer')) AS n_timeouts, count(*) FILTER (regexp_matches(error, 'status [0-9]{{3}}')) AS n_status"""


def _case(col: str, values: list) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + _q(v) + "'") for k, v in enumerate(values)) + " END"


_FLAGS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, " + ", ".join(f"'{dict(enumerate(('true', 'valid', 'true', 'direct', 'retry', 'target')))[i] if x == '?' else x}' AS {n}" for i, (x, n) in enumerate(zip(v, (*outcomes.FLAGS, "target_url"))))
    for k, v in outcomes.OUTCOMES.items()
)
_CODE = "nullif(regexp_extract(error, 'status ([0-9]{3})', 1), '')"
_LOGS = """logs AS (SELECT 'f' || (seq % 7) || '.log' AS file_name, seq AS line_no, kind, date_trunc('milliseconds', event_ts) AS ts FROM domain_event WHERE event_ts IS NOT NULL)"""
_SITE = f"coalesce(nullif(regexp_extract(domain, '{_q(P.full(P.TOP_THREE))}', 1), ''), domain)"
_PAGE = f"'https://' || coalesce({_dom('sourceurl')}, 'e.org') || '/item/' || record_id"
_CLEAN = r"lower(regexp_replace(url, '[^\x21-\x7e]', '', 'g'))"

_A0 = _A.replace("seq % 50 = 0", "false")
_BEST0 = _BEST.replace(_A, _A0)
_BEST2 = _BEST0.replace(_A0, "a AS (SELECT b.* FROM a1 b WHERE id IN (SELECT id FROM failed) AND seq NOT IN (SELECT seq FROM failed))")
_DM = f"coalesce({_dom('sourceurl')}, 'e.org')"
_PG = f"pg AS (SELECT record_id, record_id % 10 AS k, {_DM} AS dm FROM output_record)"
_ST = "e'a\\ndiv_main\\nbody\\nhtml\\n'"
_SF = "e'form\\ndiv_main\\nbody\\nhtml\\n'"
_MIME_ROWS = ", ".join(f"('{m}', 'document')" for m in mime.document_mimes()) + ", " + ", ".join(f"('{m}', 'dataset')" for m in P.DATASET_MIMES)

_BARE = f"CASE WHEN (lower(url) LIKE '%token%' OR lower(url) LIKE '%jsessionid%') AND regexp_extract(url, '{_TOK}', 1) <> '' THEN regexp_extract(url, '{_TOK}', 1) || CASE WHEN regexp_extract(url, '{_TOK}', 2) LIKE '&%' AND regexp_extract(url, '{_TOK}', 1) NOT LIKE '%?%' THEN '?' || substr(regexp_extract(url, '{_TOK}', 2), 2) ELSE regexp_extract(url, '{_TOK}', 2) END ELSE url END"
_CHECKED = f"""dec AS (SELECT url, {_dom('url')} AS domain, {_pth('url')} AS path, {_BARE} AS bare, {filter_sql.reject_reason('lower(url)')} AS why FROM (SELECT DISTINCT url FROM sample_input WHERE url IS NOT NULL)),
chk AS (SELECT s.seq, s.id, s.url, d.domain, d.path, CASE WHEN contains(bare, 'ir.lib.u-ryukyu.ac.jp') AND contains(bare, '/handle/123456789/') THEN replace(bare, '/123456789/', '/20.500.12000/') ELSE replace(bare, 'amp;', '&') END AS clean,
  CASE WHEN d.domain IS NULL THEN 'no domain' ELSE why END AS reject FROM sample_input s LEFT JOIN dec d ON d.url = s.url)"""
_BESTOK = _CHECKED + ", " + _BEST.replace(_A, "a AS (SELECT seq, id, clean AS url, false AS f FROM chk WHERE reject IS NULL)")
_EXT = f"nullif(regexp_extract({{0}}, '{_q(P.EXTENSION)}', 1), '')"

SQL = {
    "input_acceptance": f"""WITH {_ALL}, bp AS ({_paths(breakers.PATH_403)}), {_CHECKED}
SELECT CASE WHEN chk.domain IS NULL THEN 'no domain' WHEN al.domain IS NOT NULL THEN 'blacklisted' WHEN bp.path IS NOT NULL THEN 'blocked path' ELSE reject END AS reject, count(*) AS n_rows
FROM chk LEFT JOIN al ON al.domain = chk.domain LEFT JOIN bp ON bp.domain = chk.domain AND bp.path = chk.path GROUP BY ALL""",
    "best_url_accepted": f"WITH {_BESTOK} SELECT choice, count(*) AS n_ids FROM best GROUP BY ALL",
    "ids_without_url": f"WITH {_BESTOK} SELECT DISTINCT id FROM sample_input s WHERE id IS NULL OR NOT EXISTS (SELECT 1 FROM best b WHERE b.id = s.id)",
    "best_sites": f"""WITH {_BESTOK}, o AS (SELECT sourceurl AS url, count(*) AS n, count(*) FILTER (docordataseturl LIKE 'http%') AS f FROM output_record GROUP BY ALL), t AS (SELECT {_dom('b.url')} AS domain, choice, n, f FROM best b LEFT JOIN o ON o.url = b.url)
SELECT {_SITE} AS site, choice, count(*) AS n_ids, coalesce(sum(n), 0)::BIGINT AS n_records, coalesce(sum(f), 0)::BIGINT AS n_found FROM t GROUP BY ALL""",
    "page_mimes": f"SELECT mimetype, bool_or({filter_sql.page_mime('lower(mimetype)')}) AS is_page FROM output_record WHERE mimetype IS NOT NULL AND mimetype <> 'null' GROUP BY ALL",
    "model_phases": "WITH t AS (SELECT row_number() OVER (ORDER BY seq) AS n FROM sample_input) SELECT CASE WHEN n <= 5000 THEN 'learn' WHEN (n - 5000) % 31000 <= 1000 THEN 'run' ELSE 'sleep' END AS phase, count(*) AS n_rows FROM t GROUP BY ALL",
    "html_error_text": "SELECT record_id AS page_id, CASE record_id % 10 WHEN 2 THEN 'PDF' WHEN 3 THEN 'PDF' WHEN 4 THEN 'x more' WHEN 5 THEN NULL WHEN 6 THEN 'get' WHEN 7 THEN 'mail top' ELSE 'see the paper more' END AS text FROM output_record",
    "path_predict": f"""WITH f AS (SELECT record_id AS seq, pageurl AS p, docordataseturl AS t FROM output_record WHERE docordataseturl LIKE 'http%'),
tr AS (SELECT seq, {_pth('p')} AS pp, {_pth('t')} AS dp, {_EXT.format(_did('t'))} AS ext FROM f WHERE p <> t AND {_did('t')} IS NOT NULL),
m AS (SELECT DISTINCT pp, dp, count(DISTINCT dp) OVER (PARTITION BY pp) AS n FROM tr WHERE pp IS NOT NULL AND dp IS NOT NULL), e AS (SELECT dp, arg_max(ext, seq) AS ext FROM tr WHERE ext IS NOT NULL AND pp IS NOT NULL GROUP BY dp),
g AS (SELECT DISTINCT p, {_pth('p')} AS pp, {_did('p')} AS i FROM f), b AS (SELECT p, pp, CASE WHEN {filter_sql.plain_page('lower(i)')} THEN regexp_replace(i, '\\.[^._-]+$', '') ELSE i END AS i FROM g WHERE i IS NOT NULL),
x AS (SELECT b.p, m.dp || b.i || coalesce(e.ext, '') AS predicted FROM b JOIN m ON m.pp = b.pp AND m.n <= 5 LEFT JOIN e ON e.dp = m.dp)
SELECT x.p AS page_url, x.predicted FROM x WHERE EXISTS (SELECT 1 FROM f WHERE f.p = x.p AND f.t = x.predicted)""",
    "next_best_url": f"WITH a1 AS (SELECT * FROM (WITH {_A0} SELECT * FROM a)), failed AS (SELECT id, seq FROM (WITH {_BEST0} SELECT * FROM best) WHERE seq % 3 = 0), {_BEST2} SELECT id, seq FROM best",
    "html_decisions": """WITH n AS (SELECT record_id % 10 AS k, count(*) AS n FROM output_record GROUP BY ALL), t(k, tag, decision, m) AS (VALUES (0, 'a', 'gather', 2), (1, 'a', 'gather', 2), (2, 'a', 'found', 1), (3, 'a', 'skip', 1), (4, 'a', 'dynamic', 1),
  (4, 'a', 'gather', 1), (5, 'form', 'found', 1), (6, 'a', 'found', 1), (7, 'a', 'skip', 2), (8, 'a', 'gather', 2), (9, 'a', 'gather', 2)) SELECT n.k, tag, decision, n * m AS n FROM n JOIN t ON n.k = t.k""",
    "dom_structures": f"""WITH t(k, structure, m) AS (VALUES (0, e'a\\nli\\np\\ndiv_main\\nbody\\nhtml\\n', 2), (1, e'a\\nli\\np\\ndiv_main\\nbody\\nhtml\\n', 2), (8, e'a\\nli\\np\\ndiv_main\\nbody\\nhtml\\n', 2), (9, e'a\\nli\\np\\ndiv_main\\nbody\\nhtml\\n', 2),
  (2, {_ST}, 1), (4, {_ST}, 2), (6, {_ST}, 1), (7, {_ST}, 2), (3, e'a\\nfooter\\ndiv_main\\nbody\\nhtml\\n', 1), (5, {_SF}, 1)) SELECT structure, sum(m)::BIGINT AS n FROM output_record o JOIN t ON t.k = o.record_id % 10 GROUP BY ALL""",
    "dom_predict": f"""WITH {_PG}, l AS (SELECT DISTINCT dm FROM pg WHERE k IN (2, 6)) SELECT {_ST} AS structure, count(*) AS n FROM pg JOIN l USING (dm) WHERE k IN (2, 4, 6, 7) HAVING count(*) > 0
UNION ALL SELECT {_SF}, count(*) FROM pg WHERE k = 5 HAVING count(*) > 0""",
    "candidate_links": f"""WITH {_PG} SELECT record_id::VARCHAR AS page_key, 'https://' || dm || '/files/' || record_id || '.pdf' AS target, 'candidate' AS part, 1 AS rank FROM pg WHERE k IN (0, 1, 8, 9)
UNION ALL SELECT record_id::VARCHAR, url, CASE WHEN {_CAND} THEN 'candidate' ELSE 'remaining' END, CASE WHEN {_CAND} THEN 2 ELSE 1 END FROM (SELECT *, 'https://' || dm || '/item/' || record_id || '/more' AS url FROM pg WHERE k IN (0, 1, 8, 9))""",
    "crawl_outcomes": f"""WITH {_PG}, o AS (SELECT *, CASE WHEN k = 1 THEN 'restricted' WHEN k = 4 THEN 'domain blocked' WHEN k IN (3, 7) OR record_id % 3 = 0 THEN 'no link' ELSE 'found' END AS outcome FROM pg)
SELECT record_id::VARCHAR AS page_key, outcome, CASE WHEN outcome = 'found' THEN CASE k WHEN 0 THEN 'https://e.org/m/' WHEN 6 THEN 'https://e.org/files/' ELSE 'https://' || dm || '/files/' END || record_id || '.pdf' END AS target_url,
  CASE WHEN outcome = 'found' THEN 'application/pdf' END AS mime_type FROM o""",
    "run_records": """WITH p AS (SELECT seq, id, seq // 2 AS i, (seq // 2) % 50 AS h, 'https://h' || (seq // 2) % 50 || '.example.org' AS host FROM sample_input),
f AS (SELECT *, host || '/item/' || i AS u, row_number() OVER (PARTITION BY id, i ORDER BY seq) AS again FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS late FROM f WHERE again = 1),
c AS (SELECT *, h % 10 AS k, row_number() OVER (PARTITION BY h ORDER BY seq) AS n FROM a WHERE late = 1),
s AS (SELECT *, n > CASE WHEN k = 7 THEN 26 WHEN h IN (11, 31) OR k IN (6, 9) THEN 11 WHEN k = 5 THEN 201 ELSE 1e9 END AS silent, CASE k WHEN 0 THEN u WHEN 2 THEN host || '/files/' || i || '.pdf' WHEN 3 THEN host || '/moved/' || i WHEN 4 THEN host || '/m/' || i || '.pdf' END AS t FROM c),
w AS (SELECT *, min(seq) OVER (PARTITION BY t) AS f, first_value(id) OVER (PARTITION BY t ORDER BY seq) AS fid, first_value(u) OVER (PARTITION BY t ORDER BY seq) AS fu FROM s),
st AS (SELECT *, CASE WHEN k = 6 THEN 403 WHEN h IN (11, 31) THEN 500 WHEN k = 1 THEN 404 END AS e FROM w)
SELECT coalesce(id, 'unretrievable') AS id, u AS "sourceUrl", 'null' AS "pageUrl", 'duplicate' AS "docOrDatasetUrl", 'false' AS "wasUrlChecked", 'null' AS "wasUrlValid", 'null' AS "wasDocumentOrDatasetAccessible", 'null' AS "wasDirectLink", 'true' AS "couldRetry",
  'null' AS "mimeType", 'null' AS "filePath", 'null' AS error FROM f WHERE again > 1
UNION ALL SELECT coalesce(id, 'unretrievable'), u, 'null', 'unreachable', 'false', 'null', 'null', 'null', 'true', 'null', 'null', 'null' FROM a WHERE late > 1
UNION ALL SELECT coalesce(id, 'unretrievable'), u, CASE WHEN silent THEN 'null' WHEN k = 3 THEN t ELSE u END, coalesce(t, 'unreachable'), 'true', CASE WHEN e = 404 THEN 'false' ELSE 'true' END, CASE WHEN t IS NULL THEN 'false' ELSE 'true' END,
  CASE WHEN k IN (0, 3) THEN 'true' ELSE 'false' END, CASE WHEN silent THEN 'true' WHEN k = 8 OR t IS NOT NULL OR k = 7 OR e = 403 THEN 'true' ELSE 'false' END, CASE WHEN t IS NULL THEN 'null' ELSE 'application/pdf' END,
  CASE WHEN t IS NULL THEN 'null' WHEN seq = f THEN 'document' ELSE 'This url was already detected by ID=' || coalesce(fid, 'null') || ' and SourceUrl=' || fu END,
  CASE WHEN silent THEN 'the domain is blocked' WHEN e IS NOT NULL THEN 'Url: "' || u || '" seems to be unreachable. Received: HTTP ' || e || CASE WHEN e < 500 THEN ' Client Error.' ELSE ' Server Error.' END WHEN k = 7 THEN 'timeout' ELSE 'null' END FROM st""",
    "failed_tasks": "SELECT (seq - 1) // 3000 + 1 AS batch, count(*) AS n_tasks, count(*) FILTER (kind IN ('timeout', 'http_5xx')) AS n_failed FROM domain_event GROUP BY ROLLUP ((seq - 1) // 3000 + 1)",
    "error_rows": f"""SELECT record_id AS seq, 'load error' AS outcome, 'true' AS valid, 'true' AS retry FROM output_record WHERE error IS NOT NULL AND error <> 'null' AND record_id % 4 <> 0""",
    "outcome_union": """SELECT docordataseturl AS outcome, CASE WHEN docordataseturl = 'duplicate' THEN true ELSE error IS NULL END AS no_error, count(*) AS n FROM output_record WHERE docordataseturl IN ('unreachable', 'duplicate') GROUP BY ALL""",
    "request_methods": "SELECT CASE WHEN seq % 4 IN (0, 2) OR contains(coalesce(domain, ''), 'meetingorganizer.copernicus.org') THEN 'GET' ELSE 'HEAD' END AS method, count(*) AS n FROM domain_event GROUP BY ALL",
    "mime_table": f"WITH m(mimetype, category) AS (VALUES {_MIME_ROWS}) SELECT mimetype, category, count(*) AS n FROM m JOIN output_record USING (mimetype) GROUP BY ALL",
    "link_rules": f"""SELECT record_id, contains(sourceurl, 'viewcontent.cgi') AS content_page, contains(lower(sourceurl), 'sharedsitesession') AS shared, contains(sourceurl, '{{{{') OR contains(sourceurl, '<?') AS dynamic,
  coalesce(contains(sourceurl, {_dom('pageurl')}), false) AS same_site, regexp_full_match(lower(string_split(sourceurl, '/')[-1]), '{_q(P.DOCUMENT_TEXT)}') AS named FROM output_record""",
    "parse_json_input": """SELECT seq, CASE seq % 10 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 1 THEN seq::VARCHAR WHEN 2 THEN 'null' WHEN 4 THEN seq::VARCHAR ELSE id END AS id,
  CASE seq % 10 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'u' || seq WHEN 4 THEN 'u' ELSE url END AS url,
  CASE seq % 10 WHEN 0 THEN 'bad' WHEN 3 THEN 'empty' WHEN 5 THEN 'bad' WHEN 1 THEN 'unreachable' ELSE 'ok' END AS status FROM sample_input""",
    "plain_url_input": f"SELECT seq, u AS url FROM (SELECT seq, replace({_CLEAN}, chr(34), '') AS u FROM sample_input) WHERE u NOT IN ('', 'url')",
    "loaded_accounting": "SELECT file_name, count(*) AS n_lines, count(*) - count(*) FILTER (coalesce(trim(line), '') = '') - 1 AS n_loaded FROM sample_input_raw GROUP BY ALL",
    "input_dedup_emit": "SELECT seq, seq <> min(seq) OVER (PARTITION BY id, url, (seq - 1) // 3000) AS is_duplicate FROM sample_input",
    "group_urls_by_id": f"SELECT id, count(DISTINCT {_CLEAN}) AS n_urls, string_agg(DISTINCT {_CLEAN}, ' ' ORDER BY {_CLEAN}) AS urls FROM sample_input GROUP BY id",
    "best_url_per_id": f"WITH {_BEST} SELECT * FROM best",
    "skipped_urls": f"WITH {_BEST} SELECT seq, 'better url' AS outcome FROM a WHERE seq NOT IN (SELECT seq FROM best)",
    "every_pair": "SELECT id, seq FROM sample_input UNION ALL SELECT 'null', seq FROM sample_input",
    "batch_progress": "WITH t AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 3000 + 1 AS batch, count(*) OVER () AS n FROM sample_input) SELECT seq, batch, round(least(batch * 3000, n) * 100.0 / n, 2) AS progress FROM t",
    "recrossed_urls": """SELECT record_id AS seq, f AS first_seq, m AS first_mime FROM (SELECT record_id, min(record_id) OVER w AS f, first_value(mimetype) OVER (PARTITION BY docordataseturl ORDER BY record_id) AS m
  FROM output_record WHERE docordataseturl LIKE 'http%' WINDOW w AS (PARTITION BY docordataseturl)) WHERE record_id <> f""",
    "anti_duplicate": "SELECT seq FROM sample_input WHERE url NOT IN (SELECT sourceurl FROM output_record WHERE docordataseturl = 'unreachable' AND sourceurl IS NOT NULL)",
    "anti_blacklist": f"WITH {_ALL} SELECT seq FROM (SELECT seq, {_dom('url')} AS domain FROM sample_input) s ANTI JOIN al USING (domain)",
    "anti_403_path": f"SELECT seq FROM (SELECT seq, {_dom('url')} AS domain, {_pth('url')} AS path FROM sample_input) s ANTI JOIN ({_paths(3)}) p USING (domain, path)",
    "known_mime": "SELECT record_id, category FROM output_record JOIN known_mimetype USING (mimetype)",
    "hash_dedup": """SELECT record_id AS seq, l AS original FROM (SELECT record_id, min(record_id) OVER (PARTITION BY filehash) AS f, first_value(filepath) OVER (PARTITION BY filehash ORDER BY record_id) AS l
  FROM output_record WHERE filehash IS NOT NULL AND filehash <> 'null') WHERE record_id > f""",
    "mime_classify": f"SELECT seq, {_case('seq % 9', [c and c[0] for c in _CLASSES])} AS mime_type, {_case('seq % 9', [c and c[1] for c in _CLASSES])} AS category FROM sample_input",
    "mime_plain": f"SELECT record_id, CASE WHEN length(mimetype) <= 255 THEN nullif(regexp_extract(mimetype, '{_q(P.PLAIN_MIME)}', 1), '') END AS plain FROM output_record WHERE mimetype IS NOT NULL",
    "body_sniff": """SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html'
  ELSE CASE WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '\\s+'))) > 0 THEN 'undefined' END END AS kind FROM documents""",
    "retry_classify": f"""WITH t AS (SELECT record_id, sourceurl, error, {_CODE} AS c, contains(error, 'timed out') OR contains(error, 'no answer') AS t, contains(error, 'blocked') AS b FROM output_record WHERE error IS NOT NULL AND error <> 'null'),
k AS (SELECT *, CASE WHEN c IN ('400', '404', '410', '414', '422') THEN 1 WHEN c IN ('403', '408', '425', '426', '429', '503') THEN 2 WHEN c IS NOT NULL THEN 3 WHEN t THEN 4 WHEN b THEN 5 ELSE 3 END AS k FROM t)
SELECT record_id, CASE k WHEN 1 THEN 'false' ELSE 'true' END AS was_valid,
  CASE WHEN k IN (2, 4, 5) OR (k <> 1 AND regexp_matches(lower(sourceurl), '{_q(P.full(P.RETRY_DOMAINS))}')) THEN 'true' ELSE 'false' END AS could_retry,
  CASE k WHEN 1 THEN 'the url is invalid and lead to http-client-error.' WHEN 2 THEN 'the url had a non-fatal http-error.' WHEN 3 THEN 'there is a serious unspecified error.'
    WHEN 4 THEN 'the url had a connection-timeout.' ELSE 'the url had its initial or redirected domain blocked.' END AS tail FROM k""",
    "status_action": f"""WITH t AS (SELECT record_id, {_CODE}::INT AS c FROM output_record WHERE {_CODE} IS NOT NULL)
SELECT record_id, 'Url: "u" seems to be unreachable. Received' || CASE WHEN c BETWEEN 400 AND 499 THEN ': HTTP ' || c || ' Client Error.' || CASE WHEN c IN (404, 410) THEN '' ELSE ' Error-text: some text' END || CASE WHEN c = 429 THEN ' | Retry-After:30' ELSE '' END
  WHEN c BETWEEN 500 AND 599 THEN ': HTTP ' || c || ' Server Error.' ELSE ' unexpected responseCode: ' || c || ' Error-text: some text' END AS message,
  CASE WHEN c = 403 THEN 'http_403' WHEN c BETWEEN 500 AND 599 THEN CASE WHEN c <> 503 THEN 'http_5xx' END WHEN c NOT BETWEEN 400 AND 599 THEN 'block_now' END AS event FROM t""",
    "outcome_flags": _FLAGS_SQL,
    "output_json": """SELECT coalesce(id, 'unretrievable') AS id, coalesce(docordataseturl, 'null') AS target, coalesce(filehash, 'null') AS hash,
  'id,sourceUrl,pageUrl,docOrDatasetUrl,wasUrlChecked,wasUrlValid,wasDocumentOrDatasetAccessible,wasDirectLink,couldRetry,fileHash,fileSize,mimeType,filePath,error' AS keys, count(*) AS n FROM output_record GROUP BY ALL""",
    "file_md5_size": "SELECT doc_id, md5(text) AS file_hash, octet_length(encode(text))::BIGINT AS file_size FROM documents WHERE text <> ''",
    "file_number": "SELECT record_id AS seq, row_number() OVER (ORDER BY record_id) + 99 AS file_number FROM output_record WHERE filepath IS NOT NULL AND filepath <> 'null'",
    "file_dup_suffix": """WITH t AS (SELECT record_id AS seq, string_split(regexp_replace(lower(docordataseturl), '[?#].*', ''), '/')[-1] AS f FROM output_record WHERE docordataseturl LIKE 'http%'),
k AS (SELECT seq, f, row_number() OVER (PARTITION BY f ORDER BY seq) - 1 AS k FROM t WHERE f LIKE '%.pdf')
SELECT seq, CASE WHEN k > 0 THEN regexp_replace(f, '\\.pdf$', '') || '(' || k || ').pdf' ELSE f END AS final_name FROM k""",
    "file_dup_suffix_all": """WITH t AS (SELECT record_id AS seq, string_split(regexp_replace(lower(docordataseturl), '[?#].*', ''), '/')[-1] AS f FROM output_record WHERE docordataseturl LIKE 'http%'),
k AS (SELECT seq, f, row_number() OVER (PARTITION BY f ORDER BY seq) - 1 AS k FROM t)
SELECT seq, CASE WHEN k > 0 THEN regexp_extract(f, '^(.*?)(\\.[^.]*)?$', 1) || '(' || k || ')' || regexp_extract(f, '^(.*?)(\\.[^.]*)?$', 2) ELSE f END AS final_name FROM k""",
    "original_filename": """WITH t AS (SELECT record_id AS seq, record_id % 3 AS k, sum((record_id % 3 = 2)::INT) OVER (ORDER BY record_id) AS n FROM output_record)
SELECT seq, CASE k WHEN 0 THEN 'f' || seq || '.pdf' WHEN 1 THEN 'x' || seq || '.pdf' ELSE CASE WHEN n > 1 THEN 'unretrievableDocName(' || (n - 1) || ').pdf' ELSE 'unretrievableDocName.pdf' END END AS file_name FROM t""",
    "download_plan": """WITH t AS (SELECT doc_id AS seq, coalesce(id, 'none') AS id, doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AS is_duplicate FROM documents WHERE text <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY id, is_duplicate ORDER BY seq) - 1 AS k FROM t)
SELECT seq, CASE WHEN is_duplicate THEN NULL WHEN k > 0 THEN id || '(' || k || ').pdf' ELSE id || '.pdf' END AS final_name, is_duplicate FROM k""",
    "breaker_5xx": _breaker("http_5xx", 10),
    "breaker_timeout": _breaker("timeout", 25) + " UNION ALL " + _breaker("timeout", 25, False, "unbuffered"),
    "breaker_content": " UNION ALL ".join(_breaker(k, 2) for k in ("no_type", "not_doc_nor_page", "no_links", "no_docs")),
    "breaker_403": f"{_paths(1)} UNION ALL SELECT domain, '(domain)', block_seq FROM ({_by_paths(1, 2)})",
    "breaker_all": f"WITH {_ALL} SELECT * FROM al",
    "breaker_suppressed": f"WITH {_ALL} SELECT e.domain, count(*) FILTER (coalesce(e.seq > al.block_seq, false)) AS n_suppressed, count(*) AS n_events FROM domain_event e LEFT JOIN al ON al.domain = e.domain GROUP BY e.domain",
    "adaptive_cutoff": """WITH t AS (SELECT seq, kind = 'ok_doc' AS hit, row_number() OVER w AS n_checked, (sum((kind = 'ok_doc')::INT) OVER w)::BIGINT AS n_hits FROM domain_event WHERE kind IN ('ok_doc', 'no_docs') WINDOW w AS (ORDER BY seq)),
s AS (SELECT min(seq) FILTER (n_checked >= 20 AND n_hits * 100.0 / n_checked < 45) AS s FROM t) SELECT seq, hit, n_checked, n_hits, coalesce(seq < s, true) AS goes_on FROM t, s""",
    "breaker_defaults": " UNION ALL ".join([_by_paths(breakers.PATH_403, breakers.PATHS_403)] + [f"SELECT domain, kind, block_seq FROM ({_breaker(k, n)})" for k, n in breakers.THRESHOLDS.items()]),
    "adaptive_cutoff_default": """WITH t AS (SELECT record_id AS seq, record_id % 1000 = 1 AS hit, row_number() OVER w AS n_checked, (sum((record_id % 1000 = 1)::INT) OVER w)::BIGINT AS n_hits FROM output_record WINDOW w AS (ORDER BY record_id)),
s AS (SELECT min(seq) FILTER (n_checked >= 20 AND n_hits * 100.0 / n_checked < 0.2) AS s FROM t) SELECT seq, hit, n_checked, n_hits, coalesce(seq < s, true) AS goes_on FROM t, s""",
    "prediction_breaker": "SELECT domain, seq AS block_seq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM domain_event WHERE kind <> 'ok_doc' AND domain IS NOT NULL) WHERE k = 11 AND domain NOT IN ('zenodo.org', 'doi.org', 'dx.doi.org')",
    "run_statistics": f"WITH s AS ({_STATS} FROM output_record) SELECT *, " + ", ".join(f"{_pct('n_' + k)} AS pct_{k}" for k in ("found", "direct", "duplicates", "unreachable", "invalid", "files", "errors")) + ", greatest(n_checked - n_found - n_errors, 0) AS n_rest FROM s",
    "run_statistics_by_load": f"WITH s AS ({_STATS}, load_id FROM output_record GROUP BY ROLLUP (load_id)) SELECT load_id, n_rows, n_found, {_pct('n_found')} AS pct_found FROM s",
    "domain_hits": f"""WITH t AS (SELECT pageurl <> docordataseturl AS ne, {_dom('pageurl')} AS p, {_dom('docordataseturl')} AS t FROM output_record WHERE docordataseturl LIKE 'http%')
SELECT domain, count(*) AS hits FROM (SELECT p AS domain FROM t UNION ALL SELECT t FROM t WHERE ne AND t IS DISTINCT FROM p) WHERE domain IS NOT NULL GROUP BY ALL""",
    "domains_by_connections": f"SELECT {_SITE} AS site, count(*) AS n FROM domain_event WHERE domain IS NOT NULL GROUP BY ALL ORDER BY n DESC, site",
    "politeness_delay": f"""WITH t AS (SELECT seq, coalesce({_SITE}, '') AS s, event_ts AS ts FROM domain_event WHERE event_ts IS NOT NULL),
g AS (SELECT seq, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY s ORDER BY ts, seq))) // 1000 AS g FROM t), h AS (SELECT seq, coalesce(g, -1) AS gap_ms FROM g)
SELECT seq, gap_ms, CASE WHEN gap_ms BETWEEN 0 AND 2999 THEN 5000 - gap_ms ELSE 0 END AS delay_ms FROM h""",
    "log_counts": f"WITH {_LOGS} SELECT file_name, count(*) AS n_lines, count(*) FILTER (kind = 'timeout') AS n_errors, count(*) FILTER (kind = 'no_docs') AS n_watched FROM logs GROUP BY ALL",
    "log_gaps": f"WITH {_LOGS}, g AS (SELECT file_name, line_no, abs(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY file_name ORDER BY line_no))) AS gap_ms FROM logs) SELECT * FROM g WHERE gap_ms > 1800000",
    "sorted_average": """WITH g AS (SELECT domain, seq // 1000 AS b, count(*) FILTER (kind = 'ok_doc') * 100.0 / count(*) AS r FROM domain_event WHERE domain IS NOT NULL GROUP BY ALL)
SELECT domain, round(avg(r), 6) AS mean_rate FROM g GROUP BY ALL""",
    "elapsed_time": """WITH g AS (SELECT kind, epoch(date_trunc('second', max(event_ts)))::BIGINT - epoch(date_trunc('second', min(event_ts)))::BIGINT AS s FROM domain_event GROUP BY kind)
SELECT kind, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds FROM g""",
    "learned_paths": f"""WITH t AS (SELECT DISTINCT {_pth('pageurl')} AS page_path, {_pth('docordataseturl')} AS doc_path FROM output_record WHERE docordataseturl LIKE 'http%' AND pageurl <> docordataseturl AND {_did('docordataseturl')} IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY page_path) AS n FROM t WHERE page_path IS NOT NULL AND doc_path IS NOT NULL) SELECT page_path, doc_path FROM n WHERE n <= 5""",
    "html_meta": """SELECT record_id AS page_id, CASE record_id % 10 WHEN 0 THEN 'https://e.org/m/' || record_id || '.pdf' END AS meta_url, CASE record_id % 10 WHEN 1 THEN 'restricted access -- ' END AS rights,
  CASE record_id % 10 WHEN 0 THEN 'fetch' WHEN 1 THEN 'restricted' ELSE 'crawl' END AS action FROM output_record""",
    "html_links": "SELECT record_id::VARCHAR AS page_key, CASE WHEN record_id % 10 IN (2, 3, 5, 6) THEN 1 ELSE 2 END::BIGINT AS n_elements FROM output_record",
    "html_text": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS x FROM documents), g AS (SELECT doc_id, sum(length(x) + 1) - 1 AS n FROM l WHERE length(x) > 1 AND NOT regexp_full_match(x, '\s+') GROUP BY doc_id)
SELECT doc_id, g.n::INT AS n_chars FROM documents LEFT JOIN g USING (doc_id)""",
    "first_page_link": f"""SELECT record_id::VARCHAR AS page_key, CASE record_id % 10 WHEN 4 THEN '{{{{url}}}}' WHEN 6 THEN 'javascript:pdflink(''a'',''https://e.org/files/' || record_id || '.pdf'' , 1)' WHEN 7 THEN 'mailto:x@e.org'
  ELSE '/files/' || record_id || '.pdf' END AS link FROM output_record WHERE record_id % 10 <> 5""",
    "redirect_chains": """WITH t AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 0 ELSE 10 - seq % 10 END AS h, max(seq) OVER () AS m FROM sample_input)
SELECT seq, CASE WHEN least(h, m + 1 - seq) <= 7 THEN 'u' || (seq + least(h, m + 1 - seq)) END AS final_url, least(h, m + 1 - seq, 7)::INT AS hops FROM t""",
}
