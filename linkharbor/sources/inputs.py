"""Readers: id-url pairs as JSON lines, plain url lists, mime dimensions, logs, and fetched pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line) of text files, local or on any Hadoop file system."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


def parse_json_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines to ``id``, ``url`` and ``status``: ok, empty, bad (no object or a missing key) or unreachable (id but no url).

    A JSON null reads as the text ``null`` and numbers as their digits; parsing into a map tells a missing key from
    a null one.
    """
    c = F.col(line)
    m = F.from_json(c, "map<string,string>")
    has = F.map_contains_key(m, "id") & F.map_contains_key(m, "url")
    value = lambda k: F.when(has, F.coalesce(m[k], F.lit("null")))
    rows = lines.select("*", value("id").alias("id"), value("url").alias("url"), F.coalesce(has, F.lit(False)).alias("has__"))
    status = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(~F.col("has__"), "bad").when((F.col("url") == "") & (F.col("id") != ""), "unreachable").otherwise("ok")
    return rows.withColumn("status", status).drop("has__")


def read_json_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_pairs(text_lines(spark, path))


def plain_urls(lines: DataFrame, skip_header: bool = False, line: str = "line") -> DataFrame:
    """One url per line, quotes and a leading byte order mark removed; the header ``url`` is skipped on request."""
    u = F.trim(F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), '"', ""))
    out = lines.withColumn("url", u).filter("url is not null and url <> ''")
    return out.filter(F.lower("url") != "url") if skip_header else out


def read_urls(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    return plain_urls(text_lines(spark, path), skip_header)


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("n_lines"))


def loaded_rows(n_lines: Column, n_bad: Column, header: bool = False) -> Column:
    """Rows that were loaded: all lines without unreadable ones and the header."""
    return n_lines - n_bad - (1 if header else 0)


def download_input(spark: SparkSession, url: str, timeout: float = 30.0) -> DataFrame:
    """Input lines behind an http address, which must answer with JSON.

    The driver fetches them once, in pieces, into the shared folder, from where all executors read them.
    """
    import urllib.request
    import uuid

    from ..shared import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/linkharbor-input-{uuid.uuid4().hex}.json"
    with urllib.request.urlopen(urllib.request.Request(url, headers=request_headers()), timeout=timeout) as r:
        kind = r.headers.get("Content-Type", "")
        if "json" not in kind.lower():
            raise ValueError(f"the input must be JSON, not {kind or 'of no type'}")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        try:
            while piece := r.read(1 << 20):
                out.write(bytearray(piece))
        finally:
            out.close()
    return text_lines(spark, path)


def mime_file(spark: SparkSession, path: str) -> DataFrame:
    """(mimetype) of a dimension file, one per line with an optional ``// comment``."""
    return mime_lines(text_lines(spark, path))


def mime_lines(lines: DataFrame) -> DataFrame:
    m = F.trim(F.regexp_extract("line", r"^([^/]+/[^/]+?)(?:\s*//.*)?$", 1))
    return lines.select(m.alias("mimetype")).filter("mimetype <> ''").distinct()


def s3_conf(credentials: str) -> dict[str, str]:
    """Settings of the object store from its five comma-separated fields: endpoint, access key, secret key, region, bucket.

    The bucket comes back under ``bucket``; the rest are Hadoop settings.
    """
    parts = [p.strip() for p in credentials.strip().split(",")]
    if len(parts) != 5 or not all(parts[:3]):
        raise ValueError("five fields are needed: endpoint, access key, secret key, region, bucket")
    endpoint, access, secret, region, bucket = parts
    return {
        "fs.s3a.endpoint": endpoint, "fs.s3a.access.key": access, "fs.s3a.secret.key": secret, "fs.s3a.endpoint.region": region,
        "fs.s3a.path.style.access": "true", "bucket": bucket,
    }


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, line_no, line) of ``.log`` files and of single-entry ``.zip`` archives.

    Logs are read in splits of any number; a line's number is its place in the split after the lines of the splits before.
    An archive can't be split and is one value.
    """
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["file_name"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        continue  # only single-entry archives are logs
                    raw = z.read(names[0])
                lines = bytes(raw).decode("utf-8", "replace").splitlines()
                for at in range(0, len(lines), 10_000):
                    part = lines[at : at + 10_000]
                    yield pd.DataFrame({"file_name": name, "line_no": range(at + 1, at + 1 + len(part)), "line": part})

    raw = spark.read.option("pathGlobFilter", "*.log").text(folder)
    logs = raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sizes = logs.groupBy("file_name", "split").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file_name", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file_name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file_name", "split").orderBy("at"))
    numbered = logs.withColumn("nth", inside).join(before, ["file_name", "split"]).select("file_name", (F.col("before") + F.col("nth")).cast("long").alias("line_no"), "line")
    return numbered.unionByName(zips.mapInPandas(run, "file_name string, line_no long, line string"))


RESOURCE = "url string, method string, status int, headers map<string,array<string>>, final_url string, body binary, error_kind string"


def fetch(requests: DataFrame, opener=None, config: Config = Config(), timeout: float = 15.0) -> DataFrame:
    """Requests (url, method, domain) to resources, politely.

    Rows are partitioned by the last three domain levels, so that one task alone talks to a site and keeps its delay.
    ``opener(url, method, timeout)`` returns (status, headers, final_url, body) and may raise; None uses urllib.
    Redirects are not followed here: they are rows of their own.  Bodies beyond the configured size have the error kind
    ``too large`` and are not kept, and reading one takes no longer than its size allows.  A site is asked by one task, for
    its delay is the bound of its speed anyway.
    """
    from ..functions import urls

    low, high = config.politeness_ms
    # pages only, or the documents' files as well
    most = config.max_document_bytes if config.download_docs else config.max_html_bytes
    opener_ = opener or partial(_urllib, most=most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        last: dict[str, float] = {}
        call = opener_
        for pdf in batches:
            rows = []
            for url, method, site in zip(pdf["url"], pdf["method"], pdf["site"]):
                wait = last.get(site, 0) + (low + high) / 2000 - time.monotonic()
                if site in last and wait > 0 and opener is None:
                    time.sleep(wait)
                last[site] = time.monotonic()
                try:
                    status, headers, final, body = call(url, method, timeout)
                    large = body is not None and len(body) > most
                    rows.append((url, method, status, {k.lower(): v for k, v in headers.items()}, final, None if large else body, "too large" if large else None))
                except TimeoutError:
                    rows.append((url, method, None, None, None, None, "timeout"))
                except Exception as e:  # noqa: BLE001  any failure is an answer
                    rows.append((url, method, None, None, None, None, type(e).__name__))
            out = pd.DataFrame(rows, columns=["url", "method", "status", "headers", "final_url", "body", "error_kind"])
            yield out.astype({"status": "Int32"})

    site = F.coalesce(urls.top_three_levels(F.col("domain")), F.lit(""))
    return requests.select("url", "method", site.alias("site")).repartition("site").mapInPandas(run, RESOURCE)


#: Megabytes and the seconds in which so much must have been read; anything more has the last.
_BUDGET = ((50, 45), (100, 70), (200, 140), (300, 210))
_LONGEST = 330


def read_body(r, length: str | None, most: int, now=None) -> bytes:
    """The body of a response, at most one byte more than ``most``, within the time its length allows (else TimeoutError)."""
    import time

    now = now or time.monotonic
    size = int(length) if length and length.isdigit() else 0
    end = now() + next((s for mb, s in _BUDGET if size <= mb << 20), _LONGEST)
    out = bytearray()
    while len(out) <= most and (piece := r.read(min(1 << 16, most + 1 - len(out)))):
        out += piece
        if now() > end:
            raise TimeoutError
    return bytes(out)


def _urllib(url: str, method: str, timeout: float, most: int):
    import urllib.request

    class Stop(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_a, **_k):
            return None

    req = urllib.request.Request(url, method=method, headers=request_headers())
    try:
        r = urllib.request.build_opener(Stop).open(req, timeout=timeout)
    except urllib.error.HTTPError as e:
        r = e
    with r:
        return r.status, {k: r.headers.get_all(k) for k in r.headers}, r.url, read_body(r, r.headers.get("Content-Length"), most) if method == "GET" else None


def request_headers(language: bool = True) -> dict[str, str]:
    h = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:133.0) Gecko/20100101 Firefox/133.0", "Accept-Encoding": "gzip, deflate, br, zstd"}
    return h | ({"Accept-Language": "en-US,en;q=0.5"} if language else {})


def decode(body: bytes | None, encoding: str | None) -> bytes | None:
    """A body by its content encoding: none, gzip, deflate, zstd, or br if that library is there; else NULL."""
    import gzip
    import zlib

    if body is None or not encoding:
        return body
    try:
        match encoding.lower():
            case "gzip":
                return gzip.decompress(body)
            case "deflate":
                try:
                    return zlib.decompress(body)
                except zlib.error:
                    return zlib.decompress(body, -15)
            case "zstd":
                import zstandard

                return zstandard.ZstdDecompressor().decompressobj().decompress(body)
            case "br":
                import brotli

                return brotli.decompress(body)
    except Exception:  # noqa: BLE001  a broken body is no body
        return None
    return None


def decoded(resources: DataFrame) -> DataFrame:
    """Resources with bodies decoded by their ``content-encoding`` header."""

    @F.pandas_udf("binary")
    def run(body: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([decode(b, e) for b, e in zip(body, encoding)], dtype=object)

    return resources.withColumn("body", run("body", F.get(F.col("headers")["content-encoding"], F.lit(0))))


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(url, html) of stored pages, one file per page, named by its percent-encoded url, on any file system Spark reads."""
    f = spark.read.format("binaryFile").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html$", "")
    # paths come percent-encoded once more
    return f.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("url"), F.col("content").cast("string").alias("html"))


class SnapshotSource(DataSource):
    """``spark.read.format("page_snapshot").option("path", folder)``: a folder of stored pages, one file per page, that all
    executors mount; ``read_snapshot`` reads any file system.

    Files are named by their url, percent-encoded.  One input partition per thousand files.
    """

    @classmethod
    def name(cls) -> str:
        return "page_snapshot"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["path"])


class _SnapshotReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        import os

        names = sorted(os.listdir(self.path))
        return [InputPartition(names[k : k + 1000]) for k in range(0, len(names), 1000)]

    def read(self, partition):
        import os
        from urllib.parse import unquote

        for n in partition.value:
            with open(os.path.join(self.path, n), encoding="utf-8", errors="replace") as f:
                yield unquote(n.removesuffix(".html")), f.read()
