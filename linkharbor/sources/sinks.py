"""Writers: JSON lines, files of documents and pages, object stores, and a flush per batch of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators.output import json_lines

_DEFAULT = Config()


def write_json_lines(records: DataFrame, path: str, config: Config = _DEFAULT, mode: str = "append") -> None:
    """Records as JSON lines; a folder of part files that can be appended to batch by batch."""
    json_lines(records, config).write.mode(mode).text(path)


def write_stream(records: DataFrame, path: str, checkpoint: str, config: Config = _DEFAULT):
    """A stream of records flushed once per micro-batch; stopping the query keeps all flushed batches."""
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_json_lines(df, path, config)).start()


def prepare(spark, path: str, delete: bool = False) -> None:
    """Make the output folder, empty if asked."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete and fs.exists(p):
        fs.delete(p, True)
    fs.mkdirs(p)


def store_files(files: DataFrame, put: Callable[[str, bytes], str], name: str = "final_name", body: str = "body") -> DataFrame:
    """Write each file and give (seq, file_path, stored).

    ``put(name, bytes)`` stores one file anywhere (a mounted folder, an object store) and returns its location; it
    must overwrite, so that a repeated task does no harm.  A failure gives ``stored`` false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seq, n, b in zip(pdf["seq"], pdf["n"], pdf["b"]):
                try:
                    rows.append((seq, put(n, bytes(b)), True))
                except Exception:  # noqa: BLE001  a file that can't be stored is an outcome
                    rows.append((seq, None, False))
            yield pd.DataFrame(rows, columns=["seq", "file_path", "stored"])

    rows = files.filter(F.col(name).isNotNull() & F.col(body).isNotNull())
    return rows.select("seq", F.col(name).alias("n"), F.col(body).alias("b")).mapInPandas(run, "seq long, file_path string, stored boolean")


def folder_put(folder: str) -> Callable[[str, bytes], str]:
    """Store into a folder that all executors mount; the file appears whole or not at all."""

    def put(name: str, data: bytes) -> str:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return path

    return put


def object_location(endpoint: str, bucket: str, name: str) -> str:
    """Location of a stored object: endpoint/bucket/key."""
    return f"{endpoint.rstrip('/')}/{bucket}/{name}"


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as (path, html) rows, partitioned by nothing: names are unique."""
    pages.select("final_name", "html").write.mode("append").parquet(path)


def hash_stored(spark, path: str) -> DataFrame:
    """(path, file_hash, file_size) of stored files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.md5("content").alias("file_hash"), F.col("length").alias("file_size"))


def signed(method: str, host: str, path: str, headers: dict[str, str], body: bytes, access: str, secret: str, region: str, at: str) -> dict[str, str]:
    """``headers`` with those of an AWS signature, version 4, of a request without a query at the time ``at`` (yyyymmddThhmmssZ)."""
    import hashlib
    import hmac

    digest = hashlib.sha256(body).hexdigest()
    every = {**{k.lower(): v.strip() for k, v in headers.items()}, "host": host, "x-amz-content-sha256": digest, "x-amz-date": at}
    names = ";".join(sorted(every))
    request = "\n".join([method, path, "", *[f"{k}:{every[k]}" for k in sorted(every)], "", names, digest])
    scope = f"{at[:8]}/{region}/s3/aws4_request"
    key = ("AWS4" + secret).encode()
    for part in (at[:8], region, "s3", "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    text = "\n".join(["AWS4-HMAC-SHA256", at, scope, hashlib.sha256(request.encode()).hexdigest()])
    mark = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    return {**every, "authorization": f"AWS4-HMAC-SHA256 Credential={access}/{scope},SignedHeaders={names},Signature={mark}"}


def object_put(credentials: str, timeout: float = 60.0) -> Callable[[str, bytes], str]:
    """Store into the bucket of an object store with the protocol of S3, for ``store_files``.

    ``credentials`` are the five fields of ``inputs.s3_conf``.  Everything stored is a pdf (Q17); a repeated upload overwrites.
    """
    from .inputs import s3_conf

    c = s3_conf(credentials)
    endpoint, bucket = c["fs.s3a.endpoint"].rstrip("/"), c["bucket"]
    endpoint = endpoint if "://" in endpoint else "https://" + endpoint

    def put(name: str, data: bytes) -> str:
        import datetime
        import urllib.request
        from urllib.parse import quote, urlsplit

        path = f"/{quote(bucket)}/{quote(name)}"
        at = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        h = signed("PUT", urlsplit(endpoint).netloc, path, {"content-type": "application/pdf"}, data, c["fs.s3a.access.key"], c["fs.s3a.secret.key"], c["fs.s3a.endpoint.region"], at)
        with urllib.request.urlopen(urllib.request.Request(endpoint + path, data=data, method="PUT", headers=h), timeout=timeout):
            return object_location(endpoint, bucket, name)

    return put


def stop_with_statistics(spark, query, path: str) -> DataFrame:
    """Stop a running ``write_stream`` and give the statistics of all that was flushed; the batch under way is not lost but
    done again by the next start."""
    query.stop()
    return flushed_statistics(spark, path)


def flushed_statistics(spark, path: str) -> DataFrame:
    """``stats.run_statistics`` of the JSON lines written so far."""
    from ..operators import stats

    names = ("docOrDatasetUrl", "wasUrlChecked", "wasUrlValid", "wasDocumentOrDatasetAccessible", "wasDirectLink", "couldRetry", "fileHash", "error")
    m = F.from_json("value", "map<string,string>")
    target = F.coalesce(m["docOrDatasetUrl"], m["docUrl"], m["datasetUrl"])
    return stats.run_statistics(spark.read.text(path).select(target.alias("docordataseturl"), *[m[n].alias(n.lower()) for n in names[1:]]))


def stop_on_interrupt(spark, query, path: str, report: Callable[[DataFrame], None]) -> None:
    """From now on an interrupt stops the stream, and ``report`` gets the statistics of what was flushed."""
    import signal

    signal.signal(signal.SIGINT, lambda *_: report(stop_with_statistics(spark, query, path)))


def empty_bucket(spark, bucket: str) -> None:
    """Delete all objects of a bucket; never called by a pipeline."""
    prepare(spark, f"s3a://{bucket}/", delete=True)
