"""Session helpers: tables, shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only if it was measured and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of this machine; on a cluster the
    missing setting is an error, for a machine-local folder would be lost with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="linkharbor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _drop_written(keep: int = 0) -> None:
    for spark, path in _written[keep:]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
    del _written[keep:]


@contextmanager
def scratch():
    """Tables that ``materialize`` writes inside the block are removed at its end, for sessions that outlive many runs."""
    before = len(_written)
    try:
        yield
    finally:
        _drop_written(before)


atexit.register(_drop_written)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Used where a plan would otherwise run an expensive or non-repeatable step twice.  The table is removed
    when the Python driver ends, or at the end of a ``scratch`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/linkharbor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` with a broadcast hint if it was measured to have at most so many rows and bytes, else None (then join by
    shuffle)."""
    width = F.lit(0)
    for c in df.columns:
        width = width + 16 + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else None


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast after its rows and bytes were measured; otherwise left to the optimizer."""
    found = bounded(df, rows)
    return df if found is None else found


def missing(c: Column) -> Column:
    """True for NULL and for the text ``null``."""
    return c.isNull() | (c == "null")


def present(c: Column) -> Column:
    """The value, or NULL where it is missing."""
    return F.when(c != "null", c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: keeps expressions that use a part many times small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
