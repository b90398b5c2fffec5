"""Duplicates hidden by formatting differences.

Each compared url becomes a multiset of normalized pieces: its part before the first ``?`` and its query
parameters, each without letter case and without characters that are neither letter nor digit.  Every (field
name, piece) pair is hashed and the hashes are added modulo 2^61 - 1: the sum does not depend on order, so
nothing is sorted.  Records with one fingerprint are candidates and are verified piece by piece against the
first record of their group; what a collision brought together is told apart by the fields themselves.

Scale: the normalized rows are written once.  Groups that hold more than a quarter of a mean partition's rows (fewer than
four per partition) get their first record by broadcast; all other rows meet theirs in one shuffle, streaming past
it, so no group is ever held in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import hot_keys
from ..shared import materialize, present

PRIME = (1 << 61) - 1


@dataclass(frozen=True)
class TableSpec:
    """Which table, its key, fields compared exactly, and url fields compared by pieces."""

    name: str
    key: str
    exact: tuple[str, ...]
    urls: tuple[str, ...]


SPECS = (TableSpec("output_record", "record_id", ("id",), ("sourceurl", "pageurl")), TableSpec("sample_input", "seq", ("id",), ("url",)))


def clean(c: Column) -> Column:
    """Lower case, letters, digits, and the ``?`` and ``&`` that part the url; a missing url is NULL."""
    return F.lower(F.regexp_replace(present(c), r"[^\p{L}\p{Nd}?&]+", ""))


def base(cleaned: Column) -> Column:
    """The part before the first ``?``."""
    return F.replace(F.substring_index(cleaned, "?", 1), F.lit("&"), F.lit(""))


def parameters(cleaned: Column) -> Column:
    """The parameters that aren't empty, in the order written."""
    rest = F.replace(F.substring(cleaned, F.instr(cleaned, "?") + 1, F.length(cleaned)), F.lit("?"), F.lit(""))
    none = F.array().cast("array<string>")
    return F.when(cleaned.isNull() | (F.instr(cleaned, "?") == 0), none).otherwise(F.filter(F.split(rest, "&"), lambda x: x != ""))


def _fingerprint(spec: TableSpec, bits: int) -> Column:
    """Commutative multiset hash of all (field name, piece) pairs."""
    hashed = lambda *x: F.xxhash64(*x).bitwiseAND(PRIME)
    total = hashed(F.lit("exact"), *[F.struct(F.col(x)) for x in spec.exact])
    for x in spec.urls:
        c = F.col(x)
        total = (total + hashed(F.lit(x), F.lit("base"), base(c))) % PRIME

        def add(acc: Column, piece: Column, name: str) -> Column:
            return (acc + hashed(F.lit(name), piece)) % PRIME

        many = F.aggregate(parameters(c), F.lit(0).cast("bigint"), lambda acc, p: add(acc, p, x))  # noqa: B023
        total = (total + F.when(F.instr(c, "?") > 0, many).otherwise(0)) % PRIME
    return total.bitwiseAND((1 << bits) - 1) if bits < 61 else total


def _normal(df: DataFrame, spec: TableSpec, bits: int) -> DataFrame:
    """(copy_key, the compared fields, f), written once; ``bits`` < 61 shortens fingerprints, for tests."""
    rows = df.filter(F.col(spec.key).isNotNull()).select(
        F.col(spec.key).cast("bigint").alias("copy_key"), *[F.col(x).alias(x) for x in spec.exact], *[clean(F.col(x)).alias(x) for x in spec.urls]
    )
    return materialize(rows.withColumn("f", _fingerprint(spec, bits)))


def _same_pieces(a: Column, b: Column) -> Column:
    """Equality of two cleaned urls: at once if written alike, else as multisets of pieces, which are sorted only
    where pieces repeat."""
    x, y = parameters(a), parameters(b)
    sets = (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    multi = (F.size(x) == F.size(y)) & sets & ((F.size(F.array_distinct(x)) == F.size(x)) | (F.array_sort(x) == F.array_sort(y)))
    return F.when(a.eqNullSafe(b), True).when(a.isNull() | b.isNull(), False).otherwise((base(a) == base(b)) & multi)


def members(df: DataFrame, spec: TableSpec, bits: int = 61) -> DataFrame:
    """(first_key, copy_key) of every row that is a verified copy of an earlier one.

    Rows without a key are left out; NULL fields, and the text ``null`` in a url, equal each other; an empty url
    equals any url of punctuation only; urls of any length are compared whole.  Keys are unique.  Tables may have
    any further columns; an empty table gives no rows.
    """
    fields = [*spec.exact, *spec.urls]
    rows = _normal(df, spec, bits)
    hot = hot_keys(rows, ["f"])
    record = F.struct("copy_key", *fields)
    # a group's rows stream past its first; nothing but that first is kept
    w = Window.partitionBy("f").orderBy("copy_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = rows.join(hot, "f", "left_anti").withColumn("first", F.first(record).over(w))
    of_hot = rows.join(hot, "f")
    heads = of_hot.groupBy("f").agg(F.min("copy_key").alias("copy_key"))
    firsts = F.broadcast(of_hot.join(F.broadcast(heads), ["f", "copy_key"]).select("f", record.alias("first")))
    both = cold.unionByName(of_hot.join(firsts, "f")).filter(F.col("copy_key") != F.col("first.copy_key"))
    ok = F.lit(True)
    for x in spec.exact:
        ok = ok & F.col(x).eqNullSafe(F.col(f"first.{x}"))
    for x in spec.urls:
        ok = ok & _same_pieces(F.col(x), F.col(f"first.{x}"))
    parts = [F.to_json(F.array(F.col(x))) for x in spec.exact] + [F.to_json(F.struct(base(F.col(x)).alias("b"), F.array_sort(parameters(F.col(x))).alias("q"))) for x in spec.urls]
    got = both.select("copy_key", F.col("first.copy_key").alias("first_key"), F.when(~ok, F.concat_ws("\n", *parts)).alias("lost"))
    got = materialize(got)
    right = got.filter("lost is null").select("first_key", "copy_key")
    # rows whose fingerprint collided with another record's: grouped by the fields themselves
    lost = got.filter("lost is not null")
    heads = lost.groupBy("lost").agg(F.min("copy_key").alias("first_key"))
    return right.unionByName(lost.select("copy_key", "lost").join(heads, "lost").filter("copy_key <> first_key").select("first_key", "copy_key"))


def copies(df: DataFrame, spec: TableSpec, bits: int = 61) -> DataFrame:
    """(table_name, first_key, copy_key) of each copy but the first of its group."""
    return members(df, spec, bits).select(F.lit(spec.name).alias("table_name"), "first_key", "copy_key")


def collapsed(df: DataFrame, spec: TableSpec, bits: int = 61) -> DataFrame:
    """(table_name, first_key, n_copies): one row per record after collapsing, unique ones with 1."""
    more = copies(df, spec, bits)
    extra = more.groupBy("first_key").agg(F.count(F.lit(1)).alias("extra"))
    kept = df.filter(F.col(spec.key).isNotNull()).select(F.col(spec.key).cast("bigint").alias("first_key"))
    kept = kept.join(more.select(F.col("copy_key").alias("first_key")), "first_key", "left_anti")
    return kept.join(extra, "first_key", "left").select(F.lit(spec.name).alias("table_name"), "first_key", (F.coalesce("extra", F.lit(0)) + 1).alias("n_copies"))
