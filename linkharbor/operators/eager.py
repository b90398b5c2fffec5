"""Totals per key and joins on keys where a few keys hold most rows.

Nothing here ever gathers the rows of a key: both inputs are reduced to one compact state per key before
anything is joined, and the algebra of the states stands in for the joined rows (a key with m left and n
right rows has m*n joined rows; a left sum appears n times).  The work of a key is therefore one row per map
task, however many rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms
from ..shared import missing


def compact(df: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """One state per key: ``n`` rows, ``counts`` of true conditions and ``sums`` (0 for NULL)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(F.when(c, 1)).alias(k) for k, c in (counts or {}).items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (sums or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def eager_join(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], how: str = "inner") -> DataFrame:
    """Join two compact states (columns ``n`` and values) and combine them algebraically.

    Gives the keys, ``n`` (left rows), ``right_n``, ``joined_n`` = n * right_n, each left value, and each
    value as it would be summed over the joined rows: ``joined_<value>``.  NULL keys never match.  With
    ``how='left'`` unmatched keys have right_n 0 and joined_n 0.
    """
    l, r = left.alias("l"), right.alias("r")
    on = F.col(f"l.{keys[0]}") == F.col(f"r.{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    n, m = F.col("l.n"), F.coalesce(F.col("r.n"), F.lit(0))
    return l.join(r, on, how).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], n.alias("n"), m.alias("right_n"), (n * m).alias("joined_n"),
        *[F.col(f"l.{v}").alias(v) for v in left_values],
        *[(F.col(f"l.{v}") * m).alias(f"joined_{v}") for v in left_values],
        *[(F.coalesce(F.col(f"r.{v}"), F.lit(0)) * n).alias(f"joined_{v}") for v in right_values],
    )


def roll_up(joined: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Coarser totals of joined states."""
    return joined.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def outcome_states(records: DataFrame) -> DataFrame:
    """Compact states of outcome records per value of ``sourceurl`` and of ``docordataseturl``.

    (field_name, key_value, n, found_n, total_size): rows, rows with an accessible document or dataset, and
    the sum of well-formed sizes.  Missing values have no state; sentinels do.
    """
    found = (F.col("wasdocumentordatasetaccessible") == "true") & F.col("docordataseturl").startswith("http")
    pairs = records.select(
        found.alias("found"), forms.size_value(F.col("filesize")).alias("size"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in ("sourceurl", "docordataseturl")])),
    ).filter(~missing(F.col("key_value")))
    return compact(pairs, ["field_name", "key_value"], sums={"total_size": F.col("size")}, counts={"found_n": F.col("found")})


def requests(inputs: DataFrame, earlier: DataFrame) -> DataFrame:
    """(field_name, key_value) of what was asked for: the urls of input pairs and the urls met earlier."""
    asked = inputs.select(F.lit("sourceurl").alias("field_name"), F.col("url").alias("key_value"))
    met = earlier.filter(F.col("key_kind") == "url").select(F.lit("docordataseturl").alias("field_name"), F.col("key_value"))
    return asked.unionByName(met).filter(~missing(F.col("key_value")))


def _totals(outcomes: DataFrame, asked: DataFrame) -> DataFrame:
    j = eager_join(outcomes, asked, ["field_name", "key_value"], ["found_n", "total_size"], [], "left")
    return j.withColumn("found_share", F.col("found_n") / F.col("n"))


def totals(records: DataFrame, inputs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Totals per value: rows, found share, summed sizes, requests, and the size of the joined result.

    Missing values have no totals, an empty text has; malformed sizes add nothing; repeated rows count as rows;
    values without requests have 0; further columns do no harm; an empty table gives no rows.
    """
    return _totals(outcome_states(records), compact(requests(inputs, earlier), ["field_name", "key_value"]))


def hot(records: DataFrame, inputs: DataFrame, earlier: DataFrame, percent: int = 1) -> DataFrame:
    """``totals`` of the values that hold more than ``percent`` percent of all rows of ``records``, missing values among
    these rows.

    A value can only qualify if its own state says so, which leaves fewer than 100/percent states a field to join; of the
    requests only those of these values (broadcast, by that bound) are reduced to states.  An empty table gives no rows.
    """
    n_rows = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    heavy = outcome_states(records).filter(F.col("n") * 100 > n_rows * percent)
    asked = requests(inputs, earlier).join(F.broadcast(heavy.select("field_name", "key_value")), ["field_name", "key_value"], "left_semi")
    return _totals(heavy, compact(asked, ["field_name", "key_value"]))
