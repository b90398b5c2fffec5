"""Column-level data quality profile of a table that arrives in loads.

The cells of all profiled columns are unpivoted, counted per (column, value, load) before any shuffle, and
range-sorted by (column, value).  Each sorted partition turns counts into running counts; a small table of
partition totals gives every partition its prefix.  Together they are the exact cumulative curves of every
load and of all loads merged, from which come distinct counts, ranges, exact quantiles, exact
Kolmogorov-Smirnov distances and the largest gap of a single value's share.

Cost: one shuffle of pre-aggregated counts and one range shuffle of the same rows, whatever the skew: a
value that fills a third of the table is one row per load after the partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..shared import materialize, missing


@dataclass(frozen=True)
class ColumnSpec:
    """How one column is profiled.

    ``form`` says whether a non-missing cell is well formed; ``number`` makes well-formed cells sort as
    numbers; ``klass`` maps a non-missing cell to the class whose shares are compared between loads.
    """

    name: str
    form: Callable[[Column], Column] | None = None
    number: bool = False
    klass: Callable[[Column], Column] = lambda c: c


#: The four columns whose form and drift are part of the data contract.
OUTCOME_SPECS = (
    ColumnSpec("wasurlvalid", forms.is_flag),
    ColumnSpec("filehash", forms.is_hash, klass=lambda c: F.lit("present")),
    ColumnSpec("filesize", forms.is_size, number=True, klass=lambda c: F.length(c).cast("string")),
    ColumnSpec("mimetype", forms.is_mime),
)


def cells(df: DataFrame, specs: tuple[ColumnSpec, ...], load: str, key: str | None) -> DataFrame:
    """Unpivot: one row (column_name, load_id, record_id, value, is_missing, is_broken, klass) per cell.

    A column may have any name: input columns are renamed away before the fixed output names appear.
    """

    def one(s: ColumnSpec) -> Column:
        c = F.col(f"`{s.name}`").cast("string")
        gone = missing(c)
        broken = ~F.coalesce(s.form(c), F.lit(False)) & ~gone if s.form else F.lit(False)
        num = F.when(~gone & ~broken, c.try_cast("double")) if s.number else F.lit(None).cast("double")
        return F.struct(
            F.lit(s.name).alias("column_name"), F.when(~gone, c).alias("value"), gone.alias("is_missing"),
            F.coalesce(broken, F.lit(False)).alias("is_broken"), num.alias("num"), F.when(~gone, s.klass(c)).alias("klass"),
        )

    return df.select(
        F.col(f"`{load}`").alias("load_id"),
        (F.col(f"`{key}`") if key else F.lit(0)).cast("bigint").alias("record_id"),
        F.inline(F.array(*[one(s) for s in specs])),
    )


def violations(df: DataFrame, specs: tuple[ColumnSpec, ...], load: str, key: str) -> DataFrame:
    """(load_id, column_name, record_id, value) of each non-missing cell that is not of its form; no shuffle."""
    return cells(df, specs, load, key).filter("is_broken").select("load_id", "column_name", "record_id", "value")


_CURVE = "column_name string, is_missing boolean, num double, value string, load_id long, cnt long, value_cnt long, broken long, pid int, run_all long, run_load long"


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running counts inside one sorted partition, carried over its batches."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    seen_all: dict[str, int] = {}
    seen_load: dict[tuple[str, int | None], int] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        names, cnt = pdf["column_name"].to_numpy(), pdf["cnt"].to_numpy(dtype="int64")
        step = np.where(pdf["first_of_value"], pdf["value_cnt"], 0).astype("int64")
        # a NULL load is a load of its own
        codes, loads = pd.factorize(pdf["load_id"].astype("Int64"), use_na_sentinel=False)
        loads = [None if pd.isna(x) else int(x) for x in loads]
        run_all, run_load = np.empty(len(pdf), "int64"), np.empty(len(pdf), "int64")
        edges = np.flatnonzero(names[1:] != names[:-1]) + 1  # rows are sorted by column
        for lo, hi in zip([0, *edges], [*edges, len(pdf)]):
            name = names[lo]
            run_all[lo:hi] = np.cumsum(step[lo:hi]) + seen_all.get(name, 0)
            seen_all[name] = int(run_all[hi - 1])
            for k in np.unique(codes[lo:hi]):
                at = lo + np.flatnonzero(codes[lo:hi] == k)
                run_load[at] = np.cumsum(cnt[at]) + seen_load.get((name, loads[k]), 0)
                seen_load[name, loads[k]] = int(run_load[at[-1]])
        yield pdf.drop(columns="first_of_value").assign(pid=pid, run_all=run_all, run_load=run_load)


def curves(df: DataFrame, specs: tuple[ColumnSpec, ...], load: str, by_class: bool = False) -> DataFrame:
    """Merged cumulative curves: one row per (column, value, load) that occurs, missing sorting first.

    ``cum_load`` and ``cum_all`` are the counts up to and including the value in the load and in all loads,
    ``value_cnt`` the value's count in all loads, ``n_load`` and ``n_all`` the totals.  ``by_class`` takes
    the compared classes instead of the raw values.
    """
    spark = df.sparkSession
    c = cells(df, specs, load, None)
    if by_class:
        c = c.withColumn("value", F.col("klass")).withColumn("num", F.lit(None).cast("double"))
    counted = c.groupBy("column_name", "is_missing", "num", "value", F.col("load_id").cast("long").alias("load_id")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col("is_broken").cast("long")).alias("broken")
    )
    order = ["column_name", "is_missing", "num", "value"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col("column_name").asc(), F.col("is_missing").desc(), F.col("num").asc(), F.col("value").asc()]
    # equal (column, value) rows meet in one range, so both windows reuse the range partitioning
    same = Window.partitionBy(*order)
    local = (
        counted.repartitionByRange(parts, *sort)
        .withColumn("value_cnt", F.sum("cnt").over(same))
        .withColumn("first_of_value", F.row_number().over(same.orderBy("load_id")) == 1)
        .sortWithinPartitions(*sort, F.col("load_id"))
        .select(*order, "load_id", "cnt", "value_cnt", "broken", "first_of_value")
        .mapInPandas(_running, _CURVE)
    )
    local = materialize(local)
    before = Window.partitionBy("column_name", "load_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per_load = local.groupBy("column_name", "load_id", "pid").agg(F.sum("cnt").alias("here"))
    per_load = per_load.select(
        "column_name", "load_id", "pid", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before_load"),
        F.sum("here").over(Window.partitionBy("column_name", "load_id")).alias("n_load"),
    )
    before_all = Window.partitionBy("column_name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per_all = local.groupBy("column_name", "pid").agg(F.sum("cnt").alias("here"))
    per_all = per_all.select(
        "column_name", "pid", F.coalesce(F.sum("here").over(before_all), F.lit(0)).alias("before_all"),
        F.sum("here").over(Window.partitionBy("column_name")).alias("n_all"),
    )
    a, b, c2 = local.alias("a"), per_load.alias("b"), per_all.alias("c")
    return (
        a.join(b, (F.col("a.column_name") == F.col("b.column_name")) & F.col("a.load_id").eqNullSafe(F.col("b.load_id")) & (F.col("a.pid") == F.col("b.pid")))
        .join(c2, (F.col("a.column_name") == F.col("c.column_name")) & (F.col("a.pid") == F.col("c.pid")))
        .select(
            "a.column_name", "a.is_missing", "a.num", "a.value", "a.load_id", "a.cnt", "a.value_cnt", "a.broken",
            (F.col("run_load") + F.col("before_load")).alias("cum_load"), (F.col("run_all") + F.col("before_all")).alias("cum_all"),
            "n_load", "n_all",
        )
    )


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def ks_gaps() -> Column:
    """Per row of the merged curves the larger of the two gaps between the load's curve and that of all other loads: at
    the value, and just before it.  Between two values of a load its curve is flat and the other one only rises, so the
    largest of these gaps is the exact Kolmogorov-Smirnov distance.  NULL if there is no other load."""
    n, rest = F.col("n_load"), F.nullif(F.col("n_all") - F.col("n_load"), F.lit(0))
    gap = F.abs(F.col("cum_load") / n - (F.col("cum_all") - F.col("cum_load")) / rest)
    prior = F.abs((F.col("cum_load") - F.col("cnt")) / n - (F.col("cum_all") - F.col("value_cnt") - F.col("cum_load") + F.col("cnt")) / rest)
    return F.greatest(gap, prior)


def shifts(curve: DataFrame, points: int = 15) -> DataFrame:
    """(load_id, column_name) where some value's share in the load is more than ``points`` percent points off
    its share in all other loads together.

    A value's share is the step of a curve at it, and two steps can't be further apart than twice the largest gap of the
    curves: only loads whose Kolmogorov-Smirnov distance exceeds half the points are looked at.  There the steps
    decide, in exact integer arithmetic.  Only values that hold more than ``points`` percent of some load or of some
    rest can differ that much, at most 200/points per load, so pairing these with the loads of the column (also those
    where the value is absent) stays small.
    """
    apart = curve.groupBy("column_name", "load_id", "n_load", "n_all").agg(F.max(ks_gaps()).alias("ks"))
    # a hair below the bound, for the gaps are floating-point numbers
    far = apart.filter(F.col("ks") * 2 > points / 100 - 1e-9).drop("ks")
    loads = apart.drop("ks")
    most = loads.groupBy("column_name").agg(F.max("n_load").alias("most"))
    value = ["column_name", "is_missing", "num", "value"]
    heavy = (
        curve.join(most, "column_name")
        .filter((F.col("cnt") * 100 > F.col("n_load") * points) | (F.col("value_cnt") * 100 > (F.col("n_all") - F.col("most")) * points))
        .select(*value, "value_cnt").distinct()
    )
    h, p, k = heavy.alias("h"), far.alias("p"), curve.alias("k")
    here = F.coalesce(F.col("k.cnt"), F.lit(0))
    n, rest = _wide(F.col("p.n_load")), _wide(F.col("p.n_all") - F.col("p.n_load"))
    return (
        h.join(p, "column_name").select("h.*", "p.load_id", "p.n_load", "p.n_all").alias("p")
        .join(k, (F.col("p.column_name") == F.col("k.column_name")) & F.col("p.is_missing").eqNullSafe(F.col("k.is_missing")) & F.col("p.num").eqNullSafe(F.col("k.num")) & F.col("p.value").eqNullSafe(F.col("k.value")) & F.col("p.load_id").eqNullSafe(F.col("k.load_id")), "left")
        .filter(F.col("p.n_all") > F.col("p.n_load"))
        .filter(F.abs(_wide(here) * rest - _wide(F.col("p.value_cnt") - here) * n) * 100 > n * rest * points)
        .select(F.col("p.load_id").alias("load_id"), F.col("p.column_name").alias("column_name")).distinct()
    )


def found(df: DataFrame, specs: tuple[ColumnSpec, ...] = OUTCOME_SPECS, load: str = "load_id", key: str = "record_id", points: int = 15) -> DataFrame:
    """Findings of a profile: each malformed cell, and each load and column whose distribution shifted.

    A missing cell (NULL or ``null``) is never malformed and is one value of its own in the shares; an empty text is
    malformed.  A NULL load is a load.  A single load shifts from nothing.  Repeated rows count as rows; cells of any
    length are compared whole; further columns do no harm; an empty table gives no rows.
    """
    bad = violations(df, specs, load, key).select(F.lit("violation").alias("finding"), F.col("load_id").cast("int").alias("load_id"), "column_name", "record_id")
    moved = shifts(curves(df, specs, load, by_class=True), points)
    return bad.unionByName(moved.select(F.lit("shift").alias("finding"), F.col("load_id").cast("int").alias("load_id"), "column_name", F.lit(0).cast("bigint").alias("record_id")))


def profile(df: DataFrame, specs: tuple[ColumnSpec, ...] = OUTCOME_SPECS, load: str = "load_id") -> DataFrame:
    """One row per column and load: rows, missing, rates, distinct count, range, exact quartiles, malformed
    cells and the exact Kolmogorov-Smirnov distance to all other loads (NULL if there is no other).

    Number columns range over well-formed numbers; malformed text sorts before them.  Quantiles are the
    smallest value whose rank reaches ceil(q * non-missing rows).  An empty table gives no rows.
    """
    c = curves(df, specs, load)
    c = c.withColumn("ks", ks_gaps())
    per = c.groupBy("column_name", "load_id").agg(
        F.max("n_load").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("is_missing"), F.col("cnt"))), F.lit(0)).alias("n_missing"),
        F.count(F.when(~F.col("is_missing"), 1)).alias("n_distinct"),
        F.sum("broken").alias("n_malformed"), F.min("num").alias("min_number"), F.max("num").alias("max_number"), F.max("ks").alias("ks_distance"),
    )
    k, p = c.alias("k"), per.select("column_name", "load_id", "n_rows", "n_missing").alias("p")
    at = k.join(p, (F.col("k.column_name") == F.col("p.column_name")) & F.col("k.load_id").eqNullSafe(F.col("p.load_id"))).filter(~F.col("is_missing"))
    # the curve names the value at any rank: of all rows only those that hold a wanted rank go on
    n_here = F.col("n_rows") - F.col("n_missing")
    ranks = {"min_value": F.lit(1), "q25": F.ceil(n_here * F.lit(0.25)), "q50": F.ceil(n_here * F.lit(0.5)), "q75": F.ceil(n_here * F.lit(0.75)), "max_value": n_here}
    holds = {name: (F.col("cum_load") - F.col("cnt") < F.col("n_missing") + r) & (F.col("n_missing") + r <= F.col("cum_load")) for name, r in ranks.items()}
    some = F.lit(False)
    for x in holds.values():
        some = some | x
    picks = at.filter(some).groupBy(F.col("k.column_name").alias("column_name"), F.col("k.load_id").alias("load_id"))
    picks = picks.agg(*[F.max(F.when(x, F.col("k.value"))).alias(name) for name, x in holds.items()])
    p, q = per.alias("p"), picks.alias("q")
    return p.join(q, (F.col("p.column_name") == F.col("q.column_name")) & F.col("p.load_id").eqNullSafe(F.col("q.load_id")), "left").select(
        "p.column_name", F.col("p.load_id").cast("int").alias("load_id"), "n_rows", "n_missing", (F.col("n_missing") / F.col("n_rows")).alias("missing_rate"),
        "n_distinct", "min_value", "max_value", "min_number", "max_number", "q25", "q50", "q75", "n_malformed", "ks_distance",
    )
