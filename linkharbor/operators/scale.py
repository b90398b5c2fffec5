"""Building blocks that keep hot keys from landing in one task.

* ``first_by_key``   first row of each key by an order, one partial aggregation
* ``lookup``         join rows to one row per key; hot keys by broadcast, the rest by shuffle
* ``lookup_small``   the same, with the whole other side broadcast if it was measured to be small
* ``running``        running sums per key in order, exact, in blocks of the order
* ``previous``       a value of the row before in order, in blocks of the order
* ``ranked``         a global row number without a single-task sort

``order`` columns are unique longs of rows (such as a sequence number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, materialize


def hot_share(df: DataFrame) -> int:
    """A key with more than one in so many rows is hot: a quarter of a mean partition's rows.  Fewer than so many keys can
    be hot, four per shuffle partition, so they may be broadcast."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of ``df`` that aren't NULL, with a broadcast hint."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return F.broadcast(df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n__")).filter(F.col("n__") * hot_share(df) > n).select(*keys))


def first_by_key(df: DataFrame, keys: list[str], order: str, values: list[str], last: bool = False) -> DataFrame:
    """Per key the values of the row that is first (or last) in order; NULL keys form a key of their own."""
    pick = (F.max if last else F.min)(F.struct(order, *values)).alias("first__")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"first__.{c}").alias(c) for c in (order, *values)])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has at most one row per key.  NULL keys find nothing.

    ``how`` is left, inner, left_semi or left_anti.  The hot keys of the left rows are split off and meet their row by
    broadcast; the rest are joined as the optimizer likes.  ``left`` is read three times.
    """
    hot = hot_keys(left, keys)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return left.join(hot, keys, "left_anti").join(right, keys, how).unionByName(left.join(hot, keys, "left_semi").join(few, keys, how))


def lookup_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``lookup`` into a side that is mostly small: after its rows and bytes were measured it is broadcast whole, and the
    left rows are read once and not moved.  A larger one goes through ``lookup``, with the left rows written once."""
    few = bounded(right)
    return left.join(few, keys, how) if few is not None else lookup(materialize(left), right, keys, how)


def _block(df: DataFrame, order: str, blocks: int) -> Column:
    least, most = df.agg(F.min(order).alias("x")).scalar(), df.agg(F.max(order).alias("x")).scalar()
    return F.floor((F.col(order) - least) * blocks / (most - least + 1)).cast("int")


def default_blocks(df: DataFrame) -> int:
    """Blocks that keep all tasks busy with one key: at least 256, four per shuffle partition."""
    return max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """``df`` with running sums (current row included) per key in order.

    A key's rows are cut into at most ``blocks`` blocks of equal ranges of the order (None: ``default_blocks``);
    sums of earlier blocks come from one small row per key and block, so even a key with a third of all rows is
    spread over all blocks.  NULL keys are a key of their own; NULL summands count as 0.
    """
    blocks = blocks or default_blocks(df)
    names = list(sums)
    rows = df.select("*", _block(df, order, blocks).alias("block__"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"{n}__") for n, c in sums.items()])
    per = rows.groupBy(*keys, "block__").agg(*[F.sum(f"{n}__").alias(n) for n in names])
    w = Window.partitionBy(*keys).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, "block__", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_before__") for n in names])
    inside = Window.partitionBy(*keys, "block__").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = rows.select("*", *[F.sum(f"{n}__").over(inside).alias(f"{n}_here__") for n in names]).alias("a"), before.alias("b")
    on = F.col("a.block__") == F.col("b.block__")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.`{c}`").alias(c) for c in df.columns], *[(F.col(f"{n}_here__") + F.col(f"{n}_before__")).alias(n) for n in names])


def previous(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its key, by ``order``; NULL for a key's first row.

    ``block`` is a column that rises with the order and cuts a key into pieces: inside one the row before is found by a
    window, and the first row of a piece takes the end of the piece before, from one small row per key and piece.
    """
    w = Window.partitionBy(*keys, block).orderBy(*order)
    rows = df.withColumns({"here__": F.lag(F.struct(F.col(value).alias("v"))).over(w)})
    ends = df.groupBy(*keys, block).agg(F.max(F.struct(*order, F.col(value).alias("v__"))).alias("end__"))
    ends = ends.select(*keys, block, F.lag("end__.v__").over(Window.partitionBy(*keys).orderBy(block)).alias("before__"))
    a, b = rows.alias("a"), ends.alias("b")
    on = F.lit(True)
    for k in [*keys, block]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    found = F.when(F.col("here__").isNotNull(), F.col("here__.v")).otherwise(F.col("before__"))
    return a.join(b, on).select(*[F.col(f"a.`{c}`").alias(c) for c in df.columns], found.alias(name))


def ranked(df: DataFrame, order: str, name: str = "nth", blocks: int | None = None) -> DataFrame:
    """``df`` with the row's number from 1 in ascending order, computed in blocks."""
    one = df.withColumn("all__", F.lit(1))
    return running(one, ["all__"], order, {name: F.lit(1)}, blocks).drop("all__")
