"""Mixing sources to target weights, measured in tokens.

Tokens are summed per source; a source's repetition rate is its target tokens over its available tokens, at
most its cap.  Each text is then used floor(rate) times plus once more with probability equal to the fraction,
decided by a hash of (seed, doc_id): no coordination, no shuffle of texts, the same answer on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import lookup_small
from ..shared import materialize
from .tokens import VOCABULARY, token_counts


def unit(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def rates(tokens: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, available_tokens, rate, capped), one row per target source.

    ``total`` is the wanted size of the mixture in tokens; None: all tokens of the sources with a target.
    Sources without texts have rate 0 and count as capped if a share was wanted.  Targets with a NULL source or
    a share that isn't positive draw nothing.
    """
    have = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    j = t.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens")
    )
    size = F.lit(total) if total is not None else j.agg(F.sum("available_tokens").alias("x")).scalar()
    wish = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) * size
    want = wish / F.nullif(F.col("available_tokens"), F.lit(0))
    cap = F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double")
    return j.select("*", F.when(F.col("available_tokens") > 0, F.least(want, cap)).otherwise(0.0).alias("rate"), F.coalesce(want > cap, wish > 0).alias("capped"))


def draw(tokens: DataFrame, rate: DataFrame, seed: int = 20) -> DataFrame:
    """``tokens`` with ``uses``: how often each text is taken; 0 for sources without a target and for NULL."""
    joined = lookup_small(tokens, rate.select("source", "rate"), ["source"])  # a hot source is split off if there are too many to broadcast
    r = F.coalesce("rate", F.lit(0.0))
    once = (unit(seed, "doc_id") < r - F.floor(r)).cast("int")
    return joined.select("doc_id", "source", "n_tokens", (F.floor(r).cast("int") + once).alias("uses"))


def mix(df: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The uses of each text, and the shares reached per source.

    NULL and empty texts have no tokens and are drawn like others of their source; a NULL source draws nothing;
    repeated documents draw alike; without documents or targets nothing is drawn and all shares are 0; further
    columns do no harm.
    """
    tokens = materialize(token_counts(df, ["doc_id", "source"], path))
    rate = materialize(rates(tokens, targets, total))
    uses = draw(tokens, rate, seed)
    return uses, shares(uses, rate)


def shares(uses: DataFrame, rate: DataFrame) -> DataFrame:
    """Per target source: rate, drawn tokens, reached and target share, and whether the target was missed because
    the source is absent, too small for its cap, or crowded out (more than a percent point below)."""
    got = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("drawn_tokens"), F.sum("uses").alias("drawn_docs"), F.max("uses").alias("most_uses"))
    all_drawn = uses.agg(F.coalesce(F.sum(F.col("uses") * F.col("n_tokens")), F.lit(0)).alias("x")).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reached = F.coalesce(zero("drawn_tokens") / F.nullif(all_drawn, F.lit(0)), F.lit(0.0))
    return rate.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "available_tokens", "rate", "capped", zero("drawn_docs").alias("drawn_docs"),
        zero("most_uses").alias("most_uses"), zero("drawn_tokens").alias("drawn_tokens"), reached.alias("reached_share"),
        (F.col("capped") | (reached < F.col("target_share") - 0.01)).alias("missed"),
    )
