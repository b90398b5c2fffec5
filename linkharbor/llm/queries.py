"""Queries of problems 3, 4, 5, 7, 8 and 9, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table
from . import cuckoo, formatting, mixing, packing, residue, survivors
from .sql import SQL

__all__ = ["QUERIES", "SQL"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cuckoo.seen_before(table(spark, d, "output_record"), table(spark, d, "earlier_key"))


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return cuckoo.error_rate(table(spark, d, "output_record"), table(spark, d, "earlier_key"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (formatting.copies(table(spark, d, s.name), s) for s in formatting.SPECS)
    return a.unionByName(b)


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    a, b = (formatting.collapsed(table(spark, d, s.name), s) for s in formatting.SPECS)
    return a.unionByName(b)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.outcome_picks(table(spark, d, "output_record"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "output_record"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_spec"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_spec")
    return packing.containers(packing.pack(table(spark, d, "documents"), specs), specs)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_spec")
    return packing.summary(packing.pack(table(spark, d, "documents"), specs), specs)


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.flagged(table(spark, d, "documents"), table(spark, d, "sample_input")).select("doc_id")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return residue.cleaned(table(spark, d, "documents"), table(spark, d, "sample_input")).select("doc_id", "source", "n_chars")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents per kind of evidence; a document may have several."""
    got = residue.evidence(table(spark, d, "documents"), table(spark, d, "sample_input"))
    return got.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_error_rate, p4_found, p4_collapsed, p5_found, p5_survivors, p7_packing, p7_containers, p7_summary, p8_uses, p8_shares, p9_found, p9_cleaned, p9_kinds,
    )
}
