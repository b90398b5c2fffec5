"""Best representative of each duplicate group, field by field.

One aggregation per group takes, for every field, the maximum of a composite struct (priority, time, record,
value): NULLs are left out or rank lowest, then the source's priority decides, then recency, then the record.
Partial aggregation combines on the map side, so a group with a third of all rows is one row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms
from ..shared import missing, present


@dataclass(frozen=True)
class FieldRule:
    """``eligible`` says which rows may give the field (None: all), ``priority`` which of them goes first."""

    field: str
    priority: Column | None = None
    eligible: Column | None = None


def survivorship(df: DataFrame, group: Column, rules: list[FieldRule], time: str, key: str, least: int = 1) -> DataFrame:
    """One row per group: ``grp``, ``n_records`` and per rule ``<field>_pick`` (struct priority, time, key, value).

    A pick is NULL if no row is eligible.  Ties go to the latest time (NULL lowest), then the largest key.
    Groups with fewer than ``least`` rows and the NULL group are left out.  A repeated row counts as a record of its
    own; further columns of any name do no harm; an empty table gives no rows.
    """
    picks = []
    for r in rules:
        s = F.struct(
            (r.priority if r.priority is not None else F.lit(0)).cast("int").alias("priority"), F.col(time).alias("time"),
            F.col(key).alias("key"), F.col(r.field).alias("value"),
        )
        picks.append(F.max(s if r.eligible is None else F.when(r.eligible, s)).alias(f"{r.field}_pick"))
    out = df.filter(group.isNotNull()).groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n_records"), *picks)
    return out.filter(F.col("n_records") >= least)


def outcome_rules() -> list[FieldRule]:
    """Accessibility: known true, then known false, then anything; size: well formed; retry: known."""
    acc = F.col("wasdocumentordatasetaccessible")
    return [
        FieldRule("wasdocumentordatasetaccessible", F.when(acc == "true", 2).when(acc == "false", 1).otherwise(0)),
        FieldRule("filesize", eligible=forms.is_size(F.col("filesize"))),
        FieldRule("couldretry", eligible=forms.is_flag(F.col("couldretry"))),
    ]


def outcome_id() -> Column:
    """The grouping id; missing and ``unretrievable`` ids form no group."""
    return F.when(~missing(F.col("id")) & (F.col("id") != "unretrievable"), F.col("id"))


def outcome_picks(records: DataFrame) -> DataFrame:
    """(id, three record ids) for each id with two or more records; 0 where no record is eligible."""
    got = survivorship(records, outcome_id(), outcome_rules(), "logged_at", "record_id", 2)
    pick = lambda f, name: F.coalesce(F.col(f"{f}_pick.key"), F.lit(0)).alias(name)
    return got.select(
        F.col("grp").alias("id"), pick("wasdocumentordatasetaccessible", "accessible_record_id"),
        pick("filesize", "filesize_record_id"), pick("couldretry", "couldretry_record_id"),
    )


_REST = ("sourceurl", "pageurl", "docordataseturl", "wasurlchecked", "wasurlvalid", "wasdirectlink", "filehash", "mimetype", "filepath", "error")


def survivors(records: DataFrame) -> DataFrame:
    """One built record per id: the three ruled fields as above, every other text field from the latest record
    that has it (hashes and mime types only if well formed), and the number of records merged."""
    rules = outcome_rules()
    for c in _REST:
        ok = {"filehash": forms.is_hash(F.col(c)), "mimetype": forms.is_mime(F.col(c)), "docordataseturl": F.col(c).startswith("http")}.get(c, ~missing(F.col(c)))
        rules.append(FieldRule(c, eligible=ok & ~missing(F.col(c))))
    got = survivorship(records, outcome_id(), rules, "logged_at", "record_id")
    return got.select(F.col("grp").alias("id"), "n_records", *[present(F.col(f"{r.field}_pick.value")).alias(r.field) for r in rules])
