from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linkharbor.operators import profile

SCHEMA = "record_id long, load_id int, wasurlvalid string, filehash string, filesize string, mimetype string, finding string, value string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)  # two further columns whose names clash with outputs


def test_forms(spark):
    h = "a" * 32
    rows = [
        (1, 1, "true", h, "1", "text/csv"), (2, 1, "TRUE", h.upper(), "0", "Text/csv"), (3, 1, "", h + "\n", "536870913", "/csv"), (4, 1, None, None, None, None),
        (5, 1, "null", "null", "null", "null"), (6, 1, "false", h[:31], "01", "unspecified"), (7, 1, "true ", h + "a", "１", "a/" + "b" * 254), (8, 1, "true", h, "536870912", "a/" + "b" * 253),
    ]
    got = {(r.column_name, r.record_id) for r in profile.violations(make(spark, rows), profile.OUTCOME_SPECS, "load_id", "record_id").collect()}
    bad = lambda c, *k: {(c, x) for x in k}
    assert got == bad("wasurlvalid", 2, 3, 7) | bad("filehash", 2, 3, 6, 7) | bad("filesize", 2, 3, 6, 7) | bad("mimetype", 2, 3, 7)


def test_shift_counts_missing_and_absent_values(spark):
    rows, k = [], 0
    for load in (1, 2, 3):
        for i in range(20):
            k += 1
            # load 3 lacks 'false' altogether; a share of exactly 15 points is no shift
            flag = "true" if load == 3 else ("false" if i < 6 else "true")
            rows.append((k, load, flag, None, "5", "a/b" if i < (3 if load == 1 else 0) else "c/d"))
    got = {(r.finding, r.load_id, r.column_name, r.record_id) for r in profile.found(make(spark, rows)).collect()}
    # valid: load 1 has 6/20 false against 6/40, exactly 15 points; load 3 has 0 against 12/40
    assert got == {("violation", x, "x", 0) for x in ()} | {("shift", 3, "wasurlvalid", 0)}


def brute(pdf: pd.DataFrame, col: str):
    out = {}
    key = pdf[col].where(pdf[col].notna() & (pdf[col] != "null"))
    vals = sorted(key.dropna().unique())
    rank = {v: i + 1 for i, v in enumerate(vals)}
    r = key.map(rank).fillna(0).astype(int)
    for load in sorted(pdf.load_id.unique()):
        a, b = r[pdf.load_id == load], r[pdf.load_id != load]
        grid = np.arange(0, len(vals) + 1)
        ks = max(abs((a.to_numpy()[:, None] <= grid).mean(0) - (b.to_numpy()[:, None] <= grid).mean(0))) if len(b) else None
        v = sorted(key[pdf.load_id == load].dropna())
        q = lambda p: v[int(np.ceil(len(v) * p)) - 1] if v else None  # noqa: B023, E731
        out[load] = (len(a), int((a == 0).sum()), len(set(v)), v[0] if v else None, v[-1] if v else None, q(0.25), q(0.5), q(0.75), ks)
    return out


def test_profile_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        load = int(rng.integers(1, 4))
        hot = rng.random() < 0.4
        h = "hot" if hot else f"v{int(rng.integers(0, 60 + 40 * load)):03d}"
        rows.append((k, load, None if rng.random() < 0.2 else h, "null" if rng.random() < 0.1 else h[::-1], "5", "a/b"))
    df = make(spark, rows).repartition(5)
    got = profile.profile(df).collect()
    pdf = df.toPandas()
    for col in ("wasurlvalid", "filehash"):
        want = brute(pdf, col)
        for r in [x for x in got if x.column_name == col]:
            w = want[r.load_id]
            assert (r.n_rows, r.n_missing, r.n_distinct, r.min_value, r.max_value, r.q25, r.q50, r.q75) == w[:8]
            assert abs(r.ks_distance - w[8]) < 1e-12


def test_null_load_single_load_and_empty(spark):
    rows = [(1, None, "true", None, "7", "a/b"), (2, None, "maybe", None, "9", "a/b")]
    df = make(spark, rows)
    assert [(r.finding, r.load_id, r.record_id) for r in profile.found(df).collect()] == [("violation", None, 2)]
    p = {r.column_name: r for r in profile.profile(df).collect()}
    assert p["filesize"].load_id is None and p["filesize"].min_number == 7 and p["filesize"].ks_distance is None and p["filehash"].n_missing == 2
    both = make(spark, rows + [(3, 1, "false", None, "7", "a/b")])
    assert {(r.load_id, r.column_name) for r in profile.found(both).filter("finding = 'shift'").collect()} == {(None, "wasurlvalid"), (1, "wasurlvalid"), }
    assert profile.found(df.limit(0)).count() == 0 and profile.profile(df.limit(0)).count() == 0


def test_numbers_sort_as_numbers(spark):
    rows = [(k, 1, "true", None, v, "a/b") for k, v in enumerate(["9", "10", "100", "x"])]
    r = [x for x in profile.profile(make(spark, rows)).collect() if x.column_name == "filesize"][0]
    assert (r.min_number, r.max_number, r.max_value, r.n_malformed) == (9, 100, "100", 1)


def test_very_long_value(spark):
    rows = [(1, 1, "t" * 300_000, None, "9" * 100_000, "a/" + "b" * 100_000)]
    got = {(r.column_name) for r in profile.found(make(spark, rows)).collect()}
    assert got == {"wasurlvalid", "filesize", "mimetype"}


def test_no_single_task_window_over_values(spark):
    """Windows over values reuse the range partitioning."""
    df = make(spark, [(1, 1, "true", None, "5", "a/b")])
    plan = profile.curves(df, profile.OUTCOME_SPECS, "load_id")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert F is not None
