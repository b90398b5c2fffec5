"""Hidden duplicates and survivorship."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from linkharbor.llm import formatting, survivors

SPEC = formatting.SPECS[1]
COLS = "seq long, id string, url string, f long, first string, copy_key long"


def canon(u):
    if u is None or u == "null":
        return None
    strip = lambda s: re.sub(r"[\W_]", "", s.lower())
    b, _, q = u.partition("?")
    return strip(b), tuple(sorted(x for x in (strip(p) for p in q.split("&")) if x))


def brute(rows):
    first, out = {}, set()
    for seq, i, u, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        k = (i, canon(u))
        if k in first:
            out.add(("sample_input", first[k], seq))
        else:
            first[k] = seq
    return out


def writings(rng):
    base = [f"https://a.org/x{k}?b={k}&a=2&c" for k in range(40)] + [f"https://b.org/é{k}" for k in range(20)] + ["", "null", None, "?", "?&", "https://c.org/?x=1&x=1", "https://c.org/?x=1", "https://d.org/a?b?c&b"]

    def write(u):
        if u is None:
            return None
        k = rng.randrange(6)
        if k == 0:
            return u.upper() if u != "null" else u
        if k == 1:
            return " “" + u.replace("//", " // ") + "” " if u != "null" else u
        if k == 2 and "?" in u:
            b, q = u.split("?", 1)
            p = q.split("&")
            rng.shuffle(p)
            return b + "?&" + "&".join(p) + "&"
        return u + "#" if k == 3 and u != "null" else u

    return [(s, rng.choice(["i", "j", None, "I"]), write(rng.choice(base)), s, "x", -1) for s in range(600)]


@pytest.mark.parametrize("bits", [61, 4])
def test_against_brute_force(spark, bits):
    """Also with fingerprints so short that all groups are mixed up and hot."""
    rows = writings(random.Random(6))
    rows += [(None, "i", "https://a.org/x1", 0, None, 0), (700, "i", "https://e.org/" + "y" * 200_000, 0, None, 0), (701, "i", "HTTPS://e.org/" + "y" * 200_000, 0, None, 0)]
    df = spark.createDataFrame(rows, COLS).repartition(6)
    got = [tuple(r) for r in formatting.copies(df, SPEC, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_group_and_counts(spark):
    rows = [(k, "i", "https://a.org/hot" if k % 3 else f"https://a.org/{k}", 0, None, 0) for k in range(3000)]
    df = spark.createDataFrame(rows, COLS)
    assert {tuple(r) for r in formatting.copies(df, SPEC).collect()} == brute(rows)
    c = {r.first_key: r.n_copies for r in formatting.collapsed(df, SPEC).collect()}
    assert len(c) == 1001 and c[1] == 2000 and sum(c.values()) == 3000


def test_order_of_pieces_does_not_change_the_hash(spark):
    df = spark.createDataFrame([(1, "i", "h?a=1&b=2"), (2, "i", "H?B=2&A=1"), (3, "i", "h?a=1&a=1"), (4, "i", "h?a=1")], "seq long, id string, url string")
    f = {r.copy_key: r.f for r in formatting._normal(df, SPEC, 61).collect()}
    assert f[1] == f[2] and len({f[1], f[3], f[4]}) == 3


def test_empty(spark):
    df = spark.createDataFrame([], COLS)
    assert formatting.copies(df, SPEC).count() == 0 and formatting.collapsed(df, SPEC).count() == 0


REC = (
    "record_id long, logged_at timestamp, id string, wasdocumentordatasetaccessible string, filesize string, couldretry string, filehash string, grp string, n_records int, "
    "sourceurl string, pageurl string, docordataseturl string, wasurlchecked string, wasurlvalid string, wasdirectlink string, mimetype string, filepath string, error string"
)


def records(spark, rows):
    t = lambda d: None if d is None else dt.datetime(2025, 1, d)
    return spark.createDataFrame([(r[0], t(r[1]), *r[2:], None, "clash", 7, f"s{r[0]}", None, "null", "true", None, None, "bad mime", None, "null") for r in rows], REC)


def test_survivorship(spark):
    rows = [
        (1, 1, "a", "true", "10", "true"), (2, 3, "a", "false", "011", "maybe"), (3, 2, "a", "true", "20", None), (4, 2, "a", "true", None, "false"),  # ties of time go to the larger record
        (5, None, "b", "x", None, None), (6, None, "b", None, "null", "null"), (7, 1, "c", "true", "1", "true"), (8, 1, None, "true", "1", "true"), (9, 1, None, "true", "1", "true"),
        (10, 1, "null", "true", "1", "true"), (11, 1, "null", "true", "1", "true"), (12, 1, "unretrievable", "true", "1", "true"), (13, 1, "unretrievable", "true", "1", "true"),
        (14, 5, "d", "false", "5", "true"), (14, 5, "d", "false", "5", "true"), (15, None, "d", "true", "6", "true"),
    ]
    df = records(spark, rows)
    assert {tuple(r) for r in survivors.outcome_picks(df).collect()} == {("a", 4, 3, 4), ("b", 6, 0, 0), ("d", 15, 14, 14)}
    s = {r.id: r for r in survivors.survivors(df).collect()}
    assert set(s) == {"a", "b", "c", "d"} and (s["a"].n_records, s["a"].filesize, s["a"].couldretry, s["a"].sourceurl, s["a"].mimetype) == (4, "20", "false", "s2", None)
    assert survivors.outcome_picks(df.limit(0)).count() == 0
