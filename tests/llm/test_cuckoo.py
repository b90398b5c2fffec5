from __future__ import annotations

import numpy as np
import pytest

from linkharbor.llm import cuckoo

REC = "record_id long, docordataseturl string, filehash string, ord long, seen boolean"
EARLY = "key_kind string, key_value string, h long"
H = "0123456789abcdef" * 2


def test_no_key_is_forgotten_while_growing():
    s, rng = cuckoo.CuckooStore(4), np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 60_000)
    for k in range(0, len(keys), 997):
        s.insert(keys[k : k + 997])
        assert s.contains(keys[: k + 997]).all()
    assert len(s.tables) > 5 and s.used_bytes() < 60_000 * 2 * 4
    other = rng.integers(-(1 << 62), 1 << 62, 200_000)
    assert s.contains(other).mean() < len(s.tables) * 8 / 65536 * 1.5


def test_asking_forgets_no_key():
    """Batches larger than the tables, growths inside a batch, keys that share a fingerprint."""
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, 1_000_000)
    s, new = cuckoo.CuckooStore(64), 0
    for k in range(0, len(keys), 100_000):
        new += int((~s.ask(keys[k : k + 100_000])).sum())
    assert s.contains(keys).all() and new > len(keys) * 0.99
    one = cuckoo.CuckooStore(1 << 10)
    one.ask(keys)
    assert len(one.tables) > 5 and one.contains(keys).all() and one.ask(keys).all()


def test_fill_and_delete():
    t = cuckoo.CuckooStore(1 << 10)
    keys = np.arange(3800, dtype=np.int64) * 7919
    t.insert(keys)
    assert len(t.tables) == 1 and t.tables[0].size + sum(t.stash.values()) == 3800
    assert all(t.delete(int(k)) for k in keys[:1900]) and t.contains(keys[1900:]).all()
    assert t.contains(keys[:1900]).mean() < 0.01
    again = cuckoo.CuckooStore.load(t.dump(), t.stash)
    assert again.contains(keys[1900:]).all() and not cuckoo.CuckooStore().delete(5)


def test_arrivals_in_a_batch_are_in_order():
    s = cuckoo.CuckooStore(16)
    assert s.ask(np.array([5, 6, 5, 7, 6, 5], dtype=np.int64)).tolist() == [False, False, True, False, True, True]
    assert s.ask(np.array([], dtype=np.int64)).tolist() == []


def brute(rows, early):
    known = {(k, v) for k, v, *_ in early if k in ("url", "hash") and v is not None}
    out, met = set(), set()
    for i, u, h, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        keys = []
        if u is not None and u.startswith("http"):
            keys.append(("docordataseturl", "url", u))
        if h is not None and len(h) == 32 and set(h) <= set("0123456789abcdef"):
            keys.append(("filehash", "hash", h))
        for f, kind, v in keys:
            if (kind, v) in known or (f, v) in met:
                out.add((i, f))
        met |= {(f, v) for f, _, v in keys}
    return out


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_exact_against_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(int(k) * 3, "http://hot" if rng.random() < 0.4 else f"http://u{rng.integers(0, 300)}", None if rng.random() < 0.3 else f"{rng.integers(0, 200):032x}", 1, True) for k in rng.permutation(800)]
    rows += [(5000, None, None, None, None), (5001, "unreachable", "null", 1, None), (5002, "HTTP://x", H.upper(), 1, None), (None, "http://hot", H, 1, None), (5003, "http://" + "x" * 200_000, H + "\n", 1, None)]
    early = [("url", "http://u1", 1), ("url", "http://u1", 2), ("hash", "http://u2", 3), ("hash", f"{7:032x}", 4), (None, "http://u3", 5), ("url", None, 6), ("odd", "http://u4", 7)]
    r, e = spark.createDataFrame(rows, REC).repartition(5), spark.createDataFrame(early, EARLY)
    assert {tuple(x) for x in cuckoo.seen_before(r, e, blocks).collect()} == brute(rows, early)


def test_wrong_answers_are_audited(spark, monkeypatch):
    """With a hash of a few values nearly all answers are wrong, and the result is still exact."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(cuckoo, "key_hash", lambda *c: F.pmod(F.xxhash64(*c), F.lit(9)))
    rows = [(k, f"http://u{k % 60}", None, 1, True) for k in range(200)]
    early = [("url", "http://u5", 1)]
    r, e = spark.createDataFrame(rows, REC), spark.createDataFrame(early, EARLY)
    assert {tuple(x) for x in cuckoo.seen_before(r, e).collect()} == brute(rows, early)
    rate = cuckoo.error_rate(r, e).collect()[0]
    assert rate.new_keys == 59 and rate.wrong_seen >= 50 and rate.error_rate == rate.wrong_seen / 59


def test_empty(spark):
    r, e = spark.createDataFrame([], REC), spark.createDataFrame([], EARLY)
    assert cuckoo.seen_before(r, e).count() == 0 and cuckoo.error_rate(r, e).count() == 0


def test_store_over_loads(spark):
    keys = lambda a, b: spark.createDataFrame([("filehash", f"k{k}") for k in range(a, b)] * 2, "field_name string, key_value string")
    s = cuckoo.update_store(None, keys(0, 500), None, 3)
    s = cuckoo.update_store(s, keys(500, 700), keys(0, 100), 3)
    got = {r.key_value: r.seen for r in cuckoo.probe_store(s, keys(0, 900), 3).collect()}
    assert all(got[f"k{k}"] for k in range(100, 700)) and sum(got[f"k{k}"] for k in (*range(100), *range(700, 900))) < 10 and len(got) == 900


def test_removal_forgets_no_other_key(spark, monkeypatch):
    """With hashes of few values nearly all keys share a fingerprint with another one."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(cuckoo, "key_hash", lambda *c: F.pmod(F.xxhash64(*c), F.lit(40)))
    keys = lambda a, b: spark.createDataFrame([("filehash", f"k{k}") for k in range(a, b)], "field_name string, key_value string")
    s = cuckoo.update_store(None, keys(0, 60), None, 1)
    s = cuckoo.update_store(s, keys(50, 120), None, 1, held=keys(0, 60))
    s = cuckoo.update_store(s, keys(0, 0), keys(60, 120), 1)
    assert all(r.seen for r in cuckoo.probe_store(s, keys(0, 60), 1).collect())


def test_removal_over_tables_forgets_no_other_key(monkeypatch):
    real = cuckoo._mix
    monkeypatch.setattr(cuckoo, "_mix", lambda x: real(x) & ~np.uint64(0xFFF0))  # fingerprints of four bits
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 6000)
    s = cuckoo.CuckooStore(16)
    s.insert(keys)
    for h in keys[3000:]:
        s.delete(int(h))
    assert len(s.tables) > 3 and s.contains(keys[:3000]).all()
