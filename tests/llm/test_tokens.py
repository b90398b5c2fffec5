"""Packing and mixing."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkharbor.llm import mixing, packing, tokens
from linkharbor.operators import scale

needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="no vocabulary")
DOC = "doc_id long, text string, source string, n_tokens long, spec_id int, uses int, rate double"


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=15))
def test_plan_places_every_item_once(counts):
    p = packing.plan(counts, 30)
    used = Counter()
    for x in p:
        assert x.times > 0 and sum(x.lengths) <= 30
        for n in x.lengths:
            used[n] += x.times
    assert used == Counter(counts)
    # no two containers could be merged more than best fit leaves: at most one is less than half full
    assert sum(x.times for x in p if sum(x.lengths) * 2 < 30) <= 1


def test_exact_complements():
    assert {(x.times, x.lengths) for x in packing.plan({7: 3, 3: 3}, 10)} == {(3, (7, 3))}
    assert {tuple(sorted(x.lengths)) for x in packing.plan({6: 1, 3: 1, 1: 1}, 10)} == {(1, 3, 6)}
    four = packing.plan({5: 1, 2: 1, 1: 1, 4: 1, 10: 2}, 10)
    assert sum(x.times for x in four) == 4
    assert packing.plan({}, 10) == [] and packing.plan({10: 10**12}, 10)[0].times == 10**12


def test_plan_is_independent_of_the_number_of_items():
    big = packing.plan({k: 10**9 + k for k in range(1, 400)}, 512)
    assert len(big) < 2000


@needs_vocabulary
def test_counts():
    assert tokens.count(None) == tokens.count("") == 0 and tokens.count("Hello world") == 2
    enc = tokens.encoder(tokens.VOCABULARY)
    for text in ("alpha beta\n" * 60_000, "x" * 150_000, "".join(chr(97 + k * k % 26) for k in range(100_000)), "0" * 50_000, "#!" * 40_000, "\u6f22\u5b57" * 30_000, "a " * 9000 + "b" * 30_000 + " c" * 9000):
        assert tokens.count(text) == len(enc.encode_ordinary(text))
    for space in (" ", "\n", "\t ", "\u3000"):  # short enough for the tokenizer to do it alone
        for text in (space * 3000, "a" + space * 3000, space * 3000 + "b", "a." + space * 3000 + "'s b" + space * 2000 + "9"):
            assert tokens.count(text) == len(enc.encode_ordinary(text))
    assert tokens.count("a" + " " * 2_000_000 + "b") > 10


@needs_vocabulary
def test_pack(spark):
    rows = [(k, "word " * (k % 37), "s", 0, 0, 0, 0.0) for k in range(400)] + [(900, "word " * 700, "s", 0, 0, 0, 0.0), (901, None, None, 0, 0, 0, 0.0), (902, "", "s", 0, 0, 0, 0.0), (None, "word", "s", 0, 0, 0, 0.0), (5, "word word", "s", 0, 0, 0, 0.0)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    specs = spark.createDataFrame([(1, "a", 50), (2, "b", 300), (3, "zero", 0), (None, "n", 9)], "spec_id int, spec_name string, capacity_tokens int")
    placed = packing.pack(df, specs).collect()
    texts = Counter((r[0], tokens.count(r[1])) for r in rows)
    for spec, cap in ((1, 50), (2, 300)):
        mine = [r for r in placed if r.spec_id == spec]
        by = defaultdict(list)
        for r in mine:
            if r.n_tokens:
                by[r.container_id].append(r)
        assert sum(r.n_tokens for r in mine) == sum(n * c for (_, n), c in texts.items())
        assert sorted(by) == list(range(1, len(by) + 1))
        for items in by.values():
            items.sort(key=lambda r: r.place)
            assert [r.place for r in items] == list(range(1, len(items) + 1)) and sum(r.n_tokens for r in items) <= cap
            assert [r.start_at for r in items] == [sum(x.n_tokens for x in items[:k]) for k in range(len(items))]
        assert all(r.n_pieces == 1 for r in mine if r.doc_id != 900) and [r.n_tokens for r in sorted((x for x in mine if x.doc_id == 900), key=lambda x: x.piece)][:-1] == [cap] * (tokens.count("word " * 700) // cap)
        assert {r.doc_id for r in mine if r.container_id is None} >= {901, 902} and all(r.place == 0 for r in mine if r.container_id is None)
        total = sum(r.n_tokens for r in mine)
        assert len(by) <= -(-total // cap) + 1  # within one container of the bound
    assert {r.spec_id for r in placed} == {1, 2}
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0
    c = packing.containers(packing.pack(df, specs), specs).filter("unused_tokens < 0").count()
    assert c == 0


@needs_vocabulary
def test_mix(spark):
    rows = [(k, "word " * 20, "big", 0, 0, 0, 0.0) for k in range(2000)] + [(5000 + k, "word " * 20, "mid", 0, 0, 0, 0.0) for k in range(300)] + [(9000 + k, "word " * 20, "tiny", 0, 0, 0, 0.0) for k in range(10)]
    rows += [(9900, "word", None, 0, 0, 0, 0.0), (9901, None, "big", 0, 0, 0, 0.0), (9902, "word", "other", 0, 0, 0, 0.0), (None, "word", "big", 0, 0, 0, 0.0)]
    df = spark.createDataFrame(rows, DOC)
    target = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2), (None, 0.1, 1), ("neg", -1.0, 1)], "source string, target_share double, max_repeats int")
    uses, share = mixing.mix(df, target)
    u = uses.collect()
    assert len(u) == len(rows) and {r.uses for r in u if r.source in (None, "other")} == {0} and {r.uses for r in u if r.source == "tiny"} == {4}
    s = {r.source: r for r in share.collect()}
    assert s["tiny"].missed and s["tiny"].most_uses == 4 and s["absent"].missed and s["absent"].reached_share == 0 and s["absent"].rate == 0 and not s["neg"].missed
    assert abs(sum(r.reached_share for r in s.values()) - 1) < 1e-9
    # uncapped sources keep their ratio up to the chance of the last copy
    assert s["big"].reached_share / s["mid"].reached_share == pytest.approx(5 / 3, rel=0.1)
    assert all(r.uses in (int(s["mid"].rate), int(s["mid"].rate) + 1) for r in u if r.source == "mid")
    again = mixing.mix(df, target)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, u))
    e = mixing.mix(df.limit(0), target)
    assert e[0].count() == 0 and all(r.reached_share == 0 for r in e[1].collect())
    assert mixing.mix(df, target.limit(0))[0].filter("uses > 0").count() == 0


def test_many_sources_are_salted(spark, monkeypatch):
    monkeypatch.setattr(scale, "bounded", lambda *a, **k: None)
    t = spark.createDataFrame([(k, "a" if k % 2 else None, 5) for k in range(100)], "doc_id long, source string, n_tokens long")
    got = mixing.draw(t, spark.createDataFrame([("a", 2.0)], "source string, rate double")).collect()
    assert len(got) == 100 and Counter(r.uses for r in got) == {2: 50, 0: 50}
