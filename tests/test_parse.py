from __future__ import annotations

import csv
import io
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkharbor.operators import parse
from linkharbor.shared import table

ID = "abcdefgh_012::" + "0123456789abcdef" * 2
URL = "https://a.example/x?q=1"


def reason(text, kind):
    return parse.read_line(text, kind).reason


def j(x):
    return json.dumps(x)


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        (j({"id": ID, "url": URL}), "jsonl", None), (j({"url": URL, "id": ID}), "jsonl", None), (' \t{"id":"%s" ,"url":"https:\\/\\/a.example\\u002fx"} ' % ID, "jsonl", None),
        (j({"id": ID, "url": URL})[:-1], "jsonl", "broken_quoting"), (j({"id": ID, "url": URL}) + "x", "jsonl", "broken_quoting"), (j([1]), "jsonl", "broken_quoting"), ("", "jsonl", "broken_quoting"),
        (None, "jsonl", "broken_quoting"), ("{'id':1}", "jsonl", "broken_quoting"), ('{"id":NaN,"url":"u"}', "jsonl", "broken_quoting"), ('{"id":"a\tb","url":"u"}', "jsonl", "broken_quoting"),
        ('{"id":01,"url":"u"}', "jsonl", "broken_quoting"), ('{"id":"x","url":"u",}', "jsonl", "broken_quoting"), ("{}", "jsonl", "column_count"), (j({"id": ID}), "jsonl", "column_count"),
        (j({"id": ID, "url": URL, "x": None}), "jsonl", "column_count"), (j({"ID": ID, "url": URL}), "jsonl", "column_count"), ('{"id":"a","id":"b","url":"u"}', "jsonl", "column_count"),
        (j({"id": 5, "url": URL}), "jsonl", "invalid_value"), (j({"id": None, "url": URL}), "jsonl", "invalid_value"), (j({"id": ID, "url": {"a": [1, {"b": "}"}]}}), "jsonl", "invalid_value"),
        (j({"id": ID, "url": "ftp://a.b/"}), "jsonl", "invalid_value"), ("[" * 100_000, "jsonl", "broken_quoting"), ('{"id":' + "[" * 50_000 + "]" * 50_000 + ',"url":"u"}', "jsonl", "invalid_value"),
        (f"{ID},{URL}", "csv", None), (f'"{ID}","{URL}"', "csv", None), (f'{ID},"{URL},b"', "csv", None), (f'{ID},"{URL}""x"""', "csv", None), (f"{ID}\t{URL}", "tsv", None),
        (f"{ID},{URL}\r\n", "csv", None), (f'{ID},"{URL}', "csv", "broken_quoting"), (f'{ID},"{URL}"x', "csv", "broken_quoting"), (f'{ID}, "{URL}"', "csv", "broken_quoting"),
        (f'{ID},{URL}"', "csv", "broken_quoting"), (f"{ID},{URL},", "csv", "column_count"), (ID, "csv", "column_count"), ("", "csv", "column_count"), (None, "tsv", "column_count"),
        (f"{ID},{URL}", "tsv", "column_count"), (f"{ID} ,{URL}", "csv", "invalid_value"), (f"{ID}, {URL}", "csv", "invalid_value"), (f"{ID.upper()},{URL}", "csv", "invalid_value"),
        (f"{ID},http://localhost/", "csv", "invalid_value"), (f"{ID},HTTPS://A.B", "csv", None), (f"{ID},http://a.b:0/", "csv", "invalid_value"), (f"{ID},http://a.b:65535", "csv", None),
        (f"{ID},http://a.b:65536/", "csv", "invalid_value"), (f"{ID},http://a.b:/", "csv", "invalid_value"), (f"{ID},http://-a.b/", "csv", "invalid_value"), (f"{ID},http://a.b/é", "csv", "invalid_value"),
        (f"{ID},http://a..b/", "csv", "invalid_value"), (f"{ID},http://a.b#x", "csv", None), (f"{ID},http://a.b/" + "x" * 500_000, "csv", None), (f"{ID},{URL}", "weird", None),
    ],
)
def test_reasons(text, kind, want):
    assert reason(text, kind) == want


def oracle(text: str, kind: str) -> str | None:
    """An independent reading with the standard library."""
    if kind == "jsonl":
        try:
            v = json.loads(text, object_pairs_hook=lambda p: ("o", p), parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return "broken_quoting"
        if not (isinstance(v, tuple) and v[0] == "o"):
            return "broken_quoting"
        f = v[1]
    else:
        sep = "," if kind == "csv" else "\t"
        field = rf'(?:"(?:[^"]|"")*"|[^"{sep}\r\n]*)'
        if not re.fullmatch(rf"{field}(?:{sep}{field})*", text):
            return "broken_quoting"
        row = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [""])
        f = [("id", row[0]), ("url", row[1])] if len(row) == 2 else [(str(k), x) for k, x in enumerate(row)]
    if sorted(k for k, _ in f) != ["id", "url"]:
        return "column_count"
    d = dict(f)
    if not (isinstance(d["id"], str) and re.fullmatch(r"[a-z0-9_]{12}::[0-9a-f]{32}", d["id"], re.A)):
        return "invalid_value"
    m = isinstance(d["url"], str) and re.fullmatch(r"https?://((?:(?!-)[a-z0-9-]+(?<!-)\.)+(?!-)[a-z0-9-]+(?<!-))(?::(\d+))?(?:[/?#][!-~]*)?", d["url"], re.I | re.A)
    return None if m and (m[2] is None or 1 <= int(m[2]) <= 65535) else "invalid_value"


def test_against_standard_library(spark, small):
    """Every line of a whole input table."""
    df = table(spark, "/root/testdata/sf0.01", "sample_input_raw")
    got = {r.line_no: r.reason for r in parse.read_lines(df).collect()}
    want = {r.line_no: oracle(r.line, r.line_format) for r in df.collect()}
    assert got == want and any(want.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([ID, URL, '"', ",", "\t", "{", "}", ":", '"id"', '"url"', "\\", " ", "x", "1", "null", "[", "]"]), max_size=12), st.sampled_from(["jsonl", "csv", "tsv"]))
def test_random_lines(parts, kind):
    text = "".join(parts)
    assert reason(text, kind) == oracle(text, kind)


def test_recovery_at_record_starts():
    good = f"{ID},{URL}"
    text = "\n".join([good, f'"{ID},{URL}', good, f'{ID},"a\nb"', f"{ID}x", "", good]) + "\n"
    got = [(r.reason, r.start) for r in parse.read_buffer(text, "csv")]
    assert [g[0] for g in got] == [None, "broken_quoting", None, "invalid_value", "column_count", None]
    assert got[1][1] == len(good) + 1
    js = "\n".join([j({"id": ID, "url": URL}), '{"id":"' + ID, j({"url": URL, "id": ID})])
    assert [r.reason for r in parse.read_buffer(js, "jsonl")] == [None, "broken_quoting", None]
    assert list(parse.read_buffer("", "csv")) == [] and list(parse.read_buffer(None, "csv")) == []


def test_every_line_after_a_broken_quote_has_a_reason():
    lines = [f'{ID},"{URL}', f"BAD{ID},{URL}", "12,x,y", f"{ID},{URL}", f'"{ID}', f'{ID}"', f"{ID},{URL}"]
    got = [r.reason for r in parse.read_buffer("\n".join(lines), "csv")]
    # RFC 4180 lets the fifth field span two lines
    assert got == ["broken_quoting", "invalid_value", "column_count", None, "column_count", None]
    starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    assert [r.reason for r in parse.read_buffer("\n".join(lines), "csv", starts)] == [parse.read_line(x, "csv").reason for x in lines]


FILE = "file_name string, file_format string, part_no int, content string, body string"


def cut_rows(name, kind, text, cuts):
    at = [0, *sorted(set(cuts)), len(text)]
    return [(name, kind, k, text[i:j], "x") for k, (i, j) in enumerate(zip(at, at[1:]))]


def test_parts_read_as_the_whole_file(spark):
    good = f"{ID},{URL}"
    text = "\n".join([good, f'"{ID}","{URL}"', f'{ID},"{URL}', "12,x,y", good, "", f'{ID},"a\nb"', good + "\r", f"{ID}x", f'"{ID}",{URL}"', good]) + "\n"
    js = "\n".join([j({"id": ID, "url": URL}), '{"id":"' + ID, "", j({"url": URL, "id": ID}), "x" * 300, j({"id": ID, "url": URL})])
    rows, want = [], {}
    for kind, t in (("csv", text), ("tsv", text.replace(",", "\t")), ("jsonl", js)):
        for step in (7, 40, 61, 97, 150, 333, 10_000):
            name = f"{kind}{step}"
            rows += cut_rows(name, kind, t, range(step, len(t), step))
            want[name] = sorted((r.start, r.id, r.url, r.reason, r.at) for r in parse.read_buffer(t, kind))
    got = {}
    for r in parse.read_parts(spark.createDataFrame(rows, FILE).repartition(5)).collect():
        got.setdefault(r.file_name, []).append((r.start_at, r.id, r.url, r.reason, r.error_at))
    assert {k: sorted(v) for k, v in got.items() if int(k.strip("cstvjonl")) > 90} == {k: v for k, v in want.items() if int(k.strip("cstvjonl")) > 90}
    # parts shorter than a record start can't see one: valid records stay, and nothing goes without a reason
    for k, v in want.items():
        assert {x[:3] for x in v if x[3] is None} <= {x[:3] for x in got[k] if x[3] is None}


def test_parts_of_whole_tables(spark):
    """Files rebuilt from their lines and cut into parts give the records of their lines."""
    from pyspark.sql import functions as F

    t = table(spark, "/root/testdata/sf0.01", "sample_input_raw")
    lines = t.withColumn("part_no", F.floor(F.col("line_no") / 211)).groupBy("file_name", "line_format", "part_no")
    parts = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content"))
    w = __import__("pyspark").sql.Window.partitionBy("file_name").orderBy("part_no")
    parts = parts.withColumn("part_no", F.row_number().over(w) - 1).withColumnRenamed("line_format", "file_format")
    count = lambda df: {(r.file_name, r.reason): r.n for r in df.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    blank = t.filter("trim(line) = ''").count()
    a, b = count(parse.read_parts(parts)), count(parse.read_lines(t))
    assert sum(a.values()) == sum(b.values()) - blank and {k: v for k, v in a.items() if k[1] is None} == {k: v for k, v in b.items() if k[1] is None}


def test_files_and_tables(spark):
    f = spark.createDataFrame([("a.csv", "csv", f"{ID},{URL}\n{ID},bad\n", 1), ("b.csv", "csv", None, 2)], "file_name string, file_format string, content string, record_no int")
    assert [(r.record_no, r.reason, r.error_at) for r in parse.read_files(f).orderBy("record_no").collect()] == [(0, None, None), (1, "invalid_value", len(f"{ID},{URL}\n"))]
    lines = spark.createDataFrame([(1, None, "csv", f"{ID},{URL}", "z"), (None, "f", None, None, "z"), (1, None, "csv", f"{ID},{URL}", "z")], "line_no long, file_name string, line_format string, line string, reason string")
    p = parse.read_lines(lines)
    assert parse.valid(p).count() == 2 and [r.reason for r in parse.failed(p).collect()] == ["column_count"]
    assert parse.read_lines(lines.limit(0)).count() == 0
