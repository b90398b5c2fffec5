"""Error-recovering reader of (id, url) input: JSON lines and RFC 4180 delimited text.

A recursive-descent grammar reads one record at a position of a buffer and returns either the decoded fields or a
located syntax error.  In a buffer of many records an unclosed quote would swallow what follows.  So a record must end
before the next *validated record start*: a known line start of an input table, any line start of JSON lines, else a line
start from which an id of the right form and a delimiter can be read.  After an error reading resumes at the next line,
and up to the next validated start each line is read by itself: no failing line goes without a reason.

``read_lines`` reads the lines of an input table, those of one file in a batch as one buffer; nothing is shuffled.
``read_parts`` reads raw files that come in parts cut anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

BROKEN, COUNT, VALUE = "broken_quoting", "column_count", "invalid_value"

# Forms of the two fields.
_ID = re.compile(r"[a-z0-9_]{12}::[0-9a-f]{32}")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_URL = re.compile(rf"[hH][tT][tT][pP][sS]?://{_LABEL}(?:\.{_LABEL})+(?::([0-9]+))?(?:[/?#][\x21-\x7e]*)?")

# Tokens of RFC 8259.
_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORD = re.compile(r"true|false|null")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))")
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

# Record starts that are trusted after a broken quote; each line of JSON lines is one.
_ANCHOR = {
    "csv": re.compile(r'^"?[a-z0-9_]{12}::[0-9a-f]{32}"?,', re.M),
    "tsv": re.compile(r'^"?[a-z0-9_]{12}::[0-9a-f]{32}"?\t', re.M),
}
_DELIMITER = {"csv": ",", "tsv": "\t"}
_KINDS = ("jsonl", "csv", "tsv")


class Broken(Exception):
    """A syntax error at a character offset."""

    def __init__(self, at: int, what: str) -> None:
        super().__init__(what)
        self.at, self.what = at, what


class Record(NamedTuple):
    """What was read: either ``id`` and ``url``, or a reason with its place and detail."""

    start: int
    end: int
    id: str | None
    url: str | None
    reason: str | None
    at: int | None
    detail: str | None


class Other:
    """A JSON value that isn't a string."""


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _PLAIN.get(m[2], m[2]), s)
    if any("\ud800" <= ch <= "\udfff" for ch in out):  # join surrogate pairs, replace lone halves
        out = out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return out


class _Json:
    """value := object | array | string | number | word, over a buffer."""

    def __init__(self, text: str, end: int) -> None:
        self.t, self.end = text, end

    def at(self, i: int) -> str:
        return self.t[i] if i < self.end else ""

    def ws(self, i: int) -> int:
        return _WS.match(self.t, i, self.end).end()

    def string(self, i: int) -> tuple[str, int]:
        m = _STRING.match(self.t, i, self.end)
        if not m:
            raise Broken(i, "string expected or not closed")
        return _unescape(m[1]), m.end()

    def members(self, i: int) -> tuple[list[tuple[str, object]], int]:
        """An object of any values; nested values are only checked."""
        out: list[tuple[str, object]] = []
        if self.at(i) != "{":
            raise Broken(i, "object expected")
        i = self.ws(i + 1)
        if self.at(i) == "}":
            return out, i + 1
        while True:
            name, i = self.string(i)
            i = self.ws(i)
            if self.at(i) != ":":
                raise Broken(i, "colon expected")
            value, i = self.value(self.ws(i + 1))
            out.append((name, value))
            i = self.ws(i)
            c = self.at(i)
            if c == "}":
                return out, i + 1
            if c != ",":
                raise Broken(i, "comma or closing brace expected")
            i = self.ws(i + 1)

    def value(self, i: int) -> tuple[object, int]:
        c = self.at(i)
        if c == '"':
            return self.string(i)
        if c in ("{", "["):
            return Other, self.nested(i)
        m = _NUMBER.match(self.t, i, self.end) or _WORD.match(self.t, i, self.end)
        if not m:
            raise Broken(i, "value expected")
        return Other, m.end()

    def nested(self, i: int) -> int:
        """Containers of any depth, with the open ones on an explicit stack instead of the call stack."""
        stack: list[str] = []
        while True:
            c = self.at(i)
            if c in ("{", "["):  # descend
                stack.append("}" if c == "{" else "]")
                i = self.ws(i + 1)
                if self.at(i) == stack[-1]:
                    stack.pop()
                    i += 1
                else:
                    i = self._name(i) if c == "{" else i
                    continue
            else:
                _, i = self.value(i)
            while stack:  # after a value
                i = self.ws(i)
                c = self.at(i)
                if c == stack[-1]:
                    stack.pop()
                    i += 1
                elif c == ",":
                    i = self.ws(i + 1)
                    i = self._name(i) if stack[-1] == "}" else i
                    break
                else:
                    raise Broken(i, "comma or closing bracket expected")
            else:
                return i

    def _name(self, i: int) -> int:
        i = self.ws(self.string(i)[1])
        if self.at(i) != ":":
            raise Broken(i, "colon expected")
        return self.ws(i + 1)


def _line_end(text: str, i: int, end: int) -> int | None:
    """Where the next record starts if this one ends at i."""
    if i >= end:
        return i
    if text[i] == "\n":
        return i + 1
    if text.startswith("\r\n", i, end) or (text[i] == "\r" and i + 1 == end):
        return min(i + 2, end)
    return None


def _delimited(text: str, i: int, sep: str, end: int) -> tuple[list[str], int]:
    """fields := field (sep field)*; a field is quoted as a whole or holds no quote."""
    out = []
    while True:
        if i < end and text[i] == '"':
            parts, j = [], i + 1
            while True:
                k = text.find('"', j, end)
                if k < 0:
                    raise Broken(i, "quote not closed")
                parts.append(text[j:k])
                if k + 1 < end and text[k + 1] == '"':
                    parts.append('"')
                    j = k + 2
                else:
                    i = k + 1
                    break
            out.append("".join(parts))
            nxt = _line_end(text, i, end)
            if nxt is None and text[i] != sep:
                raise Broken(i, "text after a closing quote")
        else:
            j = i
            while (nxt := _line_end(text, j, end)) is None and text[j] != sep:
                if text[j] == '"':
                    raise Broken(j, "quote inside an unquoted field")
                j += 1
            out.append(text[i:j])
            i = j
        if nxt is not None:
            return out, nxt
        i += 1


def _plain_fields(text: str, sep: str) -> list[str] | None:
    """The common case without quotes or line breaks."""
    return None if '"' in text or "\n" in text or "\r" in text else text.split(sep)


def check_values(id_: object, url: object) -> str | None:
    """The name of the field whose value is invalid, or None."""
    if not (isinstance(id_, str) and _ID.fullmatch(id_)):
        return "id"
    m = _URL.fullmatch(url) if isinstance(url, str) else None
    if not m:
        return "url"
    if m[1] is not None and not (1 <= int(m[1][-20:]) <= 65535 and len(m[1].lstrip("0")) <= 5):
        return "port"
    return None


def _typed(start: int, end: int, fields: list[tuple[str, object]]) -> Record:
    if sorted(n for n, _ in fields) != ["id", "url"]:
        return Record(start, end, None, None, COUNT, start, f"{len(fields)} fields")
    by = dict(fields)
    bad = check_values(by["id"], by["url"])
    if bad:
        return Record(start, end, None, None, VALUE, start, bad)
    return Record(start, end, by["id"], by["url"], None, None, None)


def _record(text: str, i: int, end: int, kind: str, whole: bool) -> Record:
    """One record from position i that ends before ``end``; ``whole``: it must take all of that."""
    if kind == "jsonl":
        js = _Json(text, end)
        fields, at = js.members(js.ws(i))
        at = js.ws(at)
        if at < end:
            raise Broken(at, "text after the object")
        return _typed(i, end, fields)
    values = _plain_fields(text[i:end], _DELIMITER[kind]) if whole else None
    at = end
    if values is None:
        values, at = _delimited(text, i, _DELIMITER[kind], end)
        if whole and at < end:
            return Record(i, end, None, None, COUNT, at, f"a second record of {end - at} characters")
    if len(values) != 2:
        return Record(i, at, None, None, COUNT, i, f"{len(values)} fields")
    return _typed(i, at, [("id", values[0]), ("url", values[1])])


def _line(text: str, i: int) -> int:
    """The start of the next line."""
    return text.find("\n", i) + 1 or len(text)


def read_buffer(text: str | None, kind: str | None, starts: list[int] | None = None, first: bool = True) -> Iterator[Record]:
    """Read a buffer of many records, and recover after broken ones.

    ``starts`` are the ascending starts of its lines where they are known to be records, each one whole: then there is one
    Record per start.  Without them blank lines are skipped, and fields of delimited text may span lines as long as their
    quotes close before the next line that starts with an id and a delimiter; ``first`` says that the buffer starts with
    a record, else the lines before the first validated start are read by themselves.  An unknown format is read as csv.
    """
    text, kind = text or "", kind if kind in _KINDS else "csv"
    if starts is not None:
        spans = [(i, j, True) for i, j in zip(starts, [*(k - 1 for k in starts[1:]), len(text)])]
    else:
        anchors = [m.start() for m in _ANCHOR[kind].finditer(text)] if kind != "jsonl" else []
        spans = [(i, j, False) for i, j in zip(anchors, [*anchors[1:], len(text)])]
        if not anchors or anchors[0] > 0:
            spans.insert(0, (0, anchors[0] if anchors else len(text), False))
    for k, (i, bound, whole) in enumerate(spans):
        # from a validated start a record may span lines; after it, line by line
        alone = kind == "jsonl" or (k == 0 and not first)
        while i < bound or whole:
            if not whole and _line_end(text, i, bound) is not None:
                i = _line(text, i)
                continue
            stop = min(_line(text, i), bound) if alone and not whole else bound
            try:
                r = _record(text, i, stop, kind, whole or alone)
            except Broken as e:
                alone = True
                stop = bound if whole else min(_line(text, i), bound)
                r = Record(i, stop, None, None, BROKEN, e.at, e.what)
            yield r
            i = r.end
            if whole:
                break


def read_line(text: str | None, kind: str | None) -> Record:
    """Read a buffer that is to be exactly one record.  NULL reads as an empty line; an unknown format as csv."""
    return next(read_buffer(text, kind, [0]))


_LINES = "line_no long, file_name string, id string, url string, reason string, error_at int, detail string"


def read_lines(df: DataFrame) -> DataFrame:
    """Rows (line_no, file_name, line_format, line) to typed records and located errors, one row per line.

    Valid rows have ``id`` and ``url``; others the first reason that applies, the offset and a detail.  A NULL line reads
    as an empty one (broken as JSON, one field as delimited text), an unknown format as csv; repeated lines are read
    as often as they occur, lines of any length whole; further columns do no harm; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # the lines of a file that came together are one buffer
            for (name, kind), rows in pdf.groupby(["file_name", "line_format"], dropna=False, sort=False):
                lines = [t or "" for t in rows["line"]]
                starts = [0, *accumulate(len(t) + 1 for t in lines)][: len(lines)]
                got = list(read_buffer("\n".join(lines), kind if isinstance(kind, str) else None, starts))
                yield pd.DataFrame(
                    {
                        "line_no": rows["line_no"].to_numpy(), "file_name": name if isinstance(name, str) else None, "id": [r.id for r in got], "url": [r.url for r in got], "reason": [r.reason for r in got],
                        "error_at": pd.array([None if r.at is None else r.at - i for r, i in zip(got, starts)], dtype="Int32"), "detail": [r.detail for r in got],
                    }
                )

    return df.select("line_no", "file_name", "line_format", "line").mapInPandas(run, _LINES)


_FILES = "file_name string, part_no long, record_no long, start_at long, id string, url string, reason string, error_at long, detail string"
_CUT = "file_name string, file_format string, part_no long, n long, head string, whole boolean, body string"


def _cut(content: str, kind: str, part: int) -> tuple[str, str]:
    """Head and body of a part: the head belongs to the record that started in an earlier part.

    A body starts with the first validated record start; without one, with the first line."""
    if part == 0:
        return "", content
    if kind == "jsonl":
        at = _line(content, 0) if "\n" in content else len(content)
    else:  # the part's own begin may be the middle of a line
        line = _line(content, 0) if "\n" in content else len(content)
        m = _ANCHOR[kind].search(content, line)
        at = m.start() if m else line
    return content[:at], content[at:]


def read_parts(df: DataFrame) -> DataFrame:
    """Rows (file_name, file_format, part_no, content), the parts of files in order from 0 and cut anywhere, to records and
    errors with their offsets in the file.

    Each part is read from its first validated record start, and on into the heads of the parts after it up to theirs.
    Only heads, which are short, meet another part; no task holds more than a part and a line.  A record may reach into the
    next part but not beyond it, unless it is a single line.  ``record_no`` counts inside the part.  A NULL content is
    empty, an unknown format csv; a NULL file_name is a file; further columns do no harm; an empty table gives no rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, kind, part, text in zip(pdf["file_name"], pdf["file_format"], pdf["part_no"], pdf["content"]):
                kind, text = kind if kind in _KINDS else "csv", text or ""
                head, body = _cut(text, kind, part)
                out.append((name, kind, part, len(text), head, part == 0 or bool(kind != "jsonl" and _ANCHOR[kind].match(body)), body))
            yield pd.DataFrame(out, columns=["file_name", "file_format", "part_no", "n", "head", "whole", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                base, text = row.before + row.n - len(row.body), row.body + (row.tail or "")
                rows = [(row.file_name, row.part_no, n, base + r.start, r.id, r.url, r.reason, None if r.at is None else base + r.at, r.detail) for n, r in enumerate(read_buffer(text, row.file_format, None, row.whole))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FILES.split(", ")]).astype({"error_at": "Int64"})

    parts = materialize(df.select("file_name", "file_format", F.col("part_no").cast("long").alias("part_no"), "content").mapInPandas(cut, _CUT))
    # numbers only: offsets, and the part that a head belongs to (the last one before it with a body)
    w = Window.partitionBy("file_name").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select(
        "file_name", "part_no", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.max(F.when((F.length("body") > 0) | (F.col("part_no") == 0), F.col("part_no"))).over(w), F.lit(0)).alias("owner")
    )
    same = lambda a, b, k: F.col(f"{a}.file_name").eqNullSafe(F.col(f"{b}.file_name")) & (F.col(f"{a}.part_no") == F.col(f"{b}.{k}"))
    heads = parts.filter("head <> ''").select("file_name", "part_no", "head").alias("h").join(sizes.alias("s"), same("h", "s", "part_no")).select("h.*", "owner")
    tails = heads.groupBy("file_name", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "head"))), lambda x: x["head"]), "").alias("tail"))
    bodies = parts.filter("body <> ''").drop("head").alias("p").join(sizes.alias("s"), same("p", "s", "part_no")).select("p.*", "before").alias("p")
    return bodies.join(tails.alias("t"), same("p", "t", "owner"), "left").select("p.*", "tail").mapInPandas(run, _FILES)


def read_files(df: DataFrame) -> DataFrame:
    """Rows (file_name, file_format, content), each a whole file that fits a task, to records and errors with offsets."""
    return read_parts(df.select("file_name", "file_format", F.lit(0).alias("part_no"), "content"))


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("line_no", "file_name", "id", "url")


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_no", "file_name", "reason", "error_at", "detail")
