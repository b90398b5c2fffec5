"""Template residue, filler, error pages and script notices in texts.

Evidence of three kinds is combined:

* placeholder detectors: a grammar of template variables, empty program values and instructions to the author that
  fill a whole slot: a line, the value of a labelled line, or a part of a citation.  The same characters inside
  a running sentence are its subject and no residue;
* sentences that speak to the visitor of a failed page, and filler, read by classes of words (``notices``): strong where
  nothing else is left in them, weak where something is;
* host evidence: a whole text, or a line that may be a notice, whose words answer neither the title nor the slug of the address, and which
  many addresses on several hosts give in the same words up to numbers.

The first two look at one text at a time, whole, in one pass.  The third looks at all texts, as fingerprints, so it
stands beside the others: a text may have several kinds of evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from operator import eq
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import lookup_small
from ..shared import materialize, missing, small_or_plain
from . import notices

# What template engines and forms leave behind when nothing was filled in. --------------------

_NAME = r"\$?[^\W\d][\w.:\-]*(?:\[\d+\])?(?:\.\w+)*(?: ?\| ?\w+)?"
_WORDS = r"[^\n\[\]{}<>«»*]+"
_LETTER = r"(?=[^{}\n]*[^\W\d])"
_FIELD = "titles?|abstract|summary|authors?|names?|journal|keywords?|publisher|date|year|text|titre|résumé|auteurs?|noms?|titel|autor(?:en|es)?|kurzfassung|jahr|título|resumen|resumo|fecha|data|ano|año"
_SLOT = [
    rf"\{{\{{\{{? ?{_NAME} ?",  # {{x that was cut off
    rf"\{{\{{\{{?{_LETTER}[^{{}}\n]+\}}\}}\}}?",  # {{x}}, {{{x}}}, {{#each x}}
    rf"[$#]\{{ ?{_NAME} ?\}}",
    rf"\{{\${_NAME}\}}",
    rf"\{{(?:\d+|{_NAME})\}}",
    r"<%[^%\n]+%>",
    r"<\?(?!xml)[^?\n]+\?>",
    r"\{%[^%\n]+%\}",
    r"\[%[^%\n]+%\]",
    rf"\[\[ ?{_NAME} ?\]\]",
    rf"@@{_NAME}@@",
    rf"##{_NAME}##",
    rf"__{_NAME}__",
    rf"%{_NAME}%",
    rf"\${_NAME}\$",
    rf"~{_NAME}~",
    rf"%\({_NAME}\)[sd]",
    r"%(?:\d+\$)?[sd@]",
    rf"(?:<|&lt;){_WORDS}(?:>|&gt;)",
    rf"{_WORDS}_PLACEHOLDER",
    rf"\*{{3}} ?{_WORDS}\*{{3}}",
    rf"<<? ?{_WORDS} ?>>?",
    rf"« ?{_WORDS} ?»",
    rf"_{{3,}} ?{_WORDS} ?_{{3,}}",
    rf"\?{{3}}{_WORDS}\?{{3}}",
    rf"\[(?:TODO|TBD|FIXME)\b{_WORDS}\]",
    rf"\[(?:your|insert|enter|add|hier|ici|aquí|aqui|inserir|insertar|insérer)\b{_WORDS}\]",
    rf"\[{_WORDS}(?:à compléter|einfügen|goes here|here|pendiente|a preencher)\]",
    rf"\((?:enter|insert|add|type)\b{_WORDS}\)",
    r"\[[^\W\d]+\]",
    rf"\[(?:{_WORDS} )?(?:{_FIELD})(?: {_WORDS})?\]",
    rf"(?:click to edit|missing translation:|replace this with|enter your|type your) {_WORDS}",
    rf"{_WORDS}: ?x{{4,}}",
    r"metadata\.dc\.[\w.]+",
    r"\[object \w+\]",
    r"undefined(?: undefined)*|null(?: null)*|NULL(?: NULL)*|None(?: None)*|NaN|nil|\(unset\)|\(null\)|Invalid Date|#(?:REF|N/A|VALUE|NAME\?|DIV/0)!?",
]
_ONE = rf"(?:{'|'.join(_SLOT)})"
#: A slot's value: one placeholder, or engine code and variables in a row.
_SLOT_ANY = re.compile(rf"{_ONE}(?: \(\d+\))?[.,;:]*", re.IGNORECASE)
_CODE_ROW = re.compile(r"(?:(?:\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%[^%\n]+%>|\[%[^%\n]+%\]|\$\{[^{}\n]+\})[\s,;:/.|–-]*)+")

# Words of the usual pseudo-Latin dummy text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "accumsan aenean aliquam ante arcu auctor augue bibendum blandit condimentum congue curabitur cursus dapibus diam dictum dignissim donec egestas eleifend erat "
    "facilisis faucibus felis fermentum feugiat fringilla fusce gravida habitant hendrerit iaculis imperdiet lacinia lacus laoreet lectus ligula lobortis luctus maecenas "
    "malesuada massa mattis mauris metus molestie morbi nascetur neque netus nibh nisl nullam nunc odio orci ornare pellentesque phasellus placerat porta porttitor posuere "
    "praesent pretium primis proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque semper sodales sollicitudin suscipit suspendisse tellus "
    "tincidunt tortor tristique turpis ultrices urna varius vehicula vestibulum vitae viverra vivamus volutpat vulputate".split()
)
#: Other endings of the longer of these words.
_LATIN_STEMS = frozenset(w[:4] for w in _LATIN if len(w) > 4)

_MOST = 64


def _runs(tree) -> list[set[str] | None]:
    """The parts of a parsed pattern in order: all strings a part can be, or None where they are too many to list."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append({chr(arg).lower()})
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            out.append({chr(c).lower() for _, c in arg})
        elif op is C.SUBPATTERN:
            out.extend(_runs(arg[3]))
        elif op is C.BRANCH:
            ways = [_runs(b) for b in arg[1]]
            exact = [_product(w) for w in ways]
            if all(e is not None for e in exact) and len(set().union(*exact)) <= _MOST:
                out.append(set().union(*exact))
            else:  # a break on either side: what the branch needs does not continue its neighbours
                need = [_best(w) for w in ways]
                out += [None, set().union(*need) if all(need) else None, None]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            part = _product(_runs(inner))
            if part is not None and least == 0 and most == 1:
                out.append(part | {""})
            else:
                out += _runs(inner) * min(least, 4) + ([None] if most != least or least > 4 else [])
        elif op is not C.AT:
            out.append(None)
    return out


def _product(parts: list[set[str] | None]) -> set[str] | None:
    got = {""}
    for p in parts:
        if p is None or len(got) * len(p) > _MOST:
            return None
        got = {g + x for g in got for x in p}
    return got


def _rarity(s: str) -> int:
    """A bracket or another sign is as rare as four letters."""
    return sum(1 if c.isalnum() or c in " %.:" else 4 for c in s)


def _best(parts: list[set[str] | None]) -> set[str] | None:
    """Strings of which each match holds one, as long as the pattern allows; None if it names none."""
    best: set[str] | None = None
    for i in range(len(parts)):
        got = {""}
        for p in parts[i:]:
            if p is None or (len(got) > 1 and len(got) * len(p) > _MOST):
                break
            got = {g + x for g in got for x in p}
            if best is None or (min(map(_rarity, got)), -len(got)) > (min(map(_rarity, best)), -len(best)):
                best = got
    # a single letter or digit occurs everywhere
    return best if best and all(len(x) > 1 or (x and not x.isalnum() and x not in " %") for x in best) else None


def triggers(pattern: str) -> set[str] | None:
    """Lower-case strings of which every match of ``pattern`` holds one; None if only a pattern can say."""
    return _best(_runs(_parser.parse(pattern)))


# A line is searched for placeholders only if a trigger occurs in it (lower case).  They are derived from the patterns; the
# few patterns without fixed words (percent signs) are found by an expression.
_DERIVED = {p: triggers(p) for p in _SLOT}
_TRIGGERS = tuple(sorted(set().union(*(t for t in _DERIVED.values() if t))))
_PERCENT = re.compile(rf"(?<![\w%])%(?:{_NAME}%|\({_NAME}\)[sd]|(?:\d+\$)?[sd@](?!\w))", re.IGNORECASE)

_REPEAT = re.compile(r"(?<!\S)(\S{1,20})(?:\s+\1){7,}(?!\S)")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[.!?]*\s+|\s+[-–—|]\s+|\n+")
#: A label is a few words.
_LABELLED = re.compile(r"[^\W\d][^:.\n]*?\s?[:.]\s+(.+)", re.DOTALL)
_CITED = re.compile(r"\s\(\d{4}\)\.?\s|;\s|\.\s")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in _TRIGGERS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _slot(part: str) -> bool:
    part = part.strip()
    return bool(_SLOT_ANY.fullmatch(part) or _CODE_ROW.fullmatch(part))


def residue_in_line(line: str) -> str | None:
    """``placeholder`` if a slot of the line holds nothing but a placeholder."""
    s = line.strip()
    if _slot(s):
        return "placeholder"
    s = s.lstrip("#-*• ")
    if not s:
        return None
    if _slot(s):
        return "placeholder"
    m = _LABELLED.fullmatch(s)
    if m and len(s[: m.start(1)].split()) > 4:
        m = None
    value = m[1] if m else s
    if m and _slot(value):
        return "placeholder"
    parts = [p for p in _CITED.split(value) if p]
    # a citation or a list: every part is a short field, so one empty field is residue
    if len(parts) > 1 and (m or re.search(r"\(\d{4}\)", s)) and any(_slot(p) for p in parts):
        return "placeholder"
    return None


def _filler(sentence: str) -> bool:
    """Pseudo-Latin: most words are of the list or other endings of its words; without the small words that a living language
    needs, half of them in a short sentence and a third in a longer one are enough."""
    words = _WORD.findall(sentence.lower())
    n, exact = len(words), sum(w in _LATIN and len(w) > 3 for w in words)
    if n < 4 or exact * (4 if n < 8 else 6) < n:
        return False
    alike = sum(w in _LATIN or w[:4] in _LATIN_STEMS for w in words)
    if alike >= 0.8 * n:
        return exact * 4 >= n
    return alike >= (0.5 if n < 8 else 0.35) * n and not any(w in notices.SMALL_WORDS and w not in _LATIN for w in words)


def notice_in_line(line: str, hints: list[str] | None = None, latin: bool = True) -> tuple[str, str] | None:
    """(strength, kind) of a line: strong if one of its sentences is, weak if all are.

    A sentence without any of ``hints`` is known to be none, and filler is looked for only with ``latin``."""
    weak, every = None, True
    for s in _SENTENCE.split(line):
        s = s.strip(" \t.!…\u00a0")
        if not s:
            continue
        got = notices.read(s) if hints is None or any(h in s for h in hints) else None
        if got is None and latin and _filler(s):
            return "strong", "filler"
        if got is not None and got[0] == "strong":
            return got
        weak, every = weak or got, every and got is not None
    return weak if every else None


def _lower(text: str) -> str:
    """Lower case with every character at its place, and letters that equal others where case is ignored made these."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer would shift positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for odd, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        low = low.replace(odd, plain)
    return low


def examine(text: str | None, low: str | None = None, words: set[str] | None = None) -> tuple[str | None, list[str]]:
    """The first kind of residue in a text, or None, and its lines that are a notice or may be one (in lower case): the weak
    ones up to the first strong one, and that.  NULL and empty texts hold none.

    ``low`` and ``words``, the text in lower case and its letter runs, save their computation."""
    if not text:
        return None, []
    tokens = text.split()
    if any(map(eq, tokens, tokens[1:])) and _REPEAT.search(text):
        return "filler", []
    low = _lower(text) if low is None else low
    words = set(_WORD.findall(low)) if words is None else words
    # every line with a trigger is parsed once
    ends = {end for end, _ in _automaton().iter(low)}
    if "%" in text:
        ends.update(m.end() - 1 for m in _PERCENT.finditer(text))
    last, said = -1, []
    for end in sorted(ends):
        if end < last:
            continue
        begin, stop = text.rfind("\n", 0, end) + 1, text.find("\n", end)
        last = stop if stop >= 0 else len(text)
        if residue_in_line(text[begin:last]):
            return "placeholder", []
    hints = notices.hints(words, low)
    latin = [w for w in words & _LATIN if len(w) > 3]
    if hints or latin:
        for line in low.split("\n"):
            if any(h in line for h in hints) or (latin and _latin_line(line)):
                got = notice_in_line(line, hints, bool(latin))
                if got:
                    said.append(line)
                if got and got[0] == "strong":
                    return got[1], said
    return None, said


def _latin_line(line: str) -> bool:
    known = [w in _LATIN and len(w) > 3 for w in _WORD.findall(line)]
    return sum(known) * 16 >= len(known) > 3


def detect(text: str | None) -> str | None:
    """The first kind of residue in a text, or None; NULL and empty texts hold none."""
    return examine(text)[0]


# Evidence of duplicated low information -------------------------------------------------------------------

#: The least evidence: so many addresses (ids) on so many hosts gave the text.
MIN_DOCS, MIN_HOSTS = 5, 3
#: A text answers an address or title if it holds terms with this share of their weight.
ANSWERED = 1 / 3
#: Without terms to judge by, a text must be this share of all documents of its hosts to be a response.
HOST_SHARE = 0.01
#: A term in more than this share of all urls or titles, and ten more, has no weight.
COMMON = 0.01

_FACTS = "doc_id long, host string, id string, kind string, title string, units array<struct<body:binary,words:array<string>>>"
_DIGITS = re.compile(r"\d+")


def _unit(text: str, words: set[str]) -> dict:
    """A 128-bit fingerprint of a text up to numbers and spaces, and its terms."""
    return {"body": blake2b(_DIGITS.sub("0", " ".join(text.split())).encode("utf-8", "replace"), digest_size=16).digest(), "words": [w for w in words if len(w) >= 4]}


def facts(df: DataFrame) -> DataFrame:
    """Per document: the residue found, the title line (NULL without a body below it), and as units the whole body and each
    line that is or may be a notice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, host, id_, text in zip(pdf["doc_id"], pdf["host"], pdf["id"], pdf["text"]):
                kind, title, units = None, None, []
                if text and text.strip():
                    low = _lower(text)
                    title, _, rest = low.strip().partition("\n")
                    title, rest = (" ".join(title.split()), rest) if rest else (None, title)
                    words = set(_WORD.findall(rest))
                    kind, said = examine(text, low, words.union(_WORD.findall(title)) if title else words)
                    units = [_unit(rest, words), *[_unit(x, set(_WORD.findall(x))) for x in dict.fromkeys(said) if x.split() != rest.split()]]
                rows.append((doc, host, id_, kind, title, units))
            yield pd.DataFrame(rows, columns=["doc_id", "host", "id", "kind", "title", "units"])

    return df.select("doc_id", "host", "id", "text").mapInPandas(run, _FACTS)


def _terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}]+"), lambda w: F.length(w) >= 4))


def slugs(inputs: DataFrame) -> DataFrame:
    """(id, url, terms): words of the path of each address; missing urls have none."""
    path = F.regexp_extract(F.lower(F.regexp_replace("url", r"[?#].*", "")), r"^[^/]*//[^/]+/(.*)$", 1)
    return inputs.select("id", "url", F.coalesce(_terms(path), F.array().cast("array<string>")).alias("terms"))


def _shares(asked: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, share): the share of the weight of a row's ``terms`` that its ``words`` hold; rows whose terms have no
    weight are left out.  A term weighs the more the fewer rows of ``every`` (terms) have it."""
    n = every.count()
    weight = every.select(F.explode("terms").alias("term")).groupBy("term").agg(F.greatest(F.lit(0.0), F.log((n * COMMON + 10) / F.count(F.lit(1)))).alias("w"))
    rows = asked.select(*keys, F.explode("terms").alias("term"), "words").select(*keys, "term", F.array_contains("words", F.col("term")).alias("held"))
    rows = materialize(rows)  # of suspects only
    used = materialize(weight.join(small_or_plain(rows.select("term").distinct()), "term", "left_semi"))
    got = lookup_small(rows, used, ["term"]).groupBy(*keys).agg(F.sum("w").alias("all__"), F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0)).alias("held__"))
    return got.filter("all__ > 0").select(*keys, (F.col("held__") / F.col("all__")).alias("share"))


def duplicated(f: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id) of texts that answer neither title nor slug and that many addresses on several hosts give.

    Texts of any length are compared whole.  A title that half of a body's documents have belongs to the response and
    says nothing; a title or slug of common words only can't be judged.  Besides repetition there must be evidence:
    half of the body's documents can be judged and answer nothing, or the body is ``HOST_SHARE`` of its hosts' documents.
    """
    has = f.select("doc_id", "host", "id", "title", F.inline("units"))
    ids = has.select("body", F.when(missing(F.col("id")), F.lit(None)).otherwise(F.col("id")).alias("id")).groupBy("body", "id").agg(F.count(F.lit(1)).alias("n"))
    # a document without an id is an address of its own
    often = ids.groupBy("body").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(1)).alias("addresses")).filter(F.col("addresses") >= MIN_DOCS)
    per_host = f.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("on_host"))
    often = materialize(often)
    hosts = has.filter(F.col("host").isNotNull()).select("body", "host").distinct().join(small_or_plain(often.select("body")), "body", "left_semi")
    hosts = hosts.join(per_host, "host").groupBy("body").agg(F.count(F.lit(1)).alias("hosts"), F.sum("on_host").alias("on_hosts")).filter(F.col("hosts") >= MIN_HOSTS)
    many = materialize(often.join(hosts, "body").select("body", "n", "on_hosts"))
    suspects = materialize(lookup_small(has, many, ["body"], "inner").withColumn("row__", F.monotonically_increasing_id()))  # one text may fill a third of all documents
    # the title is the response's own where half of the documents have it
    plain = F.regexp_replace("title", r"\d+", "0")
    own = suspects.filter("title is not null").groupBy("body", plain.alias("plain__"), "n").agg(F.count(F.lit(1)).alias("k")).filter("2 * k >= n").select("body", "plain__")
    titled = suspects.filter("title is not null").withColumn("plain__", plain).join(small_or_plain(own), ["body", "plain__"], "left_anti").withColumn("terms", _terms(F.col("title")))
    title = _shares(titled, f.filter("title is not null").select(_terms(F.col("title")).alias("terms")), ["row__"])
    # of several addresses the one answered best counts
    paths = slugs(inputs)
    wanted = suspects.filter(~missing(F.col("id"))).select("id").distinct()
    asked = suspects.select("row__", "id", "words").join(paths.join(small_or_plain(wanted), "id", "left_semi").distinct(), "id")
    slug = _shares(asked, paths, ["row__", "url"])
    best = title.unionByName(slug.select("row__", "share")).groupBy("row__").agg(F.max("share").alias("share"))
    judged = materialize(suspects.select("row__", "doc_id", "body", "n", "on_hosts").join(best, "row__", "left"))
    shown = judged.groupBy("body", "n", "on_hosts").agg(F.count(F.when(F.col("share") < ANSWERED, 1)).alias("unlike"))
    shown = shown.filter((2 * F.col("unlike") >= F.col("n")) | (F.col("n") >= HOST_SHARE * F.col("on_hosts"))).select("body")
    return lookup_small(judged.filter(F.coalesce(F.col("share"), F.lit(0.0)) < ANSWERED), shown, ["body"], "inner").select("doc_id").distinct()


def evidence(documents: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id, kind), one row per document and kind of evidence: placeholder, notice, filler, and ``duplicated`` from hosts.

    A document occurs once per row it has in ``documents``.  NULL and empty texts hold no residue; NULL hosts are no
    host, NULL ids have no slug; further columns do no harm; an empty table gives no rows.
    """
    f = materialize(facts(documents))  # the scan of all texts runs once
    own = f.filter(F.col("kind").isNotNull()).select("doc_id", "kind")
    return own.unionByName(duplicated(f, inputs).select("doc_id", F.lit("duplicated").alias("kind")))


def flagged(documents: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id, kind): ``evidence`` with one row per document, the kinds found in its text before that of the hosts.
    Documents without a doc_id are one."""
    return evidence(documents, inputs).groupBy("doc_id").agg(F.min_by("kind", F.when(F.col("kind") == "duplicated", 1).otherwise(0)).alias("kind"))


def cleaned(documents: DataFrame, inputs: DataFrame) -> DataFrame:
    """The documents without those flagged, all columns kept.  A document without a doc_id can't be named and stays."""
    return documents.join(flagged(documents, inputs).select("doc_id").distinct(), "doc_id", "left_anti")
