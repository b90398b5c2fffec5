"""HTML: text assembly and metadata as column expressions, and one table function for elements.

Parsing needs Python (a standard-library parser with implicit closing); it runs in Arrow batches, one pass per
page, and emits one row per link element.  All decisions on elements are column expressions over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import filters, urls
from . import patterns as P

_DEFAULT = Config()
MAX_LINKS = 500
MAX_LEVELS = 51


def html_text(c: Column) -> Column:
    """Lines of a body joined by blanks, without empty, one-character and blank lines; NULL if nothing is left."""
    kept = F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: (F.length(x) > 1) & ~x.rlike(r"\A\s+\z"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def meta_document_url(html: Column) -> Column:
    """Address of the document in the first fitting meta tag, its attributes in either order."""
    p = P.meta_url()
    return F.coalesce(F.nullif(F.regexp_extract(html, p, 1), F.lit("")), F.nullif(F.regexp_extract(html, p, 2), F.lit("")))


def meta_rights(html: Column) -> Column:
    """Access rights of all meta tags, each followed by `` -- ``; links and long texts are left out; NULL if none."""
    p = F.lit(P.meta_rights())
    both = F.arrays_zip(F.regexp_extract_all(html, p, F.lit(1)).alias("a"), F.regexp_extract_all(html, p, F.lit(2)).alias("b"))
    values = F.transform(both, lambda x: F.coalesce(F.nullif(x["a"], F.lit("")), x["b"]))
    kept = F.filter(values, lambda v: ~v.startswith("http") & (F.length(v) <= 200) & (v != ""))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, " -- "), F.lit(" -- ")))


def error_text(html: Column) -> Column:
    """Text of an error page without tags; NULL if empty or if the page has more than 10 000 characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " "), r"\s+", " "))
    return F.when(F.length(html) <= 10_000, F.nullif(bare, F.lit("")))


# Elements ------------------------------------------------------------------------------------------------

ELEMENT = (
    "pos int, tag string, cls string, el_id string, href string, action string, data_attr string, data_title string, type string, title string, text string, "
    "parent_text string, ancestors array<struct<tag:string,cls:string,id:string>>, structure string"
)
# Fixed values of HTML: elements without content, and what an opening tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}, "a": {"a"},
}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class _Node:
    __slots__ = ("tag", "attrs", "own", "text", "parent", "pos")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None, pos: int) -> None:
        self.tag, self.attrs, self.parent, self.pos = tag, attrs, parent, pos
        self.own: list[str] = []
        self.text: list[str] = []


class _Tree(HTMLParser):
    """Collects the link elements ``a``, ``link[href][type*=pdf]`` and ``form[action]`` with their ancestors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = [_Node("html", {}, None, -1)]
        self.found: list[_Node] = []
        self.raw = 0

    def _close(self, k: int) -> None:
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        a = {k: a[k] for k in dict.fromkeys(k for k, _ in attrs)}  # source order, first value of a name
        if tag in ("html", "body", "head"):
            if tag == "html":
                self.open[0].attrs = {**a, **self.open[0].attrs}
            elif tag == "body":
                self._close(1)
                self.open.append(_Node(tag, a, self.open[0], -1))
            else:
                self.open.append(_Node(tag, a, self.open[-1], -1))
            return
        if tag in _CLOSES_P:
            self._implied({"p"}, set())
        if tag in _CLOSES:
            self._implied(_CLOSES[tag], _SCOPE.get(tag, set()))
        n = _Node(tag, a, self.open[-1], len(self.found))
        if tag == "a" or (tag == "link" and a.get("href") is not None and "pdf" in a.get("type", "")) or (tag == "form" and "action" in a):
            self.found.append(n)
        if tag not in _VOID:
            self.open.append(n)
            self.raw += tag in ("script", "style")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def _implied(self, tags: set[str], stop: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._close(k)
                return
            if self.open[k].tag in stop or self.open[k].tag in ("body", "div", "td", "th", "table") and not stop:
                return

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.raw = max(0, self.raw - (tag in ("script", "style")))
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.raw:
            return
        self.open[-1].own.append(data)
        for n in self.open[1:]:
            n.text.append(data)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def elements_of(html: str | None) -> list[tuple]:
    """Rows of ``ELEMENT`` for a page; none for NULL."""
    if not html:
        return []
    t = _Tree()
    t.feed(html)
    t.close()
    rows = []
    for n in t.found:
        a, chain, up = n.attrs, [], n.parent
        while up is not None:
            chain.append((up.tag, up.attrs.get("class", "").strip(), up.attrs.get("id", "")))
            up = up.parent
        data = None  # the first attribute with data in its name and a value worth following; else the last of them (Q11)
        for k, v in a.items():
            if "data" in k and "data-follow-set" not in k:
                data = v.strip()
                if data and data != "#":
                    break
        steps = [(n.tag, a.get("class", "").strip())] + [(x[0], x[1]) for x in chain]
        structure = "".join(f"{g}_{c}\n" if c else f"{g}\n" for g, c in steps[:MAX_LEVELS])
        rows.append(
            (
                n.pos, n.tag, a.get("class", "").strip(), a.get("id", ""), a.get("href", "").strip(), a.get("action", "").strip(), data, a.get("data-title", ""),
                a.get("type", "").strip(), a.get("title", "").strip(), _squeeze(n.text), _squeeze(n.parent.own) if n.parent else "",
                [{"tag": g, "cls": c, "id": i} for g, c, i in chain], structure,
            )
        )
    return rows


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per link element of each page: ``page_key``, ``page_url`` and ``ELEMENT``."""
    names = ["page_key", "page_url"] + [c.split()[0] for c in ELEMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, u, *r) for k, u, h in zip(pdf["k"], pdf["u"], pdf["h"]) for r in elements_of(h)]
            yield pd.DataFrame(rows, columns=names)

    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    return rows.mapInPandas(run, f"page_key string, page_url string, {ELEMENT}")


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == "#")


def href_or_data(e=F.col) -> Column:
    """The href, else the data attribute (which may be empty, Q11)."""
    return F.when(_blank(e("href")), e("data_attr")).otherwise(e("href"))


def form_target(config: Config = _DEFAULT) -> Column:
    """The action of a form that names a wanted file.  Q10: read literally with both kinds wanted, it must fit both."""
    low = F.lower(F.col("action"))
    doc, data = filters.document_candidate(low), filters.dataset_candidate(low, config)
    if config.documents and config.datasets:
        fits = doc & data if config.strict_reference else doc | data
    else:
        fits = doc if config.documents else data
    return F.when(~_blank(F.col("action")) & fits, F.col("action"))


def element_decisions(el: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """``decision`` and ``link`` of each element: skip, found, invalid, dynamic or gather.

    The checks follow one order: structure; text, title and type of document links; then the link itself.  Parts
    that several checks use are columns of their own.
    """
    from .mime import document_mimes

    page = F.col("page_url")
    s1 = el.select("*", href_or_data().alias("link__"), form_target(config).alias("form__"), F.lower(F.trim("text")).alias("text__"), F.lower(F.trim("title")).alias("title__"))
    aim = F.coalesce(F.when(_blank(F.col("link__")), F.col("form__")), F.col("link__"))
    s2 = s1.select("*", F.coalesce(urls.resolve_simple(page, aim), aim).alias("aim__"), F.lower("link__").alias("low__"))
    # the dear patterns run only where a check asks for their answer
    kinds = F.col("type").isin(*document_mimes(config))
    asks = filters.document_text(F.col("text__")) | filters.document_text(F.col("title__")) | kinds | (_blank(F.col("link__")) & F.col("form__").isNotNull())
    s3 = s2.select("*", F.when(asks, F.coalesce(filters.accept_internal_link(F.col("aim__"), config), F.lit(True))).alias("fits__"), F.when(F.col("low__").contains("#"), filters.target_candidate(F.col("low__"), config)).alias("wanted__"))
    link, low, fits = F.col("link__"), F.col("low__"), F.col("fits__")
    bad_place = (
        filters.cross_domain_state(F.col("cls"), F.col("href"), page) | ((F.col("parent_text") != "") & filters.not_a_document(F.lower("parent_text"))) | filters.bad_ancestors(F.col("ancestors"))
    )

    def worded(t: Column) -> Column:
        """NULL: this text does not decide."""
        named = F.when(F.coalesce(link, F.lit("")) == "", "skip").when(low.startswith("javascript:"), "skip").when(fits, "found").otherwise("invalid")
        return F.when(t == "", None).when(filters.not_a_document(t), "skip").when(filters.document_text(t), named)

    typed = F.when(kinds, F.when(_blank(F.col("href")) | ~fits, "invalid").otherwise("found"))
    by_word = F.coalesce(worded(F.col("text__")), worded(F.col("title__")), typed) if config.documents else F.lit(None).cast("string")
    s4 = s3.select("*", F.coalesce(bad_place, F.lit(False)).alias("bad__"), by_word.alias("word__"), F.regexp_extract("link__", P.full(P.SCRIPT_PDF_LINK), 1).alias("script__"))
    gathered = (
        F.when(_blank(link), F.when(F.col("form__").isNull(), "skip").when(fits, "found").otherwise("invalid")).when(link == "/", "skip").when(filters.dynamic_link(link), "dynamic")
        .when(filters.link_prefix(low), "skip").when(low.contains("#"), F.when(F.col("wanted__") | low.contains("/#/"), "gather").otherwise("skip"))
        .when(low.contains('"') | low.contains("[error"), "skip").when(low.startswith("javascript:"), F.when(F.col("script__") != "", "found").otherwise("skip")).otherwise("gather")
    )
    s5 = s4.select("*", F.when(F.col("bad__"), "skip").otherwise(F.coalesce("word__", gathered)).alias("decision"))
    chosen = (
        F.when(F.col("word__").isNotNull(), urls.view_to_download(link)).when(_blank(link), F.col("form__")).when(low.startswith("javascript:"), F.nullif(F.col("script__"), F.lit("")))
        .when(low.contains("#") & F.col("wanted__"), urls.strip_anchor(link)).otherwise(link)
    )
    return s5.select(*el.columns, "decision", F.when(F.col("decision").isin("found", "invalid", "gather"), chosen).alias("link"))
