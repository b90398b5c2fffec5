"""Queries over addresses: parts, rewrites, special sites, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import filters, special_sites, urls
from ..functions import patterns as P
from ..shared import table
from . import filter_sql

S, D = SparkSession, DataFrame


def _urls(spark: S, d: str) -> D:
    """Distinct-free view of all source urls with their key."""
    return table(spark, d, "output_record").select("record_id", F.col("sourceurl").alias("u"))


def _made(spark: S, d: str) -> D:
    """Addresses with tokens, anchors, ports and special forms, made from columns of the input pairs."""
    t = table(spark, d, "sample_input").select("seq", "id", "url")
    k = F.pmod("seq", F.lit(8))
    s = F.col("seq").cast("string")
    made = (
        F.when(k == 0, F.concat(F.lit("http://x.org/a;jsessionid="), s, F.lit("?x=1"))).when(k == 1, F.concat(F.lit("https://r.example.org/doc?token=AB"), s, F.lit("&p=2")))
        .when(k == 2, F.concat(F.lit("https://e.org/view/"), s, F.lit("#sec"))).when(k == 3, F.concat(F.lit("https://e.org/#/detail/"), s))
        .when(k == 4, F.concat(F.lit("http://ir.lib.u-ryukyu.ac.jp/handle/123456789/"), s)).when(k == 5, F.concat(F.lit("https://a.b.c.d.org:8080/p?a=1&amp;b="), s))
        .when(k == 6, F.concat(F.lit("https://e.org/files/"), s, F.lit(".pdf"))).otherwise(F.concat(F.lit("https://e.org/amp%3Bx/"), s))
    )
    return t.select("seq", made.alias("u"))


_MADE_SQL = """made AS (SELECT seq, CASE seq % 8 WHEN 0 THEN 'http://x.org/a;jsessionid=' || seq || '?x=1' WHEN 1 THEN 'https://r.example.org/doc?token=AB' || seq || '&p=2'
  WHEN 2 THEN 'https://e.org/view/' || seq || '#sec' WHEN 3 THEN 'https://e.org/#/detail/' || seq WHEN 4 THEN 'http://ir.lib.u-ryukyu.ac.jp/handle/123456789/' || seq
  WHEN 5 THEN 'https://a.b.c.d.org:8080/p?a=1&amp;b=' || seq WHEN 6 THEN 'https://e.org/files/' || seq || '.pdf' ELSE 'https://e.org/amp%3Bx/' || seq END AS u FROM sample_input)"""


def _q(text: str) -> str:
    return text.replace("'", "''")


_T = _q("(?i)" + P.full(P.URL_TRIPLE))
_M = r"regexp_replace({0}, '/\z', '')"


def _dom(c: str) -> str:
    return f"lower(nullif(regexp_extract({_M.format(c)}, '{_T}', 2), ''))"


def _pth(c: str) -> str:
    return f"nullif(regexp_extract({_M.format(c)}, '{_T}', 1), '')"


def _did(c: str) -> str:
    return f"nullif(regexp_extract({_M.format(c)}, '{_T}', 3), '')"


def url_parts(spark: S, d: str) -> D:
    """URL1-4."""
    u = F.col("u")
    return _urls(spark, d).select("record_id", urls.is_url(u).alias("matches"), urls.domain(u).alias("domain"), urls.path(u).alias("path"), urls.doc_id(u).alias("doc_id"))


def url_top3(spark: S, d: str) -> D:
    """URL5: rows per last three domain levels."""
    return _urls(spark, d).select(urls.top_three_levels(urls.domain(F.col("u"))).alias("site")).groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"))


def url_strip_token(spark: S, d: str) -> D:
    """URL6, URL8."""
    return _made(spark, d).select("seq", urls.has_temporal_id(F.col("u")).alias("gated"), urls.strip_temporal_id(F.col("u")).alias("bare"))


def url_strip_anchor(spark: S, d: str) -> D:
    """URL7."""
    return _made(spark, d).select("seq", urls.strip_anchor(F.col("u")).alias("bare"))


def url_repairs(spark: S, d: str) -> D:
    """URL9-11."""
    u = F.col("u")
    return _made(spark, d).select("seq", urls.repair_ampersands(u).alias("repaired"), urls.drop_encoded_ampersands(u).alias("dropped"), urls.needs_get(u).alias("needs_get"), urls.rewrite_handle(u).alias("handle"))


def url_rules_input(spark: S, d: str) -> D:
    """URL6-9, 11 on all input urls as they are written."""
    u = F.col("url")
    return table(spark, d, "sample_input").select("seq", urls.strip_temporal_id(u).alias("bare"), urls.strip_anchor(u).alias("unanchored"), urls.rewrite_handle(u).alias("handle"))


def url_normalized(spark: S, d: str) -> D:
    """URL12: canonical form; addresses that have none are rejected."""
    return _urls(spark, d).select("record_id", urls.normalize("u").alias("canonical"))


def _links() -> Column:
    k = F.pmod("record_id", F.lit(4))
    return F.when(k == 0, "/files/x.pdf").when(k == 1, "?view=pdf&amp;n=1").when(k == 2, "https://other.example/y.pdf").otherwise("//cdn.example/z.pdf")


def link_resolve(spark: S, d: str) -> D:
    """URL13: links of several forms against plain pages, as its SQL has it; all pages are in ``link_resolve_all``."""
    t = table(spark, d, "output_record").filter("pageurl is not null and pageurl <> 'null'").select("record_id", F.lower(F.regexp_replace("pageurl", r"[^\x21-\x7e]", "")).alias("page"))
    link = _links()
    good = F.col("page").rlike("^https?://[a-z0-9.-]+/[^?#]*$")
    return t.filter(good).select("record_id", urls.resolve(F.col("page"), link).alias("target"), (urls.resolve_exact(F.col("page"), link) == urls.resolve(F.col("page"), link)).alias("agrees"))


def link_resolve_all(spark: S, d: str) -> D:
    """URL13: links of several forms against every present page as it is written."""
    t = table(spark, d, "output_record").filter("pageurl is not null and pageurl <> 'null'").select("record_id", "pageurl")
    return t.select("record_id", urls.resolve(F.col("pageurl"), _links()).alias("target"))


def url_redirect_kinds(spark: S, d: str) -> D:
    """URL14-16 between the source and page url of each record."""
    a, b = F.col("sourceurl"), F.col("pageurl")
    t = table(spark, d, "output_record")
    return t.filter(a.isNotNull() & b.isNotNull()).select("record_id", urls.https_redirect(a, b).alias("https"), urls.slash_redirect(a, b).alias("slash"), urls.same_but_protocol(a, b).alias("protocol"))


def direct_link_flag(spark: S, d: str) -> D:
    """URL17 recomputed for found records."""
    t = table(spark, d, "output_record").filter("docordataseturl like 'http%' and pageurl is not null")
    special = special_sites.rewrite(F.col("sourceurl")) != F.col("sourceurl")
    return t.select("record_id", urls.direct_link(F.col("sourceurl"), F.col("pageurl"), F.col("docordataseturl"), F.lit(True), special).alias("direct"))


def url_offline_upgrade(spark: S, d: str) -> D:
    """URL18, JN9: what redirects taught about a domain, applied to all its addresses."""
    from ..operators import breakers

    t = table(spark, d, "output_record").filter("pageurl is not null")
    known = breakers.capabilities(t.select(
        urls.domain(F.col("sourceurl")).alias("domain"), F.lit(200).alias("status"), F.lit("GET").alias("method"), F.col("sourceurl").alias("from_url"), F.col("pageurl").alias("to_url"), F.lit(False).alias("version_error"),
    ))
    return breakers.upgraded(t.select("record_id", urls.domain(F.col("sourceurl")).alias("domain"), F.col("sourceurl").alias("url")), known).select("record_id", "url")


def url_text_rules(spark: S, d: str) -> D:
    """URL19-22: local hosts, request encoding, view pages and extensions."""
    u = F.col("u")
    t = _made(spark, d)
    local = F.replace(u, F.lit("//e.org"), F.lit("//localhost:8080"))
    return t.select("seq", urls.replace_localhost(local, F.lit("repo.example.org")).alias("global"), urls.ascii_encode(F.concat(u, F.lit(" é"))).alias("encoded"), urls.view_to_download(u).alias("download"), urls.extension(urls.doc_id(u)).alias("extension"))


#: One address of each special site and some forms of it; '#' stands for a number.
SPECIAL = (
    "https://europepmc.org/articles/PMC#", "https://europepmc.org/abstract/pmc/#", "https://manuscript.elsevier.com/S#/pdf/S#.pdf", "https://ntrs.nasa.gov/citations/#",
    "https://www.frontiersin.org/articles/10.3389/fx.#/full", "https://www.frontiersin.org/articles/10.3389/fx.#", "https://psyarxiv.com/a#/", "https://psyarxiv.com/a#",
    "https://www.ijcseonline.org/pdf_paper_view.php?paper_id=#&48-IJ-#.pdf", "https://ieeexplore.ieee.org/document/#", "https://osf.io/b#/", "https://onlinelibrary.wiley.com/doi/full/10.1002/x.#",
    "https://onlinelibrary.wiley.com/doi/abs/10.1002/x.#", "https://onlinelibrary.wiley.com/doi/10.1002/x.#/abstract", "https://x.onlinelibrary.wiley.com/doi/epdf/10.1002/x.#",
    "https://www.scielo.br/j/a#/?lang=en&amp;format=pdf", "https://doi.org/https:/repo.example.org/#", "https://dergipark.gov.tr/tr/pub/x/issue/#", "https://api.wiley.com/onlinelibrary/tdm/v1/articles/x#",
    "https://ordinary.example.org/item/#",
)
_N = len(SPECIAL)


def special_site_rewrite(spark: S, d: str) -> D:
    """SPU1-13: forms of special addresses, numbered by the input rows."""
    forms = F.array(*[F.lit(x) for x in SPECIAL])
    t = table(spark, d, "sample_input").select("seq", F.replace(F.element_at(forms, (F.pmod("seq", F.lit(_N)) + 1).cast("int")), F.lit("#"), F.col("seq").cast("string")).alias("u"))
    return t.select("seq", special_sites.rewrite(F.col("u")).alias("asked"), F.coalesce(special_sites.embopress(F.replace(F.col("u"), F.lit("ordinary.example.org"), F.lit("www.embopress.org/pdfdirect"))), F.lit("")).alias("embo"))


_SPECIAL_OUT = (
    "http://europepmc.org/backend/ptpmcrender.fcgi?accid=PMC#&blobtype=pdf", "http://europepmc.org/backend/ptpmcrender.fcgi?accid=PMC#&blobtype=pdf", "http://manuscript.elsevier.com/S#/pdf/S#.pdf",
    "https://ntrs.nasa.gov/api/citations/#/downloads/#.pdf", "https://www.frontiersin.org/articles/10.3389/fx.#/pdf", "https://www.frontiersin.org/articles/10.3389/fx.#/pdf", "https://psyarxiv.com/a#/download",
    "https://psyarxiv.com/a#/download", "https://www.ijcseonline.org/pub_paper/48-IJ-#.pdf", "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=#", "https://osf.io/b#/download",
    "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/x.#?download=true", "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/x.#?download=true",
    "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/x.#?download=true", "https://x.onlinelibrary.wiley.com/doi/pdfdirect/10.1002/x.#?download=true",
    "https://www.scielo.br/j/a#/?lang=en&&format=pdf", "https://repo.example.org/#", "https://dergipark.org.tr/tr/pub/x/issue/#", "https://onlinelibrary.wiley.com/doi/pdfdirect/x#?download=true", "https://ordinary.example.org/item/#",
)


def special_site_dead(spark: S, d: str) -> D:
    """SPU4: addresses of a site that are known to lead nowhere."""
    t = table(spark, d, "sample_input").select("seq", F.concat(F.when(F.pmod("seq", F.lit(2)) == 0, "https://www.frontiersin.org/people/u/").otherwise("https://www.frontiersin.org/articles/"), F.col("seq").cast("string")).alias("u"))
    return t.filter(special_sites.is_known_dead(F.col("u"))).select("seq")


_RE2 = {  # patterns without look-around
    "plain_domain": P.full(P.PLAIN_DOMAIN), "document": P.full(P.document_url()), "dataset": P.full(P.dataset_url()), "keywords": P.full(P.LINK_WORDS),
    "format": P.full(P.file_format(Config())), "unsupported": P.full(P.unsupported_document()), "prefix": P.full(P.LINK_STARTS),
}


def filter_flags(spark: S, d: str) -> D:
    """FLT5, 7, 8, 10-12, 15 and 27 on all source urls."""
    low = F.lower("u")
    return _urls(spark, d).select(
        "record_id", filters.plain_domain(low).alias("plain_domain"), filters.document_candidate(low).alias("document"), filters.dataset_candidate(low).alias("dataset"),
        filters.link_keywords(low).alias("keywords"), filters.file_format(low).alias("format"), filters.unsupported_document(low).alias("unsupported"), filters.link_prefix(low).alias("prefix"),
    )


def filter_lookaround(spark: S, d: str) -> D:
    """FLT3, 4, 6, 9, 13: the patterns with look-around."""
    low = F.lower("u")
    return _urls(spark, d).select(
        "record_id", filters.directory(low).alias("directory"), filters.specific_domain(low).alias("domain"), filters.irrelevant_extension(low).alias("extension"),
        filters.plain_page(low).alias("plain_page"), filters.not_a_document(low).alias("not_a_document"),
    )


def reject_reasons(spark: S, d: str) -> D:
    """FLT1: rows per reason, decided once per distinct url."""
    per = _urls(spark, d).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(filters.reject_reason(F.col("u")).alias("reason")).agg(F.sum("n").alias("n_rows"))


def accepted_links(spark: S, d: str) -> D:
    """FLT2: source urls that would be acceptable as internal links."""
    return _urls(spark, d).filter(filters.accept_internal_link(F.col("u"))).select("record_id")


def access_rights(spark: S, d: str) -> D:
    """FLT21 on rights texts made from the rows."""
    words = ("info:eu-repo/semantics/restrictedAccess", "Open Access", "embargoed access", "inaccessible", "closed", "metadata only access", "not accessible", "acceso cerrado")
    a = F.array(*[F.lit(w) for w in words])
    t = table(spark, d, "sample_input").select("seq", F.element_at(a, (F.pmod("seq", F.lit(len(words))) + 1).cast("int")).alias("rights"))
    return t.select("seq", filters.no_access(F.col("rights")).alias("reason"))


def content_size_gate(spark: S, d: str) -> D:
    """FLT24, MAC14 on sizes of the outcome records; malformed sizes count as not given."""
    from ..functions import forms, mime

    t = table(spark, d, "output_record").select("record_id", forms.size_value(F.col("filesize")).alias("n"))
    return t.select("record_id", filters.content_size(F.col("n"), F.lit(True)).alias("full_text"), filters.content_size(F.col("n"), F.lit(False)).alias("page"), mime.download_budget_ms(F.col("n")).cast("bigint").alias("budget_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, url_top3, url_strip_token, url_strip_anchor, url_repairs, url_rules_input, url_normalized, link_resolve, link_resolve_all, url_redirect_kinds, direct_link_flag, url_offline_upgrade, url_text_rules, special_site_rewrite,
        special_site_dead, filter_flags, filter_lookaround, reject_reasons, accepted_links, access_rights, content_size_gate,
    )
}

_TOK = _q("(?i)" + P.full(P.TEMPORAL_ID))
_PROTO = _q(P.full(P.PROTOCOL_FREE))


def _same(a: str, b: str) -> str:
    g = lambda c: f"nullif(regexp_extract({c}, '{_PROTO}', 1), '')"
    return f"coalesce({g(a)} = {g(b)}, false)"


def _special_case() -> str:
    return "CASE seq % " + str(_N) + " " + " ".join(f"WHEN {k} THEN replace('{o}', '#', CAST(seq AS VARCHAR))" for k, o in enumerate(_SPECIAL_OUT)) + " END"


_HTTPS = f"(sourceurl LIKE 'http://%' AND pageurl LIKE 'https://%' AND {_same('sourceurl', 'pageurl')})"
_SLASH = "(sourceurl NOT LIKE '%/' AND pageurl = sourceurl || '/')"
_END = _q(P.full(P.SLASH_OR_EXTENSION))

SQL = {
    "url_parts": f"SELECT record_id, regexp_matches({_M.format('sourceurl')}, '{_T}') AS matches, {_dom('sourceurl')} AS domain, {_pth('sourceurl')} AS path, {_did('sourceurl')} AS doc_id FROM output_record",
    "url_top3": f"""WITH t AS (SELECT {_dom('sourceurl')} AS d FROM output_record)
SELECT coalesce(nullif(regexp_extract(d, '{_q(P.full(P.TOP_THREE))}', 1), ''), d) AS site, count(*) AS n_rows FROM t GROUP BY ALL""",
    "filter_lookaround": f"SELECT record_id, {filter_sql.directory('u')} AS directory, {filter_sql.specific_domain('u')} AS domain, {filter_sql.irrelevant_extension('u')} AS extension, {filter_sql.plain_page('u')} AS plain_page, {filter_sql.not_a_document('u')} AS not_a_document FROM (SELECT record_id, lower(sourceurl) AS u FROM output_record)",
    "reject_reasons": f"SELECT CASE WHEN u IS NOT NULL THEN {filter_sql.reject_reason('u')} END AS reason, count(*) AS n_rows FROM (SELECT lower(sourceurl) AS u FROM output_record) GROUP BY ALL",
    "accepted_links": f"SELECT record_id FROM (SELECT record_id, lower(sourceurl) AS u FROM output_record) WHERE {filter_sql.accept_internal_link('u')}",
    "url_text_rules": f"""WITH {_MADE_SQL} SELECT seq, CASE WHEN seq % 8 IN (2, 3, 6, 7) THEN replace(u, '//e.org', '//repo.example.org') ELSE u END AS global, u || '%20%C3%A9' AS encoded,
  CASE WHEN seq % 8 = 2 THEN replace(u, '/view/', '/download/') ELSE u END AS download, CASE WHEN seq % 8 = 6 THEN '.pdf' END AS extension FROM made""",
    "url_normalized": r"""WITH t AS (SELECT record_id, regexp_replace(regexp_replace(sourceurl, '^[\s\x{a0}\x{2003}]+|[\s\x{a0}\x{2003}]+$', '', 'g'), '[\t\r\n]', '', 'g') AS u FROM output_record),
p AS (SELECT record_id, lower(regexp_extract(u, '(?i)^(https?)://', 1)) AS s, lower(regexp_extract(u, '(?i)^https?://([^/?#:]+)', 1)) AS h, regexp_extract(u, '(?i)^https?://[^/?#:]+:([0-9]+)', 1) AS port,
  regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]+(.*)$', 1), '#.*$', ''), '/\.$', '/'), ' ', '%20'), '–', '%E2%80%93'), chr(8195), '%E2%80%83'), '\?$', '') AS r FROM t)
SELECT record_id, CASE WHEN h <> '' THEN s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || CASE WHEN r LIKE '/%' THEN '' ELSE '/' END || r END AS canonical FROM p""",
    "url_rules_input": rf"""WITH x AS (SELECT seq, url AS u, lower(url) LIKE '%token%' OR lower(url) LIKE '%jsessionid%' AS gated, regexp_extract(url, '{_TOK}', 1) AS b, regexp_extract(url, '{_TOK}', 2) AS a FROM sample_input)
SELECT seq, CASE WHEN gated AND b <> '' THEN b || CASE WHEN a LIKE '&%' AND b NOT LIKE '%?%' THEN '?' || substr(a, 2) ELSE a END ELSE u END AS bare, coalesce(nullif(regexp_extract(u, '\A(.+)(#[^/
].*)\z', 1), ''), u) AS unanchored,
  CASE WHEN contains(u, 'ir.lib.u-ryukyu.ac.jp') AND contains(u, '/handle/123456789/') THEN replace(u, '/123456789/', '/20.500.12000/') ELSE replace(u, 'amp;', '&') END AS handle FROM x""",
    "url_strip_token": f"""WITH {_MADE_SQL}, x AS (SELECT seq, u, lower(u) LIKE '%token%' OR lower(u) LIKE '%jsessionid%' AS gated, regexp_extract(u, '{_TOK}', 1) AS b, regexp_extract(u, '{_TOK}', 2) AS a FROM made)
SELECT seq, gated, CASE WHEN gated AND b <> '' THEN b || CASE WHEN a LIKE '&%' AND b NOT LIKE '%?%' THEN '?' || substr(a, 2) ELSE a END ELSE u END AS bare FROM x""",
    "url_strip_anchor": rf"""WITH {_MADE_SQL} SELECT seq, coalesce(nullif(regexp_extract(u, '\A(.+)(#[^/\n].*)\z', 1), ''), u) AS bare FROM made""",
    "url_repairs": f"""WITH {_MADE_SQL} SELECT seq, replace(u, 'amp;', '&') AS repaired, replace(u, 'amp%3B', '') AS dropped, contains(u, 'amp%3B') AS needs_get,
  CASE WHEN contains(u, 'ir.lib.u-ryukyu.ac.jp') AND contains(u, '/handle/123456789/') THEN replace(u, '/123456789/', '/20.500.12000/') ELSE replace(u, 'amp;', '&') END AS handle FROM made""",
    "link_resolve": r"""WITH t AS (SELECT record_id, lower(regexp_replace(pageurl, '[^\x21-\x7e]', '', 'g')) AS page FROM output_record WHERE pageurl IS NOT NULL AND pageurl <> 'null'),
g AS (SELECT * FROM t WHERE regexp_matches(page, '^https?://[a-z0-9.-]+/[^?#]*$'))
SELECT record_id, CASE record_id % 4 WHEN 0 THEN regexp_extract(page, '^(https?://[^/?#]+)', 1) || '/files/x.pdf' WHEN 1 THEN page || '?view=pdf&&n=1'
  WHEN 2 THEN 'https://other.example/y.pdf' ELSE regexp_extract(page, '^(https?:)', 1) || '//cdn.example/z.pdf' END AS target, true AS agrees FROM g""",
    "link_resolve_all": r"""WITH t AS (SELECT record_id, pageurl AS p, regexp_replace(regexp_replace(pageurl, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g') AS b FROM output_record WHERE pageurl IS NOT NULL AND pageurl <> 'null'),
u AS (SELECT *, lower(regexp_extract(b, '(?i)^(https?):', 1)) AS s, regexp_extract(b, '(?i)^https?://([^/?#]+)', 1) AS h FROM t)
SELECT record_id, CASE record_id % 4 WHEN 0 THEN CASE WHEN s <> '' THEN s || '://' || h || '/files/x.pdf' ELSE '/files/x.pdf' END WHEN 1 THEN p || '?view=pdf&&n=1' WHEN 2 THEN 'https://other.example/y.pdf' ELSE CASE WHEN s <> '' THEN s || '://cdn.example/z.pdf' ELSE '//cdn.example/z.pdf' END END AS target FROM u""",
    "url_redirect_kinds": f"SELECT record_id, {_HTTPS} AS https, {_SLASH} AS slash, {_same('sourceurl', 'pageurl')} AS protocol FROM output_record WHERE sourceurl IS NOT NULL AND pageurl IS NOT NULL",
    "direct_link_flag": f"""SELECT record_id, CASE WHEN pageurl = docordataseturl OR {_same('pageurl', 'docordataseturl')} OR sourceurl = docordataseturl OR {_same('sourceurl', 'docordataseturl')}
  THEN 'true' ELSE 'null' END AS direct FROM output_record WHERE docordataseturl LIKE 'http%' AND pageurl IS NOT NULL""",
    "url_offline_upgrade": f"""WITH t AS (SELECT record_id, sourceurl, {_dom('sourceurl')} AS d, {_HTTPS} AS h, {_SLASH} AS s FROM output_record WHERE pageurl IS NOT NULL),
k AS (SELECT d, bool_or(h) AS h, bool_or(s) AS s FROM t WHERE d IS NOT NULL GROUP BY d),
u AS (SELECT record_id, CASE WHEN coalesce(k.h, false) AND sourceurl NOT LIKE 'https:%' THEN regexp_replace(sourceurl, '^([^:]*?)http:', '\\1https:') ELSE sourceurl END AS x, coalesce(k.s, false) AS s FROM t LEFT JOIN k USING (d))
SELECT record_id, CASE WHEN s AND NOT regexp_matches(x, '{_END}') THEN x || '/' ELSE x END AS url FROM u""",
    "special_site_rewrite": f"SELECT seq, {_special_case()} AS asked, CASE WHEN seq % {_N} = {_N - 1} THEN 'https://www.embopress.org/pdf/item/' || seq ELSE '' END AS embo FROM sample_input",
    "special_site_dead": "SELECT seq FROM sample_input WHERE seq % 2 = 0",
    "filter_flags": "SELECT record_id, " + ", ".join(f"regexp_matches(lower(sourceurl), '{_q(p)}') AS {k}" for k, p in _RE2.items()) + " FROM output_record",
    "access_rights": """SELECT seq, CASE seq % 8 WHEN 0 THEN 'restricted' WHEN 2 THEN 'embargoed' WHEN 3 THEN 'prohibited' WHEN 4 THEN 'closed' WHEN 5 THEN 'metadata only' WHEN 6 THEN 'prohibited' WHEN 7 THEN 'prohibited' END AS reason FROM sample_input""",
    "content_size_gate": """WITH t AS (SELECT record_id, CASE WHEN regexp_full_match(filesize, '[1-9][0-9]{0,8}') AND TRY_CAST(filesize AS BIGINT) <= 536870912 THEN TRY_CAST(filesize AS BIGINT) END AS n FROM output_record)
SELECT record_id, CASE WHEN n IS NULL THEN -2 WHEN n <= 0 OR n > 536870912 THEN -1 ELSE n END AS full_text, CASE WHEN n IS NULL THEN -2 WHEN n <= 0 OR n > 5242880 THEN -1 ELSE n END AS page,
  CASE WHEN coalesce(n, -2) <= 52428800 THEN 45000 WHEN n <= 104857600 THEN 70000 WHEN n <= 209715200 THEN 140000 WHEN n <= 314572800 THEN 210000 ELSE 330000 END::BIGINT AS budget_ms FROM t""",
}
