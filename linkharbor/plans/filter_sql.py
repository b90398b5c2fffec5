"""The address filters for SQL without look-around: each such condition is a pattern that must match and one that must not.

``u`` is an SQL expression of an address in lower case.
"""

from __future__ import annotations

from ..config import Config
from ..functions import patterns as P

_FILE = P.any_of(P.DOC_WORDS, "dataset")


def quoted(text: str) -> str:
    return text.replace("'", "''")


def hit(u: str, pattern: str) -> str:
    return f"regexp_matches({u}, '{quoted(pattern)}')"


def _but(u: str, pattern: str, unless: str) -> str:
    return f"({hit(u, pattern)} AND NOT {hit(u, unless)})"


def _any(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _away(u: str, pattern: str, word: str) -> str:
    """A word with no other that promises a file after it, or before it with nothing but path characters between."""
    return f"({hit(u, pattern)} AND NOT {hit(u, rf'{_FILE}[\w/_.,-]*{word}')} AND NOT {hit(u, rf'{word}.*{_FILE}')})"


def directory(u: str, c: Config = Config()) -> str:
    at = lambda inside: rf"\A^https?://.*/(?:{inside}.*$)\z"
    plain = [x.replace("(?![./]+)", "(?:[^./]|$)").replace("(?<!response_type=)", "") for x in (*P.DIRECTORY_STARTS, *P.DIRECTORY_STARTS_2, *P.DIRECTORY_STARTS_3, *P.DIRECTORY_STARTS_4) if "polic" not in x and "citation" not in x]
    plain += [r"ethic(?:s)?/.*/view/", P.any_of(*P.DIRECTORY_ENDS) + "[/]?$", P.any_of(*P.ERROR_PAGES) + r"\." + P.WEB_PAGE, ".*sharedsitesession", "doi.org/https://doi.org/.*pangaea."]
    away = [_away(u, at(x), "/" + x) for x in (P.any_of(*P.DIRECTORY_UNLESS_FILE) + "/", "aut[h]?or")] + [_away(u, at(".*/view/"), "/view/")]
    return _any(
        hit(u, at(P.any_of(*plain))), *away, _but(u, at(r"(?:site-)?polic(?:y|ies)"), r"polic(?:y|ies).*paper"), _but(u, at("citation"), r"ntrs.nasa.gov/(?:api/)?citation")
    )


def specific_domain(u: str) -> str:
    at = lambda names: rf"\A^https?://(?:[^/]*\.)?{P.any_of(*names)}[^/]*/.*$\z"
    every = [*P.DOMAINS, *P.DOMAINS_NOT_FOR_HTML, *P.DOMAINS_LAST, *P.DOMAINS_SCRIPT, *P.DOMAINS_RESULT_PAGES, *P.DOMAINS_TEXT_IN_HTML, *P.DOMAINS_METADATA_ONLY, *P.DOMAINS_LOGIN, *P.DOMAINS_DEEPER, *P.DOMAINS_UNREACHABLE]
    odd = {r"google\.": "drive.google", "wordpress": "files.wordpress", "elsevier.com": "manuscript.elsevier"}
    plain = [x for x in every if "(?<!" not in x]
    return _any(hit(u, at(plain)), *[_but(u, at([name]), not_) for name, not_ in odd.items()], _away(u, at(["scielosp.org"]), "scielosp.org"))


def _domain_reason(u: str) -> str:
    at = lambda names: rf"\A^https?://(?:[^/]*\.)?{P.any_of(*names)}[^/]*/.*$\z"
    groups = (("script domain", P.DOMAINS_SCRIPT), ("result page", P.DOMAINS_RESULT_PAGES), ("text in html", P.DOMAINS_TEXT_IN_HTML), ("no documents", P.DOMAINS_METADATA_ONLY), ("login", P.DOMAINS_LOGIN), ("larger depth", ("scielosp.org", *P.DOMAINS_DEEPER)), ("connectivity", P.DOMAINS_UNREACHABLE))
    return "CASE " + " ".join(f"WHEN {hit(u, at(names))} THEN '{r}'" for r, names in groups) + " ELSE 'domain' END"


def irrelevant_extension(u: str) -> str:
    names = ("css", r"js(?:\?y)?", *P.MEDIA, *P.PAGE_EXTENSIONS_IRRELEVANT, *P.PAGE_EXTENSIONS_CODE)
    at = lambda x: rf"\A.+\.{x}(?:\?.+)?$\z"
    return _any(hit(u, at(P.any_of(*names))), _away(u, at("cc"), r"\.cc"))


def plain_page(u: str) -> str:
    ext = rf"\.(?:{P.WEB_PAGE}|[aj]sp[x]?|jsf|do|asc|cgi|cfm)"
    return f"({hit(u, rf'\A.+{ext}(?:\?.*)?$\z')} AND NOT {hit(u, rf'{_FILE}{ext}(?:\?.*)?$')} AND NOT {hit(u, rf'{ext}\?.*{_FILE}')})"


def not_a_document(u: str) -> str:
    gaps = lambda words: [w.replace(" ", P.SPACES) for w in words]
    plain = [w.replace("osit(?!ed|s)", "osit(?:$|[^es]|e$|e[^d])") for w in P.NOT_A_DOCUMENT if not w.startswith(("(?<!readonly_)", "agreement(?!", "poli(?:"))]
    alone, files = "^" + P.any_of(*gaps(P.NOT_A_DOCUMENT_ALONE)) + "$", "/" + P.any_of(*gaps(P.NOT_A_DOCUMENT_FILES)) + r".pdf(?:\?.*)?$"
    return _any(
        hit(u, P.any_of(*gaps(plain), "poli" + P.any_of(r"tika(?:si)?"), *P.NOT_A_DOCUMENT_LAST, alone, files)), _but(u, "preview", "readonly_preview"),
        _but(u, "agreement", rf"agreement.*thesis{P.SPACES}(?:19|20)[\d]{{2}}"), _but(u, r"polic(?:y|ies)", r"polic(?:y|ies).*paper"),
    )


def page_mime(m: str) -> str:
    return f"(length({m}) <= 255 AND {_any(hit(m, 'htm'), _but(m, 'text', f'text.*{P.dataset_formats()}'))})"


def reject_reason(u: str) -> str:
    by_dir = f"CASE WHEN {hit(u, 'sharedsitesession')} THEN 'endless redirection' WHEN {_away(u, r'^https?://.*/.*/view/', '/view/')} THEN 'larger depth' WHEN {hit(u, 'doi.org/https://doi.org/.*pangaea.')} THEN 'pangaea form' ELSE 'directory' END"
    return f"""CASE WHEN {directory(u)} THEN {by_dir} WHEN {specific_domain(u)} THEN {_domain_reason(u)} WHEN {not_a_document(u)} THEN 'invalid document' WHEN {hit(u, P.full(P.PLAIN_DOMAIN))} THEN 'plain domain'
  WHEN {irrelevant_extension(u)} THEN 'irrelevant extension' END"""


def accept_internal_link(u: str) -> str:
    return f"({reject_reason(u)} IS NULL AND NOT {_any(hit(u, P.full(P.LINK_WORDS)), hit(u, P.full(P.file_format(Config()))), plain_page(u))})"
