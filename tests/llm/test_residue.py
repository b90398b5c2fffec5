from __future__ import annotations

import pytest

from linkharbor.llm import residue

DOC = "doc_id long, text string, host string, id string, kind string, body string"
PROSE = "The pump was measured in 12 samples. The curves follow the wave height closely."


@pytest.mark.parametrize(
    "line",
    [
        "{{ title }}", "{{{abstract}}}", "{{ title", "${creators[0].name}", "#{item.description}", "<%= TITLE %>", "<?= $title ?>", "{% print abstract %}", "[%size%]", "[[title]]", "@@x@@", "##doc.title##", "__dc:description__",
        "%ABSTRACT%", "%(title)s", "%1$s", "{$x}", "$TITLE$", "{0}", "{title}", "<Titel>", "&lt;size&gt;", "~x~", "TITLE_PLACEHOLDER", "*** names to be supplied ***", "[TODO: title]", "[titre à compléter]", "(enter title here)",
        "<< fecha pendiente >>", "« saisir titre »", "Click to edit title", "title: xxxxx", "____ fecha ____", "???label.title???", "missing translation: title", "metadata.dc.title", "(unset)", "[object Object]", "undefined", "null null",
        "NaN", "Invalid Date", "#REF!", "Authors: {{authors}}", "Files: undefined", "Abstract. %summary%", "# {title}", "Cite as: A. Bel ({{year}} (2001). On x. {{journal}}.", "Cite as: {{ authors (2007). On the wave. Bel Letters.",
    ],
)
def test_placeholders(line):
    assert residue.detect(f"On the wave height of Bel\n{line}\n{PROSE}") == "placeholder"


@pytest.mark.parametrize(
    "text",
    [
        "404 Not Found", "Bad gateway", "Error 503", "Page not found\nRay reference 12", "Your browser does not run scripts, so the record cannot be shown.", "Please enable JavaScript to view this page.", "Veuillez réessayer dans quelques minutes.",
        "TOO MANY REQUESTS Warning: include(header.inc) failed to open stream on line 3.", "Zugriff verweigert. Bitte melden Sie sich erneut an.", "SESSION EXPIRED - Please log in again to continue", "Su navegador no ejecuta scripts.",
        "Traceback (most recent call last): File \"v.py\", line 3, in show KeyError: 'x'", PROSE + " JavaScript is disabled in your browser. " + PROSE,
    ],
)
def test_notices(text):
    assert residue.detect(text) == "notice"


@pytest.mark.parametrize(
    "text",
    [
        "Please turn scripting on to view this record.", "La pagina richiesta non esiste.", "De pagina is niet gevonden.", "We can't find the page you're after.", "Just a moment...", "Error 1020 Access denied", "This site can't be reached",
        "This page isn't available right now.", "The requested URL was not found on this server.", "You have been blocked", "Enable JavaScript and cookies to continue", "Sie haben keine Berechtigung, diese Seite anzuzeigen.",
        "Cette page n'existe plus.", "Ha ocurrido un error inesperado.", "The server encountered an internal error.", "Your session has timed out.", "Your IP address has been blocked.", "Diese Seite existiert nicht.", "Accesso negato", "Toegang geweigerd",
        "Sorry, we couldn't find that page.", "Contenu indisponible", "HTTP 451", "Bitte aktivieren Sie Cookies.", "No permission to access this file.",
    ],
)
def test_notices_in_other_words(text):
    """Wordings and languages that no list holds as sentences."""
    assert residue.detect(text) == "notice" and residue.detect(f"On the wave height of Bel\n{text}\n{PROSE}") == "notice"


@pytest.mark.parametrize("text", ["Coming soon.", "Texto de ejemplo.", "Body copy goes in this box.", "Text goes here", "Insert text here", "Under construction", "Platzhaltertext", "TBD", "One two three four five.", "uno dos tres cuatro", "This content is coming soon."])
def test_unwritten(text):
    assert residue.detect(text) == "filler"


@pytest.mark.parametrize("text", ["Author: {{#each authors}}{{name}}{{/each}}", "{% if abstract %}{{ abstract }}{% endif %}", "Titel: <% if title then title end %>", "[% IF x %][% x %][% END %]", "{{> header}}", "Date: ${a.b('x')}, ${c}"])
def test_engine_code(text):
    assert residue.detect(text + "\n" + PROSE) == "placeholder"


HEADINGS = "Example|Example 3|Access|Open access|Contact|Contact form|Help|Error|Error bars|Missing data|Missing pages|Script|Login|Maintenance|Maintenance of the server|Sample preparation|Published online|No data available|Timeout|Scripts and code|Ice thickness in Tellagor|Request form|One two"


@pytest.mark.parametrize("text", HEADINGS.split("|"))
def test_headings_are_no_residue(text):
    assert residue.detect(text) is None and residue.detect(f"{text}\n{PROSE}") is None


@pytest.mark.parametrize("text", ["blah " * 20, ". " * 30, "Title\n" + "… " * 12, "Quam elim pulvis semper ligna quam.", PROSE + " Lorem ipsum dolor sit amet."])
def test_filler(text):
    assert residue.detect(text) == "filler"


@pytest.mark.parametrize(
    "text",
    [
        None, "", PROSE, "We replaced every {{title}} variable of the mail template by the real heading.", "The set {{1, 2}, {3, 4}} is a partition.", "The path ${HOME}/data/run2 holds the series.", "The function __init__ sets the counter, and [[1]] marks it.",
        "Of the 45 links tested, 5 % ended in a 404 Not Found answer.", 'One librarian said: "I only saw Error 503 and went home."', "Pages that ask the reader to enable JavaScript made up 3 % of the sample.", 'Our form states "TBD" when a team is late.',
        "Typesetters have used lorem ipsum as dummy text for a long time.", "Undefined behaviour of the pump was noted.", "A server under maintenance is a frequent cause of gaps.", "Let $S = \\{x_1, \\ldots, x_{8}\\}$ and $f(x) = \\frac{a}{b}$.",
        "Around 2% of users%households carried no value, recorded there as null or NaN.", "La variable %titulo% de la plantilla se explica.", "The species list names Morbus arbor and Lacus magna as new.", "Access denied events were logged at 7 gates.",
        "Insert the probe here, between the rings, and wait 5 minutes.", "Licence: open, 2001-01-02", "Keywords: null results, undefined behaviour", "- a_1.csv: 3 columns, 5 rows", "İ" * 50 + " text",
    ],
)
def test_subjects_are_no_residue(text):
    assert residue.detect(text) is None


def test_whole_texts_are_read():
    assert residue.detect((PROSE + "\n") * 20_000 + "Please enable JavaScript to view this page.") == "notice"


def test_tables(spark):
    odd = "Die Anlage meldet Ruhe"
    rows = [(k, odd + f" {k}.", f"h{k % 4}", f"i{k}", "x", "y") for k in range(6)]  # the same words up to numbers, on four hosts
    rows += [(10, odd + " 9.", "h1", "answered", "x", "y"), (11, PROSE, "h1", "i1", "x", "y"), (12, None, None, None, None, None), (13, "", "h", None, None, None), (14, "{{ x }}", None, None, None, None), (None, "{{ x }}", None, None, None, None), (14, "{{ x }}", None, None, None, None)]
    d = spark.createDataFrame(rows, DOC)
    i = spark.createDataFrame([("answered", "https://h1.example/papers/anlage_12.pdf", 1), ("i1", "https://h1.example/x", 2), (None, None, 3), ("null", "https://a/anlage", 4)], "id string, url string, slug int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.kind) for r in residue.flagged(d, i).collect())
    assert got == sorted([(k, "duplicated") for k in range(6)] + [(14, "placeholder"), (-1, "placeholder")])
    assert {r.doc_id for r in residue.cleaned(d, i).collect()} == {10, 11, 12, 13, None}
    assert residue.flagged(d.limit(0), i.limit(0)).count() == 0 and residue.cleaned(d, i).columns == d.columns


def shortest(tree) -> list[str]:
    """For every alternative of a parsed pattern a short match that takes it."""
    from re import _constants as C

    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            new = [chr(arg)]
        elif op is C.IN:
            new = [chr(v) if k is C.LITERAL else {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " "}.get(v, "q") for k, v in arg if k is not C.NEGATE][:4] if arg[0][0] is not C.NEGATE else ["q"]
        elif op is C.SUBPATTERN:
            new = shortest(arg[3])
        elif op is C.BRANCH:
            new = [x for b in arg[1] for x in shortest(b)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            some = shortest(arg[2])
            new = [x * max(arg[0], k) for k in ((0, 1) if arg[0] == 0 and arg[1] == 1 else (0,)) for x in some]
        else:
            new = [""] if op is C.AT else ["q"]
        new = list(dict.fromkeys(new))
        # every way of the part once, with the first way of the others, and all pairs while they are few
        out = [a + b for a in out for b in new] if len(out) * len(new) <= 400 else [out[0] + b for b in new] + [a + new[0] for a in out[1:]]
    return out


def test_each_alternative_has_a_trigger():
    from re import _parser

    n = 0
    for p in residue._SLOT:
        for text in shortest(_parser.parse(p)):
            if residue.residue_in_line(text):
                assert residue.detect(text) == "placeholder", (p[:80], text)
                n += 1
    assert n > 500
    long = [w for w in residue._LATIN if len(w) > 3]
    assert all(residue.detect(" ".join([w, "dolor", "sit", "amet"])) == "filler" for w in long)


@pytest.mark.parametrize("text", ["409 Conflict", "Status 422", "HTTP 451", "Status: 520", "Sessão expirada", "Ocorreu um erro.", "Merci de vous identifier.", "Please go back to the homepage", "A title\nBad requeſt"])
def test_notices_without_a_listed_word(text):
    assert residue.detect(text) == "notice"


def test_what_may_hold_a_notice_is_read():
    """The quick test of a line lets every sentence through that the reader would take."""
    import itertools

    from linkharbor.llm import notices

    words = "the page not found access denied please try later script enable your text here loading error 404 coming soon is was you".split()
    for k in (1, 2, 3):
        for some in itertools.product(words, repeat=k):
            line = " ".join(some)
            assert not notices.read(line) or any(h in line for h in notices.hints(set(line.split()), line)), line


def test_dummy_sentences():
    assert residue.detect(PROSE + "\nDuis aute irure dolor in reprehenderit voluptate velit esse cillum dolore eu fugiat nulla pariatur.") == "filler"
    assert residue.detect(PROSE + " The pump ran in esse.") is None


LONG = "The archive is offline for an upgrade. " + "Each of its shelves will be sorted before the doors are opened to all readers. " * 12


def duplicated(spark, rows, urls):
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    return sorted(r.doc_id for r in residue.flagged(d, spark.createDataFrame(urls, "id string, url string, slug int")).collect())


def test_responses_with_words_of_title_and_route(spark):
    """A response that repeats its own title, a route's word in every slug, and texts of any length."""
    rows = [(k, f"Archive offline\nThe archive is offline for an upgrade {k}.", f"h{k % 4}", f"i{k}") for k in range(6)]
    rows += [(10 + k, "This record lies behind the blue door", f"h{k % 4}", f"r{k}") for k in range(6)]
    rows += [(20 + k, LONG, f"h{k % 4}", f"l{k}") for k in range(6)]
    urls = [(f"r{k}", f"https://h.example/record/{k}", k) for k in range(6)] + [(f"x{k}", f"https://h.example/record/{k}", k) for k in range(400)]
    assert duplicated(spark, rows, urls) == [*range(6), *range(10, 16), *range(20, 26)]


def test_one_shared_rare_word_is_no_answer(spark):
    rows = [(k, "The door of the reading room is blue", f"h{k % 4}", f"r{k}") for k in range(6)]
    urls = [(f"r{k}", f"https://h.example/polar-glacier-reading-depth-{k}", k) for k in range(6)]
    assert duplicated(spark, rows, urls) == [*range(6)]
    assert duplicated(spark, rows, [(f"r{k}", f"https://h.example/reading-room-blue-{k}", k) for k in range(6)]) == []


def test_verdict_does_not_change_with_the_table(spark):
    """A real sentence that a few of very many documents share is no response; mirrors of one id never are."""
    real = "Between 17 and 3666 units of access status were lost before the annual phase began."
    rows = [(k, real, f"h{k % 4}", f"i{k}") for k in range(6)] + [(100 + k, f"Wave {'abcdefghij'[k % 10]} {'abcdefghij'[k // 10 % 10]} {'abcdefghij'[k // 100]} was high", f"h{k % 4}", f"j{k}") for k in range(900)]
    urls = [(f"i{k}", f"https://h.example/record/{k}", k) for k in range(400)]
    assert duplicated(spark, rows, urls) == []
    assert duplicated(spark, [(k, real, f"h{k % 6}", "one") for k in range(12)], urls[100:]) == []
    # as many copies at addresses that ask for something else are responses
    assert duplicated(spark, rows, [(f"i{k}", f"https://h.example/polar-glacier-{k}", k) for k in range(6)]) == [*range(6)]


def test_weak_lines_are_decided_by_hosts(spark):
    """A line that may be a notice or speak of notices, in texts about different things, at addresses that ask for others."""
    weak = "The record was moved to the blue catalogue"
    assert residue.detect(weak) is None and residue.examine(weak)[1]
    about = ["pump", "wave", "grain", "cloud", "river", "forest", "glacier", "meadow"]
    rows = [(k, f"On the {a} of Bel\n{weak} {k}.\nThe {a} was measured.", f"h{k % 4}", f"i{k}") for k, a in enumerate(about)]
    urls = [(f"i{k}", f"https://h.example/{a}-of-bel", k) for k, a in enumerate(about)]
    assert duplicated(spark, rows, urls) == [*range(8)]
    assert duplicated(spark, [(*r[:2], "h", r[3]) for r in rows], urls) == []  # one host's own footer


def test_kinds_of_evidence(spark):
    """A text may have several kinds; it is found once."""
    rows = [(k, f"Access denied {k}", f"h{k % 4}", f"i{k}", "x", "y") for k in range(6)]
    urls = [(f"i{k}", f"https://h.example/{a}-report", k) for k, a in enumerate(["pump", "wave", "grain", "cloud", "river", "forest"])]
    d, i = spark.createDataFrame(rows, DOC), spark.createDataFrame(urls, "id string, url string, slug int")
    assert sorted((r.doc_id, r.kind) for r in residue.evidence(d, i).collect()) == sorted([(k, x) for k in range(6) for x in ("notice", "duplicated")])
    assert sorted((r.doc_id, r.kind) for r in residue.flagged(d, i).collect()) == [(k, "notice") for k in range(6)]
