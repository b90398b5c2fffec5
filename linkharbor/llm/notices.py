"""Sentences that speak to the visitor of a failed page, of a page that needs scripts, or of an unwritten one.

No sentence is listed.  A sentence is read as a set of words of a few classes: what failed, how, what the visitor is asked
to do, what scripts are needed for, what an editor writes about layout, and the small words that hold them together.
Where such words leave nothing over, the sentence can't speak of anything else and is a notice by itself (``strong``).
Where they leave some words over it may be a notice or speak of notices (``weak``), which the evidence of titles,
addresses and hosts decides.
"""

from __future__ import annotations

import re

# Words by class.  Languages in order: English, German, French, Spanish, Portuguese, Italian, Dutch. ------

#: What a failed page calls itself, its parts and its machinery.
THING = """
page pages site website web document documents file files record records item items resource resources url link address view viewer reader article abstract catalogue catalog search form
content text section paragraph handle object server host upstream remote gateway proxy network request requests session connection database service system browser internet application program
seite seiten webseite dokument datei datensatz eintrag ressource adresse ansicht inhalt server dienst anfrage sitzung verbindung datenbank system browser leser
page pages site document documents fichier notice ressource adresse lecteur article contenu texte serveur service requête session connexion base données système navigateur
página páginas sitio documento documentos archivo fichero registro recurso dirección visor lector artículo contenido texto servidor servicio solicitud sesión conexión base datos sistema navegador
página sítio documento ficheiro arquivo registo registro recurso endereço leitor visualizador artigo conteúdo texto servidor serviço pedido sessão ligação conexão base dados sistema navegador
pagina sito documento risorsa indirizzo contenuto testo servizio richiesta sessione connessione database sistema
pagina site document bestand bron adres inhoud tekst dienst verzoek sessie verbinding databank systeem
body message error-page screen account user traffic input form
ip method payload entity
"""
#: Words that only a failure has; one of them makes a short sentence a notice.
FAILED = """
denied forbidden unauthorized unauthorised unavailable expired throttled oops 
verweigert abgelaufen fehlgeschlagen schiefgelaufen
introuvable indisponible expiré expirée refusé refusée interdit
denegado denegada caducado caducada expirado expirada prohibido 
negado negada expirou indisponível proibido 
negato scaduta scaduto vietato 
geweigerd verlopen verboden 
"""
#: Words that need another of these classes beside them.
FAILING = """
not no cannot can't couldn't doesn't don't isn't wasn't won't unable nothing never without
found find exist exists existing available reached reach retrieved displayed shown show resolved completed complete opened open loaded load reply respond answer authorised authorized allowed permission permitted access blocked
failed fail fails error errors wrong unexpected unhandled internal bad gone down out time timed occurred happened problem problems trouble moved removed deleted missing closed unusual traffic many too wait expire
nicht kein keine fehler gefunden vorhanden verfügbar erreichbar aufgetreten existiert berechtigt berechtigung zugriff gesperrt leider blockiert
pas ne n aucun aucune erreur trouvé trouvée existe impossible disponible survenue produite autorisé autorisée accès bloqué bloque déplacée supprimée
no ningún error encontrado encontrada existe disponible pudo producido ocurrido permiso acceso bloqueado bloquea mal salió
não nenhum erro encontrado encontrada existe disponível ocorreu permissão acesso bloqueado falha falhou errado
non nessun errore trovata trovato esiste disponibile accesso permesso verificato
niet geen fout gevonden bestaat beschikbaar toegang toegestaan opgetreden
maintenance timeout exception traceback mistyped conflict encountered
wartung wartungsarbeiten mantenimiento manutenção manutenzione onderhoud inesperado inattendu unerwarteter inesperado imprevisto
"""
#: What the visitor is asked or told.
VISITOR = """
please try again later soon reload refresh retry back home homepage go return log login sign contact help helpdesk desk support quote reference persists persist continue check verify verifying checking confirm prove
robot human moment minutes minute seconds second takes take sorry your you're visitor administrator administrators webmaster ray incident id code status http noticed detected looking requested asked after want wanted done warning fatal notice
bitte versuchen versuche erneut später noch einmal zurück startseite melden anmelden sie ihr ihre angeforderte angeforderten gesuchte tut uns leid
veuillez réessayer nouveau plus tard retour accueil merci connecter identifier vous votre demandée demandé recherchée désolé quelques minutes
por favor inténtelo intente intentar nuevo más tarde volver vuelva inicio iniciar sesión su usted solicitado solicitada busca lo sentimos minutos algo
tente novamente mais tarde voltar volte início inicie sessão seu sua pedido pedida solicitada procura desculpe minutos algo
riprova riprovare più tardi prego tuo tua richiesta richiesto cercando spiacenti
probeer opnieuw later terug uw gevraagde gezochte sorry helaas
connect render rendering temporarily temporarily currently konnte verbinden aufrufen aufzurufen consulter connecter temporairement conectar código temporalmente temporariamente caricare raadplegen verbinden verifying redirecting redirected
wait logged
"""
#: What scripts have to do with it.
SCRIPT = """
javascript scripts script scripting noscript cookies cookie
skripte skripten skript
scripts script
scripts script
scripts script
script
scripts
"""
NEEDS = """
enable enabled activate activated turn turned switch switched on off disabled required requires require needs need needed must allow allowed support supported supports run runs execute works best best stays empty unless otherwise use using plain version loading start see
aktivieren aktiviert einschalten ausgeschaltet deaktiviert benötigt erforderlich zugelassen zulassen müssen unterstützt führt aus anzuzeigen anzeigen
activer activez activé activés autoriser autorisés doivent désactivé requis nécessite nécessaire afficher ouvrir exécute
activar active activado habilite habilitar habilitados habilitado desactivado requiere necesita ver ejecuta estén
ativar ative ativado ativos habilite habilitar desativado requer precisa necessita ver executa estar
attiva attivare attivato abilita abilitare disattivato richiede necessario visualizzare vedere
schakel inschakelen ingeschakeld uitgeschakeld vereist nodig bekijken
javascript-enabled opens will rendering
"""
#: What an editor writes where a text is to come.
LAYOUT = """
sample dummy placeholder filler example lorem blindtext layout font column typeface overwrite overwritten replace replaced fill box copy paste here coming soon tbd tba tbc written announced determined added follow follows lazy quick jumps pending blank
beispieltext blindtext platzhalter platzhaltertext ersetzen überschreiben inhalt folgt demnächst
provisoire remplacer venir bientôt faux exemple
ejemplo relleno reemplazar sustituir próximamente pendiente
exemplo preenchimento substituir breve
esempio segnaposto sostituire arrivo
voorbeeldtekst voorbeeld vervangen binnenkort
words paragraph purposes lines
ipsum insert add enter type under construction
aufbau entsteht construcción construção costruzione
"""
#: Of these, words that leave no doubt.
UNWRITTEN = """
sample dummy placeholder filler example lorem blindtext overwrite tbd tba tbc coming
beispieltext platzhalter platzhaltertext demnächst
provisoire bientôt
ejemplo próximamente
exemplo
esempio
voorbeeldtekst binnenkort
ipsum construction
entsteht construcción construção costruzione
"""
#: Small words that hold sentences together.
SMALL = """
a an the this that these it its is are was were be been being has have had do does did will would can could may might should of to in into on at by for from with as and or but if so before then while when only just one more some any we our i us me they he what which who there
yet already now also very still all up over than step let get
der die das den dem des ein eine einen einem einer dieser diese dieses diesem ist sind war wurde werden wird sein kann können konnte haben hat von zu zur zum in im an am auf für mit und oder aber wenn zurzeit derzeit um es uns wir bei
le la les l un une des du de d ce cet cette ces est sont était a à au aux en dans sur pour par avec et ou mais si être sera peut il elle nous que qui s cela y
el la los las un una unos unas del de este esta estos es son era ha a al en sobre para por con y o pero si se ser está puede que lo nos ya
o a os as um uma uns umas do da dos das de este esta estes é são era foi há ao à em no na para por com e ou mas se ser está pode que nos já
il lo la i gli le un una del della di questo questa è sono era ha a al in su per con e o ma se essere può che ci si
de het een deze dit is zijn was werd heeft aan op in voor van met en of maar als kan dat die wij u er
you something went goes go such few most as sich tem tiene neste nesta novo nova êtes ont avez vos nos muy uma gli dei delle
right now longer currently mehr secure mode
"""
#: Counting words, which filler lists in their order.
NUMBERS = """
one two three four five six seven eight nine ten
eins zwei drei vier fünf sechs sieben acht neun zehn
un deux trois quatre cinq six sept huit neuf dix
uno dos tres cuatro cinco seis siete ocho nueve diez
um dois três quatro cinco seis sete oito nove dez
uno due tre quattro cinque sei sette otto nove dieci
een twee drie vier vijf zes zeven acht negen tien
"""


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_THING, _FAILED, _FAILING, _VISITOR, _SCRIPT, _NEEDS, _LAYOUT, _UNWRITTEN, _SMALL = map(_words, (THING, FAILED, FAILING, VISITOR, SCRIPT, NEEDS, LAYOUT, UNWRITTEN, SMALL))
_KNOWN = _THING | _FAILED | _FAILING | _VISITOR | _SCRIPT | _NEEDS | _LAYOUT | _UNWRITTEN | _SMALL
_COUNTS = [line.split() for line in NUMBERS.strip().split("\n")]
#: Each run of four counting words holds one of these pairs.
_COUNTING = frozenset(NUMBERS.split())
_COUNTED = frozenset(f"{line[3]} {line[4]}" for line in _COUNTS) | frozenset(f"{line[5]} {line[6]}" for line in _COUNTS) | frozenset(f"{line[2]} {line[3]}" for line in _COUNTS)
SMALL_WORDS = _SMALL
#: Words of the open class: only a thing, a failure or a request of their own kind tells a notice from small talk.
_PLAIN_FAILING = _FAILING - _SMALL - _THING
#: Of these, words that tell of a failure only where a negation stands by: "access", but "no access".
_STATE = _words("""
such found find exist exists existing available reached reach retrieved displayed shown show resolved completed complete opened open loaded load reply respond answer authorised authorized allowed permission permitted access unusual time many too out wait
gefunden vorhanden verfügbar erreichbar existiert berechtigt berechtigung zugriff trouvé trouvée existe disponible autorisé autorisée accès produite survenue encontrado encontrada pudo permiso acceso disponível permissão acesso
trovata trovato esiste disponibile accesso permesso gevonden bestaat beschikbaar toegang toegestaan
""")
_ASKING = _words("merci anmelden melden wait verifying checking redirecting please try again later reload refresh retry log login sign contact verify confirm robot human moment sorry oops bitte versuchen erneut veuillez réessayer désolé inténtelo intente vuelva tente novamente volte inicie riprova probeer opnieuw")
#: Failures that texts about other things speak of as well; and words that say that one took place.
_SOFT = _words("""
error errors missing moved removed deleted closed problem problems trouble fail fails maintenance timeout exception traceback conflict
fehler wartung wartungsarbeiten erreur déplacée supprimée erro falha mantenimiento manutenção errore manutenzione fout onderhoud
""")
#: Words that make a notice with none but small ones beside them.
_SINGLES = _words("sorry oops noscript moment loading forbidden unauthorized unauthorised tbd tba tbc")
_NEGATIONS = _words("n not no cannot can't couldn't doesn't don't isn't wasn't won't unable nothing nicht kein keine ne n pas aucun não nenhum non nessun niet geen")
_YOURS = _words("you your you're votre vous su seu sua ihr ihre uw tuo tua")
_CODED = _words("http status error code erreur fehler erro fout errore")
#: Words of typesetting that a text about something else has no use for, and words that promise a text.
_EDITORS = _words("font typeface overwrite overwritten paste überschreiben column layout")
_PROMISES = _words("will be soon here your brevemente breve venir bientôt próximamente folgt demnächst binnenkort arrivo")
_HEADINGS = _words("construction construcción construção costruzione example sample exemple ejemplo exemplo esempio voorbeeld filler coming")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"(?<![\d.,])[45]\d\d(?![\d.,]*\d)")
_MACHINE = re.compile(r"(?:^|\s)(?:[a-z]\w*\.)+[A-Za-z]\w*(?:Exception|Error)(?::|$)|\b(?:warning|notice|(?:fatal|parse|syntax) error): \S+.*\b(?:on )?line \d+|\btraceback \(most recent call last\)", re.IGNORECASE)
_MACHINES = ("exception", "error", "warning", "notice", "traceback")
MOST_WORDS = 32


#: A notice holds one of these, or a negation and a state, or words of layout.
_ALONE = (_FAILED | (_PLAIN_FAILING - _STATE) | _ASKING | _SCRIPT | _UNWRITTEN | _EDITORS | _CODED | _SINGLES) - {"plus", "code", "status"}
_BARE_NEGATIONS = frozenset(w for x in _NEGATIONS for w in ([x] if x.isalpha() else ["t"]))


def hints(words: set[str], text: str) -> list[str]:
    """Strings of which a line must hold one to hold a notice; none if no line of the text can.

    ``words`` are the letter runs of the whole text, in lower case like ``text``."""
    found = list(words & _ALONE)
    if not words.isdisjoint(_BARE_NEGATIONS):
        found += words & _STATE
    if "too" in words and "many" in words:
        found.append("too")
    if not words.isdisjoint(_CODED) and _CODE.search(text):
        found += words & _CODED
    layout = words & _LAYOUT
    if len(layout) >= 2 or (layout and not words.isdisjoint(_PROMISES)):
        found += layout
    found += [w for w in _MACHINES if w in text]
    if sum(w in words for w in _COUNTING) >= 4:
        found += [w for w in _COUNTED if w in text]
    return found


def _split(word: str) -> str:
    """An elided article or a contracted verb belongs to its word: l'article, browser's."""
    head, mark, tail = word.replace("’", "'").partition("'")
    if not mark or word in _KNOWN or head + "'" + tail in _KNOWN:
        return word.replace("’", "'")
    return tail if len(head) <= 2 else head


def _tokens(line: str) -> list[str]:
    out = []
    for w in _WORD.findall(line):
        if w.isalpha():
            out.append(w)
            continue
        if w[0] == "n" and w[1] in "'’":  # a French negation
            out.append("n")
        out.append(_split(w))
    return out


def _counting(words: list[str]) -> bool:
    return len(words) >= 4 and any(words == c[i : i + len(words)] for c in _COUNTS for i in range(len(c) - len(words) + 1))


def read(sentence: str) -> tuple[str, str] | None:
    """(strength, kind) of a sentence: strength ``strong`` or ``weak``, kind ``notice`` or ``filler``; None for others."""
    if len(sentence) > 400:
        return None
    low = sentence.lower()
    if any(x in low for x in _MACHINES) and _MACHINE.search(sentence):
        return "strong", "notice"
    words = _tokens(low)
    n = len(words)
    if not 0 < n <= MOST_WORDS:
        return None
    if _counting(words):
        return "strong", "filler"
    has = set(words)
    unknown = n - sum(map(_KNOWN.__contains__, words))
    if unknown * 4 > n:
        return None
    code = bool(_CODE.search(sentence))
    script, failed, unwritten, layout = has & _SCRIPT, has & _FAILED, has & _UNWRITTEN, has & _LAYOUT
    failing, asking, thing, visitor = has & _PLAIN_FAILING, has & _ASKING, has & _THING, has & (_VISITOR | _ASKING)
    negated = has & _NEGATIONS
    if not unknown and has - _SMALL and has - _SMALL <= _SINGLES:
        return "strong", "filler" if has & _UNWRITTEN else "notice"
    if script and (has & _NEEDS or negated):
        kind, evidence = "notice", 2
    elif failed:
        kind, evidence = "notice", 1 + bool(thing or code or n == 2) + bool(asking) + bool(failing)
    elif (failing or negated) and not (layout & unwritten):
        # "the page is not ..." tells of a failure only with what failed about it
        fault = failing - _STATE
        told = len(fault) if fault else bool(negated and has & _STATE) or {"too", "many"} <= has
        soft = bool(fault) and fault <= _SOFT and not negated
        kind, evidence = "notice", bool(told) and min(told, 2) - soft + bool(thing or code) + bool(asking) + bool(code) + bool(has & _YOURS) + (len(visitor) >= 4) + ("wrong" in has)
    elif asking and len(visitor) >= 2:
        kind, evidence = "notice", 1 + (n <= 4) + (len(asking) >= 2) + (len(visitor) >= 3)
    elif unwritten or layout & _EDITORS or (layout and has & _PROMISES and n <= 8):
        # "example" alone is a heading, an example text is none
        kind, evidence = "filler", 1 + bool(thing or len(layout) >= 2 or has & (_PROMISES - layout) or (n <= 2 and unwritten - _HEADINGS))
    elif len(layout) >= 2:
        kind, evidence = "filler", len(layout) - 1 + bool(thing)
    elif code and has & _CODED:
        kind, evidence = "notice", 2
    else:
        return None
    if not evidence:
        return None
    if unknown == 0 and evidence >= 2:
        return "strong", kind
    # at least three words in four are of the classes; shorter ones are headings as well
    return ("weak", kind) if n >= 4 and unknown * 4 <= n else None
