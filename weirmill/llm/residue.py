"""Template residue, filler, error pages and demands for scripts in place of content.

Lines are counted by host over all records (distinct texts, so copies of one page count once); lines that recur on a host, and
furniture found by the page model, are subtracted. What is left decides: unfilled placeholders and filler count wherever the
page's own text has them, unless the sentence talks about them; error, waiting and script notices count if the residual holds no
real text beside them. Subtracted lines are evidence only of pages that hold nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmill.llm import boilerplate
from weirmill.llm.hashing import line_key
from weirmill.operators.skew import lookup_join
from weirmill.session import stored

#: A line is recurrent on a host if this many distinct texts, and this share of the host's texts, have it.
LEAST_TEXTS, LEAST_SHARE = 5, 0.05
#: A residual line is real text from this many words on, if it ends a sentence; without an end it takes more.
SENTENCE_WORDS, LONG_WORDS = 5, 12
#: So many words of real text make a real page.
REAL_WORDS = 15

# Unfilled placeholders, filler, messages of error and waiting pages, notices that scripts are required, in
# English, French, German and Spanish.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\- ]{0,40}"
PLACEHOLDER = (
    rf"\{{\{{\s*{_NAME}(?:\|[^{{}}]*)?\s*\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|\{{%-?\s*{_NAME}[^%]*%\}}|<%=?\s*{_NAME}[^%]*%>|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@"
    rf"|\[\[\s*{_NAME}\s*\]\]|(?i:\[\s*(?:insert|enter|add|your|put)\b[^\]\n]{{1,60}}\])|<[A-Z][A-Z0-9_]*_(?:GOES_)?HERE>|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])"
    rf"|(?<![\w$#{{\"':])\{{[a-z][a-z0-9_.]{{1,40}}\}}(?![\w}}])|\$[A-Z][A-Z_]{{3,}}\$"
)
_UNFILLED = r"^(?:by |price: ?|von |par |por )?(?:undefined|null|nan|none|n/a|\[object object\]|%[sd](?: (?:of|von|de|sur) %[sd])?|tbd|todo|xxx+)(?: (?:results?|items?|comments?))?(?:\s*[-–—|·:]\s*(?:undefined|null|nan|none|%[sd])?.*)?$|^%[sd]\b.*$"
_UNFILLED_INSIDE = r"\bnan (?:results|items|comments|of)\b|\bnull - null\b|\[object object\]"
_FILLER = (
    r"^(?:your (?:text|content|title|headline) (?:goes )?here|type something|enter (?:your )?text here|add (?:a|your) (?:short )?(?:description|text|title|content)\b.*here|"
    r"edit or remove this sample page.*|this is (?:a|an) (?:sample|example|placeholder|dummy|test) (?:page|paragraph|text|post).*|(?:sample|dummy|placeholder|example|test) (?:text|content|page|post|title|paragraph)|"
    r"replace (?:this|it) with your own\b.*|(?:just )?(?:another|a) (?:wordpress|blog) site|(?:asdf|qwer|qwerty|jkl|foo|bar|baz|blah|bla|test|xxx|abc)(?:[ ,.]+(?:asdf|qwer|qwerty|jkl|foo|bar|baz|blah|bla|test|xxx|abc|123))*|"
    r"untitled(?: (?:document|page|post))?(?: ?\d+)?|new page(?: ?\d+)?|hello world!?|(?:page|title|coming soon|under construction|content coming soon|heading|headline)(?: (?:title|here|goes here))?|"
    r"hier steht (?:ihr|der|dein) (?:text|inhalt|titel)|(?:text|inhalt|titel)(?: [–-] (?:text|inhalt))? folgt|.{0,20}\bfolgt in k[üu]rze|(?:beispiel|muster|platzhalter|f[üu]ll|blind)(?:text|inhalt|seite|titel|absatz)\b.*|dies ist (?:ein|eine) (?:beispiel|muster|platzhalter|f[üu]ll|blind).*|unbenanntes dokument|ihr(?:e)? (?:text|titel|[üu]berschrift) hier|"
    r"votre (?:texte|titre|contenu) ici|ceci est un (?:texte|contenu|paragraphe) (?:de remplissage|d.exemple|factice).*|texte (?:de remplissage|d.exemple|factice|[àa] venir).*|contenu (?:[àa] venir|d.exemple)|(?:document|page) sans titre|saisissez (?:votre|du) texte.*|"
    r"escriba (?:aqu[íi]|su) (?:su )?(?:texto|t[íi]tulo)(?: aqu[íi])?|su (?:texto|t[íi]tulo) aqu[íi]|(?:contenido|texto|p[áa]gina|t[íi]tulo) de (?:ejemplo|relleno|prueba|muestra).*|este es un (?:texto|p[áa]rrafo) de (?:ejemplo|relleno|prueba).*|(?:documento|p[áa]gina) sin t[íi]tulo|pr[óo]ximamente)"
)
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_ERROR = (
    r"^(?:(?:http )?(?:error|erreur|fehler)(?: code| http)?:? ?(?:[45]\d\d|1\d{3})\b.{0,80}|[45]\d\d\b[ :–—|-]*(?:error\b|not found|bad (?:gateway|request)|service (?:temporarily )?unavailable|forbidden|unauthorized|internal server error|gateway time-?out|too many requests|gone|page|request time-?out|no encontrad[ao]|introuvable|nicht gefunden|seite|p[áa]gina|zugriff|acc[èe]s|acceso|interdit|prohibido|verboten).{0,140}|[45]\d\d|"
    r"(?:sorry[,:] ?)?(?:the |this |that )?(?:page|file|resource|article|url|document)(?: you(?:.re| are| were)? (?:requested|looking for|tried to open))? ?(?:could not be|cannot be|can.t be|was not|not|isn.t|is not|no longer)\b.{0,40}(?:found|available|exists?)?.{0,80}|we (?:can.t|cannot|couldn.t|could not) (?:find|locate).{0,80}|nothing (?:was )?found(?: here)?|it (?:may|might) have been (?:moved|deleted|removed).{0,60}|"
    r"access (?:to this (?:page|resource|site) (?:has been|is|was) )?(?:denied|forbidden|restricted)\b.{0,80}|(?:permission|request) denied|request (?:blocked|rejected).{0,60}|you (?:do not|don.t) have permission.{0,80}|(?:the )?(?:connection|request|server|session) (?:has |was )?(?:timed out|expired|refused|reset).{0,60}|error establishing.{0,60}|(?:oops|whoops|uh-oh)\b.{0,80}|something went wrong.{0,60}|an (?:unexpected |unknown )?error (?:has )?occurred.{0,60}|"
    r"(?:this |the |our )?(?:site|website|page|service|system) (?:is )?(?:currently )?(?:down|closed|offline|unavailable|undergoing)\b.{0,60}(?:maintenance)?.{0,30}|(?:scheduled |under )maintenance|this (?:account|domain|site|store) (?:has been|is) (?:suspended|parked|disabled|expired|for sale).{0,80}|too many requests.{0,80}|internal server error|bad gateway|service (?:temporarily )?unavailable|not found|forbidden|page not found.{0,30}|file not found|"
    r"just a moment[.…]*|please wait\b.{0,60}|loading[.…]*|(?:verify|confirm|prove) (?:that )?you are (?:a )?human.{0,60}|checking (?:your browser|if the site).{0,80}|are you a (?:robot|human).{0,30}|attention required!?.{0,30}|one more step.{0,40}|redirecting\b.{0,60}|complete the (?:captcha|security check).{0,60}|ddos protection.{0,40}|"
    r"(?:page|fichier|article|document|contenu) (?:introuvable|non trouv[ée]e?).{0,60}|la page (?:demand[ée]e|que vous).{0,100}|(?:d[ée]sol[ée],? )?cette page (?:n.est pas|n.existe|est introuvable).{0,60}|acc[èe]s (?:refus[ée]|interdit|non autoris[ée]).{0,60}|erreur (?:interne|de connexion|inattendue|serveur)\b.{0,60}|(?:le )?(?:site|service|page) (?:est )?(?:actuellement )?(?:en maintenance|indisponible|hors ligne).{0,60}|service (?:temporairement )?indisponible|une erreur (?:est survenue|s.est produite).{0,60}|r[ée]essayez (?:dans|plus tard).{0,40}|veuillez (?:patienter|r[ée]essayer).{0,60}|un instant[.… ]*.{0,30}|chargement.{0,20}|v[ée]rifi(?:ez|cation) que vous [êe]tes humain.{0,40}|trop de requ[êe]tes.{0,60}|ce compte (?:a [ée]t[ée]|est) suspendu.{0,60}|"
    r"(?:die )?(?:angeforderte |gesuchte )?(?:seite|datei|artikel)(?: wurde| konnte| ist)?(?: leider)? nicht (?:gefunden|verf[üu]gbar|vorhanden|mehr verf[üu]gbar).{0,60}|(?:die )?(?:angeforderte|gesuchte|gew[üu]nschte) seite.{0,80}|(?:der )?zugriff (?:verweigert|nicht gestattet|gesperrt).{0,60}|interner (?:server-?)?fehler.{0,40}|serverfehler.{0,40}|(?:diese |die )?(?:seite|website|webseite|dienst) (?:wird|ist) (?:gerade |derzeit |zurzeit |momentan )?(?:gewartet|nicht erreichbar|offline|nicht verf[üu]gbar).{0,40}|wartungsarbeiten.{0,40}|ein (?:unerwarteter )?fehler ist aufgetreten.{0,40}|(?:bitte )?versuchen sie es (?:in|sp[äa]ter).{0,40}|bitte versuchen sie es .{0,40}|bitte warten.{0,40}|einen moment.{0,30}|wird geladen.{0,20}|l[äa]dt[.…]+|best[äa]tigen sie, dass sie ein mensch.{0,40}|zu viele anfragen.{0,60}|dieses konto (?:wurde|ist) gesperrt.{0,60}|dienst nicht verf[üu]gbar|"
    r"(?:la )?p[áa]gina (?:no (?:encontrada|disponible|existe)|solicitada).{0,80}|(?:lo sentimos,? )?(?:esta|la) p[áa]gina (?:ya )?no (?:est[áa]|existe|se).{0,60}|(?:archivo|art[íi]culo|contenido) no encontrado.{0,40}|acceso (?:denegado|prohibido|restringido).{0,60}|error (?:interno|del servidor|inesperado|de conexi[óo]n)\b.{0,60}|(?:el )?(?:sitio|servicio|p[áa]gina) (?:web )?(?:est[áa] )?(?:en mantenimiento|no disponible|fuera de servicio).{0,60}|servicio no disponible|(?:se )?ha ocurrido un error.{0,40}|ha habido un error.{0,40}|(?:por favor,? )?(?:int[ée]ntelo|vuelva a intentarlo|int[ée]ntalo) (?:de nuevo|m[áa]s tarde|en).{0,40}|(?:espere|un momento).{0,40}|cargando.{0,20}|(?:confirme|verifique) que (?:es|no es).{0,40}|demasiadas (?:solicitudes|peticiones).{0,60}|esta cuenta (?:ha sido|est[áa]) suspendida.{0,60}|"
    r"no such (?:page|file|resource|document|article|url|host|site)\b.{0,60}|there is no (?:page|file|resource|document|article) (?:here|at this|with this).{0,60}|aucune page\b.{0,60}|il n.y a (?:pas|aucune) (?:de )?page.{0,60}|"
    r"keine (?:seite|datei) (?:gefunden|vorhanden).{0,40}|es gibt keine (?:seite|datei).{0,60}|no existe (?:la|esta|ninguna) p[áa]gina.{0,60}|no se (?:ha |pudo |puede )?encontr(?:ado|ar|[óo]) (?:la|esta|ninguna) p[áa]gina.{0,60}|"
    r"retry in \d+ \w+)"
)
#: Courtesies before such a message.
_COURTESY = (
    r"(?:please note(?: that)?|unfortunately|(?:we.re |we are )?(?:very )?sorry|(?:we )?apologi[sz]e|it (?:looks|seems|appears)(?: like| that| as if)?|oops|hmm+|uh[- ]oh|whoops|oh no|veuillez noter(?: que)?|malheureusement|"
    r"(?:nous sommes )?d[ée]sol[ée]e?s?|oups|il semble que|leider|es tut uns leid|entschuldigung|bitte beachten sie|lo sentimos|lamentablemente|desafortunadamente|tenga en cuenta que|parece que|ups)\b[,.:;!… –-]*(?:(?:but|mais|aber|pero|que|dass) )?"
)
_SCRIPT = (
    r"^.{0,80}\b(?:enable|activate|allow|need|needs|require|requires|turn on|turn it on|switch|disabled|blocked|activer|activez|n[ée]cessite|requiert|d[ée]sactiv[ée]s?|bloqu[ée]s?|aktivieren|aktiviere|ben[öo]tigt|braucht|erfordert|deaktiviert|blockiert|ausgeschaltet|active|activar|habilite|habilitar|necesita|requiere|desactivad[oa]s?|bloquead[oa]s?)\b.{0,80}\b(?:java ?script|scripts?|skripte|scripting)\b.{0,80}$"
    r"|^.{0,80}\b(?:java ?script|scripts?|skripte|scripting)\b.{0,60}\b(?:enabled?|on|required|disabled|blocked|off|needed|n[ée]cessaire|requis|d[ée]sactiv[ée]s?|bloqu[ée]s?|pour fonctionner|aktivieren|erforderlich|deaktiviert|blockiert|ausgeschaltet|necesario|requerido|desactivad[oa]s?|bloquead[oa]s?|para continuar)\b.{0,80}$"
)
#: What stands beside such messages: references, ways back, advice.
_BESIDE = (
    r"^(?:reference #?.*|ray id.*|r[ée]f[ée]rence .*|referencia .*|vorgang .*|request id.*|incident id.*|(?:nginx|apache|cloudflare|varnish|openresty)\b.*|please contact the (?:administrator|webmaster|site owner).*|contact (?:the )?(?:administrator|support).*|"
    r"(?:go |return |take me )?back to (?:the )?(?:home ?page|home|start).*|go to the home ?page.*|try (?:again|searching).*|please try again.*|zur[üu]ck zur startseite.*|bitte wenden sie sich an.*|retour [àa] l.accueil.*|contactez l.administrateur.*|volver (?:al inicio|a la p[áa]gina).*|p[óo]ngase en contacto con el administrador.*)$"
)
#: Script notices that are page furniture (comment boxes, players), never the page's own demand.
_ASIDE = r"comments?\b|commentaires?|kommentare?|comentarios|player|lecteur|video|vid[ée]o|disqus"
#: Whom a demand for scripts addresses.
_YOU = r"\b(?:you|your|please|votre|vos|veuillez|sie|ihr|ihren|ihrem|bitte|usted|por favor|su navegador)\b"
#: Words of sentences that talk about templates instead of being one.
_TALK = (
    r"\b(?:templates?|template language|placeholders?|braces|brackets|syntax|variables?|prints?|manual|mock-?up|gabarits?|mod[èe]le de page|accolades|balises?|variable|notation|syntaxe|remplac[ée]e?s?|manuel|"
    r"platzhalter|vorlagen?|klammern|variablen?|handbuch|plantillas?|llaves|marcador(?:es)?|sustituye|reemplaza|manual)\b"
)

#: Words of titles and sentences that write about errors and scripts.
_ABOUT = (
    r"\b(?:explained|explains?|how|why|handles?|lessons?|history|rivals?|still|problem|guide|safely|behind|expliqu[ée]e?s?|pourquoi|g[èe]re|histoire|erkl[äa]rt|warum|wie|umgeht|geschichte|explicad[oa]s?|por qu[ée]|c[óo]mo|historia|gestiona)\b|\?$"
)

#: Placeholders are matched as written, all others against lower-cased text. _head: what such a text begins with.
_RE = {k: re.compile(p) for k, p in {"placeholder": PLACEHOLDER, "unfilled": _UNFILLED, "unfilled_inside": _UNFILLED_INSIDE, "filler": _FILLER + "[.!…]*$", "filler_head": _FILLER, "error": _ERROR + "[.!]*$", "error_head": _ERROR,
       "courtesy": _COURTESY, "script": _SCRIPT, "aside": _ASIDE, "beside": _BESIDE, "about": _ABOUT, "talk": _TALK, "you": _YOU}.items()}
_PARTS = re.compile(
    r"(?<=[.!?…])\s+|\s+(?=(?:Reference #|Ray ID|R[ée]f[ée]rence |Referencia |Vorgang |nginx/|Please contact|Retry in|Go back|Zur[üu]ck |Retour |Volver |[45]\d\d [A-Z]))"
)

_MARK = re.compile(r"[{<%@\[_$]")
_TAGS = re.compile(r"</?(?:p|div|span|h\d|li|td|b|i)>")
_ENDS = re.compile(r"(?<=[.!…])\s+")
_FULL_STOP = re.compile(r"[.!?…][\"'”’»)\]]*$")
#: Words of Latin filler that other texts of the four languages seldom have: any such filler has one of them.
_LATIN_SURE = frozenset("lorem ipsum amet consectetur adipiscing adipisicing eiusmod incididunt aliqua nostrud exercitation ullamco laboris aliquip commodo consequat aute irure reprehenderit voluptate cillum fugiat pariatur excepteur occaecat cupidatat deserunt mollit laborum".split())
#: So many words of it in a row are filler also inside other text.
LATIN_RUN = 8


def _mentioned(line: str, start: int, stop: int) -> bool:
    """Whether what stands at [start, stop) is something the sentence talks about."""
    begin = max(line.rfind(". ", 0, start), line.rfind("! ", 0, start), line.rfind("? ", 0, start)) + 1
    ends = [e for e in (line.find(". ", stop), line.find("! ", stop), line.find("? ", stop)) if e >= 0]
    sentence = (line[begin:start] + " " + line[stop : min(ends) if ends else len(line)]).lower()
    return len(sentence.split()) >= 3 and bool(_RE["talk"].search(sentence))


def _latin_filler(line: str, words: list[str]) -> bool:
    own = [w in _LATIN for w in words if not w[:1].isdigit()]
    if len(own) >= 4 and 4 * sum(own) >= 3 * len(own):
        return True
    run = 0
    for latin in own:
        run = run + 1 if latin else 0
        if run >= LATIN_RUN:
            return not _RE["talk"].search(line)
    return False


def _message(line: str, low: str) -> str | None:
    """error or script, if a line is such a message: as a whole, or each of its sentences with what stands beside."""
    about = None
    scripts = "script" in low or "skript" in low
    for courtesies in range(3):
        if _RE["error_head"].match(low):
            hit = bool(_RE["error"].match(low))
            if not hit:
                first, *more = _PARTS.split(line)
                hit = bool(more and _RE["error"].match(first.lower()) and all(_RE["error"].match(p) or _RE["beside"].match(p) or _script(p) for p in map(str.lower, more)))
            about = bool(_RE["about"].search(low))
            if hit and not about:
                return "error"
        lead = _RE["courtesy"].match(low) if courtesies < 2 else None
        if not lead:
            break
        line, low = line[lead.end() :], low[lead.end() :]
    if scripts and not _RE["aside"].search(low) and not (_RE["about"].search(low) if about is None else about):
        if _script(low):
            return "script"
        parts = [p.lower() for p in _PARTS.split(line)]
        if len(parts) > 1 and all(_script(p) or _RE["beside"].match(p) or _RE["error"].match(p) for p in parts):
            return "script"
    return None


def _script(low: str) -> bool:
    """Whether a sentence demands scripts; a long one must address the reader."""
    return bool(_RE["script"].match(low)) and (low.count(" ") < boilerplate.LINK_WORDS or bool(_RE["you"].search(low)))


def evidence(t: str, low: str, words: list[str]) -> str | None:
    """What a line gives evidence of: placeholder, filler, error, script or None. low, words: the line in lower case, its words.

    A line of any length is looked through. Messages, fillers of the four languages and unfilled values must be a line's whole
    text, sentence by sentence; placeholders, values inside and Latin filler count anywhere, unless the sentence talks about them.
    """
    if not words:
        return None
    if _MARK.search(t):
        if "<" in t:
            t = _TAGS.sub("", t)
        t = " ".join(t.split())
        low = t.lower()
        for m in _RE["placeholder"].finditer(t):
            if not _mentioned(t, *m.span()):
                return "placeholder"
    elif "  " in t or not (t.isascii() and t.isprintable()):
        t = " ".join(t.split())
        low = t.lower()
    if low.startswith(_VALUES) and len(words) <= REAL_WORDS + SENTENCE_WORDS and _RE["unfilled"].match(low):
        return "placeholder"
    if "null - null" in low or "nan " in low or "[object object]" in low:
        for m in _RE["unfilled_inside"].finditer(low):
            if not _mentioned(low, *m.span()):
                return "placeholder"
    if _RE["filler_head"].match(low) and (_RE["filler"].match(low) or all(map(_RE["filler"].match, _ENDS.split(low)))):
        return "filler"
    if not _LATIN_SURE.isdisjoint(words) and _latin_filler(low, words):
        return "filler"
    if _RE["error_head"].match(low) or "script" in low or "skript" in low or _RE["courtesy"].match(low):
        return _message(t, low)
    return None


#: What lines of unfilled values begin with.
_VALUES = ("by ", "price", "von ", "par ", "por ", "undefined", "null", "nan", "none", "n/a", "[object", "%s", "%d", "tbd", "todo", "xxx")
_WORDS = re.compile(r"\w+")


def _evidence(t: str) -> str | None:
    low = t.lower()
    return evidence(t, low, _WORDS.findall(low))


_evidence_short = lru_cache(maxsize=50_000)(_evidence)


def line_evidence(line: str) -> str | None:
    """evidence() of a line with or without outer white space."""
    line = line.strip()
    return _evidence_short(line) if len(line) < 120 else _evidence(line)


def title_evidence(title: str | None) -> bool:
    """Whether a title is a placeholder, filler, an error message or a demand for scripts; a site name after a bar is ignored."""
    if not title or not title.strip():
        return False
    whole = re.sub(r"\s+", " ", title).strip()
    parts = re.split(r"\s+[|–—·»-]\s+", whole)
    if line_evidence(whole) in ("placeholder", "filler"):
        return True
    return any(line_evidence(p) for p in ([whole, parts[0]] if len(parts) <= 2 else [whole]))


def content_evidence(text: str | None, title: str | None, recurrent: list[int]) -> bool:
    """Whether the residual of a page is evidence; ``recurrent``: numbers of its lines that recur on the host."""
    if not text or not text.strip():
        return False
    lines = text.split("\n")
    found = {i: e for i, line in enumerate(lines) if (e := line_evidence(line))}
    if not found:
        return False
    skip = set(recurrent) | set(boilerplate.furniture_lines(text, title))
    own = {e for i, e in found.items() if i not in skip}
    if {"placeholder", "filler"} & own:
        return True
    left = [line.strip() for i, line in enumerate(lines) if i not in found and i not in skip]
    left = [line for line in left if _WORDS.search(line) and not _RE["beside"].match(line.lower())]
    if not own:
        return not left  # subtracted evidence counts only if the page has nothing else
    real = 0
    for line in left:
        n = len(_WORDS.findall(line))
        if n >= LONG_WORDS or (n >= SENTENCE_WORDS and _FULL_STOP.search(line)):
            real += n
    return real < REAL_WORDS


@F.pandas_udf(T.BooleanType())
def _content_flags(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, title, recurrent in batches:
        flags = []
        for x, t, r in zip(text, title, recurrent):
            keys = set() if r is None else set(r)
            numbers = [i for i, line in enumerate(x.split("\n")) if line_key(_WORDS.findall(line.lower())) in keys] if keys else []
            flags.append(content_evidence(x, t, numbers))
        yield pd.Series(flags, dtype=bool)


@F.pandas_udf(T.BooleanType())
def _title_flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for title in batches:
        yield title.map(title_evidence).astype(bool)


def recurrent_lines(scan: DataFrame) -> DataFrame:
    """(row_no, recurrent): keys of the lines of each row with evidence that recur on its host, counted exactly over all rows.

    A line counts once for each distinct text of the host, so a page delivered many times makes none of its lines recur.
    """
    texts = scan.filter("text_id is not null")
    lines = texts.select("host", F.col("text_id").alias("text"), F.explode(F.array_distinct("keys")).alias("line"))
    pairs = lines.select(F.xxhash64("host", "line").alias("key"), "text").distinct()
    counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= LEAST_TEXTS)
    sizes = texts.select("host", "text_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    keyed = scan.filter("evidence").select("row_no", "host", F.explode(F.array_distinct("keys")).alias("line")).withColumn("key", F.xxhash64("host", "line"))
    hit = lookup_join(keyed, stored(counts, "line-counts"), ["key"]).filter(F.col("n_texts").isNotNull())
    hit = lookup_join(stored(hit, "recurrent"), stored(sizes, "hosts"), ["host"])
    return hit.filter(F.col("n_texts") >= LEAST_SHARE * F.col("n_host")).groupBy("row_no").agg(F.collect_set("line").alias("recurrent"))


def faulty_contents(scan: DataFrame) -> DataFrame:
    """(row_no) of items whose content is a template, filler, an error page or a demand for scripts. ``scan``: scan.scanned(items)."""
    held = scan.filter("evidence").select("row_no", "title", "content")
    marked = held.join(recurrent_lines(scan), "row_no", "left")
    return stored(marked.filter(_content_flags("content", "title", "recurrent")).select("row_no"), "faulty")


def faulty_fields(items: DataFrame, scan: DataFrame) -> DataFrame:
    """(row_no, field_name): the titles and contents that are no real text. ``scan``: scan.scanned(items).

    Null and blank fields are none. row_no must be unique. Texts that only talk about errors or templates, and real pages with a
    notice outside their body, are none. Extra columns are ignored.
    """
    titles = items.select("row_no", "title").filter(_title_flags(F.col("title"))).select("row_no", F.lit("title").alias("field_name"))
    return faulty_contents(scan).select("row_no", F.lit("content").alias("field_name")).unionByName(titles)


def real_items(items: DataFrame, scan: DataFrame) -> DataFrame:
    """The items without those whose content or title is faulty; all columns are kept."""
    return items.join(faulty_fields(items, scan).select("row_no").distinct(), "row_no", "left_anti")
