"""The main body of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is a chain of units: the leaf blocks of its DOM, cut at line ends; in plain text each line is a leaf. Features of a unit
are its class (by words and shape), length, separators, place in the page, ancestor tags and the classes of its neighbours. Two
labels, body and furniture; Viterbi decodes. Weights are in models/boilerplate.json, trained by boilerplate_train.py.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = Path(__file__).parent / "models" / "boilerplate.json"
#: A line of more words is no link, menu or heading; its sentences are judged one by one.
LINK_WORDS = 24

#: Wording of page furniture in English, French, German and Spanish, by kind.
_KINDS = {
    "skip": r"^(?:skip to (?:main )?content|aller au contenu(?: principal)?|zum (?:haupt)?inhalt springen|(?:ir|saltar) al contenido(?: principal)?|jump to (?:navigation|search|content))$",
    "top": r"^(?:back to top|to top|(?:retour en )?haut de page|nach oben|zum seitenanfang|volver arriba|subir)$",
    "ad": r"^(?:advertisements?|sponsored(?: content)?|ad|anzeige|werbung|publicit[ée]|annonce|publicidad|anuncio|(?:story|article) continues below(?: advertisement)?|la suite (?:apr[èe]s|sous) .{0,30}|(?:der )?artikel geht .{0,20}weiter|weiter nach der anzeige|(?:la noticia )?contin[úu]a (?:abajo|m[áa]s abajo|despu[ée]s de .{0,30}))$",
    "share": r"^(?:share(?: (?:this|on)\b.{0,40})?|partager(?: cet article| sur\b.{0,30})?|(?:artikel|beitrag|diesen (?:artikel|beitrag)) teilen|teilen|compartir(?: (?:este )?(?:art[íi]culo|en\b.{0,30}))?|tweet\b.{0,40}|listen to this article.{0,20}|[ée]couter (?:cet )?article.{0,20}|artikel anh[öo]ren.{0,20}|escuchar (?:este )?art[íi]culo.{0,20}|(?:print|drucken|imprimer|imprimir)(?: this page)?(?: (?:e-?mail|save|share|merken|senden|teilen|envoyer|partager|enregistrer|enviar|guardar|compartir)){0,3}|save for later|copy link)$",
    "head": r"^(?:most (?:read|popular|viewed)|trending(?: now)?|popular(?: (?:in|on|now|posts)\b.{0,40})?|you may also like|you might also like|related(?: (?:articles|stories|posts|links|topics|reading))?|recommended(?: for you)?|latest (?:from|news|on)\b.{0,40}|more (?:from|in|on)\b.{0,40}|editors?.? picks?|les plus (?:lus|r[ée]cents|consult[ée]s)|sur le m[êe]me (?:th[èe]me|sujet)|[àa] la une(?: de\b.{0,40})?|[àa] lire aussi|articles? (?:li[ée]s|similaires)|vous aimerez aussi|das k[öo]nnte sie auch interessieren|neu (?:auf|bei|in)\b.{0,40}|meistgelesen(?:e artikel)?|mehr (?:zum thema|von\b.{0,40}|aus\b.{0,40})|beliebt\b.{0,30}|verwandte (?:artikel|themen)|am h[äa]ufigsten gelesen|lo m[áa]s (?:le[íi]do|visto|popular)|tambi[ée]n le puede interesar|le puede interesar|lo [úu]ltimo (?:en|de)\b.{0,40}|[úu]ltimas noticias|art[íi]culos relacionados|m[áa]s (?:de|en)\b.{0,30})\s*:?$",
    "also": r"^(?:read (?:also|more|next)|see also|related(?: \w+)?|also on\b.{0,30}|more|[àa] lire(?: aussi)?|lire aussi|voir aussi|lesen sie auch|lesen sie (?:mehr|weiter)|mehr dazu|auch interessant|lea tambi[ée]n|lee tambi[ée]n|ver tambi[ée]n|relacionado)\s*[:>›»–-]",
    "cookie": r"(?:\b(?:we|this (?:site|website)|by continuing|your privacy|cookie (?:preferences|settings|policy|notice)|manage (?:choices|cookies)|accept (?:all|cookies)|nous (?:utilisons|conservons)|en poursuivant|vos donn[ée]es|votre vie priv[ée]e|param[ée]trer|tout (?:accepter|refuser)|wir (?:verwenden|nutzen|respektieren)|mit (?:der nutzung|ihrer zustimmung)|cookie-(?:einstellungen|hinweis)|alle (?:akzeptieren|ablehnen)|usamos cookies|utilizamos cookies|al (?:seguir|continuar) navegando|configurar cookies|aceptar (?:todo|todas)|su privacidad)\b.*(?:cookie|tracker|traceur|partner|partenaire|socios|privacy|choices|consent|einwilligung|datenverarbeitung|akzeptieren|accept|aceptar|rechazar|reject|settings|einstellungen|param[ée]trer|privacidad|vie priv[ée]e)|^(?:cookie preferences|cookie-einstellungen|configurar cookies|g[ée]rer (?:mes|les) cookies|param[èe]tres des cookies)\b)",
    "rights": r"(?:©|\(c\)|^copyright\b|all rights reserved|tous droits r[ée]serv[ée]s|alle rechte vorbehalten|todos los derechos reservados)",
    "legal": r"(?:terms (?:of (?:use|service)|and conditions)|privacy policy|accessibility|\bsitemap\b|site map|\bimprint\b|mentions l[ée]gales|confidentialit[ée]|plan du site|conditions (?:g[ée]n[ée]rales|d.utilisation)|impressum|datenschutz|\bagb\b|barrierefreiheit|aviso legal|mapa (?:web|del sitio)|pol[íi]tica de (?:privacidad|cookies)|condiciones de uso|change region|cambiar (?:de )?regi[óo]n|changer de r[ée]gion|region [äa]ndern)",
    "owner": r"^(?:powered by\b|proudly powered\b|un service de\b|un servicio de\b|ein (?:angebot|service|dienst) von\b|.{1,40} is a (?:service|product|division) of\b|(?:site )?propuls[ée] par\b|con la tecnolog[íi]a de\b|bereitgestellt von\b)",
    "follow": r"^(?:follow\b.{1,40}|(?:sign up|subscribe) (?:for|to)\b.{1,40}|newsletter (?:von|de|abonnieren)\b.{0,40}|folgen sie\b.{1,40}|abonnieren sie\b.{0,40}|abonnez-vous\b.{1,40}|suivez(?:-nous)?\b.{0,40}|inscrivez-vous\b.{0,40}|suscr[íi]base\b.{1,40}|s[íi]ganos\b.{0,40}|siga\b.{1,40}|already (?:a subscriber|have an account|a member)\b.{0,30}|d[ée]j[àa] abonn[ée]\b.{0,30}|(?:bereits|schon) abonn(?:iert|ent)\b.{0,30}|ya (?:es|eres) suscriptor\b.{0,30}|¿ya (?:es|eres) suscriptor.{0,30}|create (?:an|your) (?:free )?account|get our (?:app|newsletter).{0,20})[.!?]?$",
    "script": r"(?:enable|allow|switch on|turn on|activate|requires?|needs?|necesita|n[ée]cessite|ben[öo]tigt|activer|activez|activar|active|activa|habilite|aktivieren|disabled|deaktiviert|d[ée]sactiv[ée]|desactivad[oa]|unsupported|not supported|blocked)\b.{0,60}\b(?:javascript|scripts?|skripte)|(?:javascript|scripts?|skripte)\b.{0,40}\b(?:enable|disabled|required|requis|erforderlich|necesario|aktivieren|deaktiviert|d[ée]sactiv[ée]|desactivad[oa]|blocked|bloqu[ée]s?|bloqueados?|blockiert|on before)",
}
#: Each pattern is matched against lower-cased text. A pattern that is searched comes with literals one of which every match holds,
#: so that most lines are told apart without it; patterns anchored at the begin are matched there only.
_NEEDS = {
    "cookie": ("cookie", "tracker", "traceur", "partner", "partenaire", "socios", "privacy", "choices", "consent", "einwilligung", "datenverarbeitung", "akzeptieren", "accept", "aceptar", "rechazar", "reject", "settings", "einstellungen", "param", "privacidad", "vie priv"),
    "rights": ("©", "(c)", "copyright", "reserv", "vorbehalten", "droits"),
    "legal": ("terms ", "privacy", "accessib", "sitemap", "site map", "imprint", "mentions l", "confidentialit", "plan du site", "conditions ", "impressum", "datenschutz", "agb", "barrierefrei", "aviso legal", "mapa ", "tica de ", "condiciones", "gion", "gión"),
    "script": ("script", "skript"),
}
#: The same in order; kinds matched at the begin are joined where they follow each other, the first that matches counts.
_TEST = [(re.compile("|".join(f"(?P<{k}>{_KINDS[k]})" for k in own)).match, ()) for own in (("skip", "top", "ad", "share", "head", "also"), ("owner", "follow"))]
_TEST[1:1] = [(re.compile(f"(?P<{k}>{_KINDS[k]})").search, _NEEDS[k]) for k in ("cookie", "rights", "legal")]
_TEST.append((re.compile(f"(?P<script>{_KINDS['script']})").search, _NEEDS["script"]))
_ORDER = {k: i for i, k in enumerate(_KINDS)}
_LEGAL = re.compile(_KINDS["legal"])
#: Words of a consent notice in English, French, German and Spanish: its subject, what it names beside, who speaks.
_CONSENT = frozenset("cookie cookies tracker trackers traceur traceurs consent consentement einwilligung zustimmung consentimiento".split())
_BESIDE = frozenset(
    "partners partner partenaires partnern socios device devices appareil gerät endgerät dispositivo personalise personalize personalised personalized personnaliser personalisieren personalizar ads advertising publicité publicités "
    "werbung anzeigen anuncios publicidad privacy choices preferences settings accept reject akzeptieren ablehnen aceptar rechazar accepter refuser analytics measure mesurer messen medir traffic trafic browser browsing technologies "
    "technologien tecnologías store stocker speichern almacenar einstellungen paramètres préférences preferencias datenschutz privacidad confidentialité policy improve améliorer verbessern mejorar".split()
)
_SPEAKER = frozenset("we our us nous nos notre wir unser unsere unseren unserer uns usamos utilizamos nuestro nuestra nuestros nuestras continuing".split())
_NAMED = _CONSENT | _BESIDE
#: Words one of which a long notice holds.
_LONG_GATE = _CONSENT | frozenset("reserved réservés vorbehalten reservados copyright javascript script scripts skripte".split())
_NOTICES = frozenset(("cookie", "rights", "legal", "owner", "follow", "script", "share"))
#: Fixed value: words that menus consist of.
MENU = frozenset(
    "home news research products labs about login podcasts topics help shop press search subscribe markets careers newsletter events support blog "
    "partners pricing contact archive archives menu account register sign accueil actualités recherche produits emplois connexion thèmes presse aide "
    "boutique tarifs marchés contact partenaires laboratoires startseite aktuelles forschung produkte karriere anmelden themen hilfe suche kontakt "
    "archiv preise märkte datenschutz impressum inicio noticias investigación mercados productos precios empleo contacto prensa ayuda tienda temas "
    "archivo acceder buscar suscribirse team jobs faq videos photos sports weather opinion culture services solutions docs community forum".split()
)
_STOP = frozenset("the this that and with from for you your our are have all more les des nos mes der die das und sie von mit ein los las del para por con que una cet cette est han has not was sur plus zum zur aus bei auf sus your get can may one out use its den dem".split())


def _keywords() -> frozenset[str]:
    """Words one of which any line of a kind must have, read off the patterns."""
    found: set[str] = set("hauptinhalt abonniert abonnent abonnieren seitenanfang cookies".split())
    for p in _KINDS.values():
        for i in (0, 1):
            flat = re.sub(r"\[([^\W\d_])([^\W\d_])\]", lambda m: m[1 + i], p)
            for w, more in re.findall(r"([^\W\d_]{3,})(\??)", re.sub(r"\\[bsdwS]", " ", flat)):
                found |= {w, w[:-1]} if more else {w}
    return frozenset(found - _STOP)


_KEYWORDS = _keywords()
_SPLIT = re.compile(r"\s*[|·•›»>/\t]\s*|\s{2,}")
_SEPARATOR = re.compile(r"[|·•›»>/\t]")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*$")
_BLANKS = re.compile(r"[^\S\t\n]+")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_BULLET = re.compile(r"^(?:[-*•+–]|\d{1,3}[.)])\s+")
_CELL = re.compile(r"^[\d.,%$€ –-]+$")
_WORD = re.compile(r"\w+")


def _wording(t: str, low: str, n: int) -> str | None:
    """The kind of furniture whose wording a line or sentence of n words has."""
    bare = low.strip(" \t[](){}<>*-–—:.·•|►▶→↑") if n <= 6 else low
    for test, needs in _TEST:
        if needs and not any(map(low.__contains__, needs)):
            continue
        hit = test(low)
        kind = hit.lastgroup if hit else None
        if bare is not low and (hit := test(bare)) and (kind is None or _ORDER[hit.lastgroup] < _ORDER[kind]):
            kind = hit.lastgroup
        if kind:
            if kind == "legal" and n > 7 and _SENTENCE.search(t) and len(_LEGAL.findall(low)) < 2:
                continue
            return kind
    return None


def _long_wording(t: str, low: str, words: list[str]) -> str | None:
    """The same for a line of more than LINK_WORDS words: notices must make up two thirds of it, sentence by sentence.

    A sentence that is longer itself is a consent notice if it names its subject, three such things in all, and speaks as "we", and
    every eighth word is one of these.
    """
    if _LONG_GATE.isdisjoint(words) and "©" not in t:
        return None
    sums: dict[str, int] = {}
    other, total = 0, t.count(" ") + 1
    for part in _SENTENCES.split(t):
        n = part.count(" ") + 1
        part_low = part.lower()
        kind = None
        if n <= LINK_WORDS:
            kind = _wording(part, part_low, n)
        else:
            own = _WORD.findall(part_low)
            held = set(own)
            named = held & _NAMED
            if len(named) >= 3 and held & _CONSENT and held & _SPEAKER and 8 * sum(w in named or w in _SPEAKER for w in own) >= len(own):
                kind = "cookie"
        if kind in _NOTICES:
            sums[kind] = sums.get(kind, 0) + n
        else:
            other += n
            if 3 * other > total:
                return None
    return max(sums, key=sums.__getitem__) if sums else None


def shape(t: str, low: str, words: list[str]) -> str:
    """The class of a line by its wording and shape. low: the line in lower case; words: its words."""
    raw = t
    spaces = t.count(" ")
    if len(t) > 240 and spaces >= LINK_WORDS:
        kind = _long_wording(t, low, words)
        return kind or ("item" if _BULLET.match(t) else "sentence" if _SENTENCE.search(t, len(t) - 8) else "long")
    if "  " in t or not (t.isascii() and t.isprintable()):
        t = _BLANKS.sub(" ", t)
        low = t.lower()
    n = t.count(" ") + 1
    if n > LINK_WORDS:
        kind = _long_wording(t, low, words)
    else:
        kind = _wording(t, low, n) if n < 5 or not _KEYWORDS.isdisjoint(words) or "©" in t else None
    if kind:
        return kind
    if _BULLET.match(t):
        return "item"
    cells = [c for c in _SPLIT.split(t) if c] if _SEPARATOR.search(t) else [t]  # t has no two blanks in a row
    if len(cells) < 3 and "  " in raw:
        wide = [c for c in _SPLIT.split(raw) if c]
        if wide and sum(c.lower() in MENU for c in wide) * 2 >= len(wide):
            return "menu"
    known = sum(w in MENU for w in words)
    if len(cells) >= 3 and not (len(words) > 14 and _SENTENCE.search(t)):
        if any(_CELL.match(c) for c in cells):
            return "row"
        if known * 2 >= len(words) or (all(len(_WORD.findall(c)) <= 3 for c in cells) and known):
            return "menu"
        if all(len(_WORD.findall(c)) <= 2 for c in cells):
            return "bar"
    if len(cells) == 2 and known and len(words) <= 5:
        return "menu"
    if not words:
        return "mark"
    if n <= 2 and len(t) > 40:
        return "long"
    if len(words) <= 2 and not _SENTENCE.search(t):
        return "word" if known else "name"
    if known >= 2 and known * 3 >= 2 * len(words) and len(words) <= 10:
        return "menu"
    if _SENTENCE.search(t, max(0, len(t) - 8)):
        return "sentence" if n >= 5 else "phrase"
    return "long" if n >= 10 else "heading" if n >= 3 else "name"


def _read(t: str) -> tuple[str, list[str]]:
    low = t.lower()
    words = _WORD.findall(low)
    return shape(t, low, words), words


_read_short = lru_cache(maxsize=50_000)(_read)


def read_line(t: str) -> tuple[str, list[str]]:
    """(class, words) of a line without outer white space; short lines recur and are kept."""
    return _read_short(t) if len(t) < 120 else _read(t)


def features(texts: list[str], title: str = "", tags: list[frozenset[str]] | None = None, joined: list[bool] | None = None, read: list[tuple[str, list[str]]] | None = None) -> list[tuple]:
    """What decides each unit, for expand(). tags: the ancestors of each; joined: whether a unit continues the block of the one
    before; read: read_line() of each, where it is known."""
    if read is None:
        read = [read_line(t) for t in texts]
    kinds = [r[0] for r in read]
    total = len(texts)
    solid = [i for i, k in enumerate(kinds) if k == "sentence" or k == "long"]
    first, last = (solid[0], solid[-1]) if solid else (total, -1)
    name = " ".join(_WORD.findall(title.lower()))
    out = []
    heads = 0  # units since a heading of a list of links
    for i, (t, k) in enumerate(zip(texts, kinds)):
        before, after = kinds[i - 1] if i else "^", kinds[i + 1] if i + 1 < total else "$"
        heads = 1 if k == "head" else heads + 1 if heads and k in ("heading", "name", "phrase", "item") else 0
        place = "in" if first <= i <= last else "pre" if i < first else "post"
        special = None
        if k == "heading" or k == "name" or k == "phrase":
            plain = " ".join(read[i][1])
            same = bool(plain and name and (plain == name or (len(plain) > 12 and (plain in name or name in plain))))
            run = 0
            while run < 4 and i + run + 1 < total and kinds[i + run + 1] == k:
                run += 1
            back = 0
            while back < 4 and i - back - 1 >= 0 and kinds[i - back - 1] == k:
                back += 1
            special = (min(heads, 7), same, min(run + back, 4), i == 0, i == total - 1)
        out.append((k, before, after, place, min(t.count(" ") // 4, 8), special, tags[i] if tags is not None else None, bool(joined and joined[i])))
    return out


def expand(sign: tuple) -> list[str]:
    """The names of a unit's features."""
    k, before, after, place, n, special, tags, joined = sign
    f = ["1", "k=" + k, f"k={k},{place}", f"{before}>{k}", f"{k}<{after}", f"n={n}", f"{before}>{k}<{after}"]
    if special:
        heads, same, run, is_first, is_last = special
        f += [f"heads={heads},{k},{place}", f"run={run},{k},{place}", f"first={is_first},{k}", f"last={is_last},{k}"]
        if same:
            f.append("title")
    if tags is not None:
        f.append("html," + k)
        for x in sorted(tags):
            f += ["t=" + x, f"t={x},{k}"]
    if joined:
        f.append("joined")
    return f


class Chain:
    """A conditional random field with the labels 0 (body) and 1 (furniture); weights score label 1 against label 0."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], tie: float):
        self.weights, self.steps, self.tie = weights, steps, tie
        self.known: dict[tuple, float] = {}

    def score(self, sign: tuple) -> float:
        value = self.known.get(sign)
        if value is None:
            if len(self.known) > 100_000:
                self.known.clear()
            value = self.known[sign] = sum(self.weights.get(f, 0.0) for f in expand(sign))
        return value

    def decode(self, units: list[tuple]) -> list[int]:
        """The best labels by Viterbi; a unit that continues a block is tied to the one before by ``tie``."""
        (s00, s01), (s10, s11) = self.steps
        a, b = 0.0, 0.0
        back = []
        for i, sign in enumerate(units):
            x = self.score(sign)
            if i:
                tie = self.tie if sign[-1] else 0.0
                stay0, move0 = a + s00 + tie, b + s10
                stay1, move1 = b + s11 + tie, a + s01
                back.append((0 if stay0 >= move0 else 1, 1 if stay1 >= move1 else 0))
                a, b = max(stay0, move0), max(stay1, move1)
            b += x
        at = int(b > a)
        labels = [at]
        for pair in reversed(back):
            at = pair[at]
            labels.append(at)
        return labels[::-1] if units else []


@cache
def model() -> Chain:
    read = json.loads(MODEL.read_text())
    return Chain(read["weights"], read["steps"], read["tie"])


def text_units(text: str) -> tuple[list[str], list[int]]:
    """The lines with visible text and their numbers."""
    lines = [(line.strip(), i) for i, line in enumerate(text.split("\n"))]
    kept = [(t, i) for t, i in lines if t]
    return [t for t, _ in kept], [i for _, i in kept]


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
_HIDDEN = ("script", "style", "noscript", "head", "template", "svg", "iframe", "textarea", "title")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_VOID = frozenset("br hr img input meta link source area base col embed param track wbr".split())
_INLINE = frozenset("a b i em strong span font u s sub sup code mark q cite abbr time label wbr small".split())
_ANCESTOR = frozenset("nav header footer aside main article section ul ol li table td th tr h1 h2 h3 h4 h5 h6 p blockquote form button a small div body font figure figcaption".split())
_HINT = re.compile(r"(?:class|id|role|aria-label|aria-live)\s*=\s*[\"']?([^\"'>]*)", re.I)
_HINTS = (
    ("bad", re.compile(r"nav|menu|cookie|consent|banner|foot|side|\bsb\b|widget|promo|related|share|social|breadcrumb|polite|comment|newsletter|subscribe|legal", re.I)),
    ("good", re.compile(r"content|article|main|post|story|entry|\bbody\b|text", re.I)),
)
_ENTER = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "tr", "div", "section", "blockquote", "table", "ul", "ol"}
#: What an opening tag closes if it is still open.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
           **{x: {"p"} for x in ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "footer", "header", "main", "blockquote", "form", "h1", "h2", "h3", "h4", "h5", "h6")}}


def html_units(html: str) -> tuple[list[str], list[int], list[frozenset[str]], list[bool], str]:
    """Leaf blocks of a page cut at line ends: (texts, line numbers, ancestors, continues the block before, title)."""
    texts: list[str] = []
    lines: list[int] = []
    tags: list[frozenset[str]] = []
    joined: list[bool] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    title = ""
    line, pos, fresh, seen = 0, 0, True, set()
    buffer: list[str] = []
    hidden = ""

    def flush() -> None:
        nonlocal fresh
        text = unescape("".join(buffer)).strip()
        buffer.clear()
        if text:
            texts.append(re.sub(r"[^\S\t]{3,}", "  ", text))
            lines.append(line)
            open_tags = {t for t, _ in stack if t in _ANCESTOR} | {h for _, hs in stack for h in hs} | {f"seen-{s}" for s in seen}
            near = next((t for t, _ in reversed(stack) if t not in _INLINE), "")
            tags.append(frozenset(open_tags | {f"in-{near}"}))
            joined.append(not fresh)
            fresh = False

    def read(text: str) -> None:
        nonlocal line
        first, *more = text.split("\n")
        if not hidden:
            buffer.append(first)
        for part in more:
            flush()
            line += 1
            if not hidden:
                buffer.append(part)

    for m in _TOKEN.finditer(html):
        read(html[pos : m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        inner = m[0].count("\n")
        if name and hidden:
            if m[1] and name == hidden:
                hidden = ""
                buffer.clear()
        elif name:
            if name not in _INLINE:
                flush()
                fresh = True
            if m[1]:
                names = [t for t, _ in stack]
                if name in names:
                    del stack[len(names) - 1 - names[::-1].index(name) :]
                elif name in ("article", "main", "aside", "nav", "footer", "header", "section", "div"):
                    wide = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] in ("article", "main", "aside", "nav", "footer", "header", "section", "div")), None)
                    if wide is not None:  # a wide element closed under another name
                        del stack[wide:]
                if name in ("nav", "header", "main", "article"):
                    seen.add(name)
            elif name in _HIDDEN and not m[0].endswith("/>"):
                hidden = name
                if name == "head":
                    t = _TITLE.search(html, pos)
                    title = unescape(t[1]) if t else ""
            elif name not in _VOID:
                closes = _CLOSES.get(name)
                while closes and stack and stack[-1][0] in closes:
                    stack.pop()
                hints = " ".join(_HINT.findall(m[3] or ""))
                stack.append((name, tuple(h for h, p in _HINTS if hints and p.search(hints))))
                if name == "h1":
                    seen.add("h1")
        if inner:
            flush()
            line += inner
    read(html[pos:])
    flush()
    return texts, lines, tags, joined, title


def furniture_lines(text: str | None, title: str | None = "") -> list[int]:
    """Numbers of the lines of a plain text that hold visible text outside the main body."""
    if not text:
        return []
    texts, numbers = text_units(text)
    return [n for n, y in zip(numbers, model().decode(features(texts, title or ""))) if y]


def furniture_html(html: str | None) -> list[int]:
    """The same for html: a line is furniture if most of its visible text is."""
    if not html:
        return []
    texts, numbers, tags, joined, title = html_units(html)
    weight: dict[int, int] = {}
    for t, n, y in zip(texts, numbers, model().decode(features(texts, title, tags, joined))):
        weight[n] = weight.get(n, 0) + (len(t) if y else -len(t))
    return [n for n, w in weight.items() if w > 0]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def html_furniture(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        yield pd.Series([furniture_html(x) for x in html])


def page_furniture(scan: DataFrame, pages: DataFrame, faulty: DataFrame) -> DataFrame:
    """(table_name, rec_no, line_no): lines outside the main body in the content of items and the html of ``pages``.

    ``scan``: scan.scanned(items, furniture=True); ``faulty``: (row_no) of items to leave out. Pages count with status 200. Null
    and blank texts have no line; lines without visible text are in neither class. Extra columns are ignored; repeated rows give
    repeated lines.
    """
    found = scan.filter(F.size("furniture") > 0).select("row_no", "furniture")
    kept = found.join(faulty.select("row_no", F.lit(True).alias("faulty")).distinct(), "row_no", "left").filter(F.col("faulty").isNull())
    a = kept.select(F.lit("webset_items").alias("table_name"), F.col("row_no").alias("rec_no"), F.explode("furniture").alias("line_no"))
    htmls = pages.filter((F.col("status") == 200) & F.col("html").isNotNull())
    b = htmls.select(F.lit("fetch_results").alias("table_name"), F.col("fetch_no").alias("rec_no"), F.explode(html_furniture("html")).alias("line_no"))
    return a.unionByName(b)


@F.pandas_udf(T.StringType())
def text_body(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, title in batches:
        out = []
        for x, t in zip(text, title):
            if x is None:
                out.append(None)
                continue
            drop = set(furniture_lines(x, t))
            out.append("\n".join(line for i, line in enumerate(x.split("\n")) if i not in drop))
        yield pd.Series(out)


@F.pandas_udf(T.StringType())
def html_body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        out = []
        for x in html:
            if x is None:
                out.append(None)
                continue
            texts, numbers, tags, joined, title = html_units(x)
            labels = model().decode(features(texts, title, tags, joined))
            out.append("\n".join(t for t, y in zip(texts, labels) if not y))
        yield pd.Series(out)
