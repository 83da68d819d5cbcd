"""Personal information in free text: e-mail addresses, phone numbers, identity numbers, street addresses, names of persons.

High-recall generators propose overlapping spans; boosted trees score each span by its format and context (weights in
models/pii.json, trained by pii_train.py); spans over their kind's calibrated threshold are selected, best first, without
overlap, and replaced by typed placeholders. Name words come from a bounded list that is part of the input, and words formed
like those on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = Path(__file__).parent / "models" / "pii.json"
KINDS = ("email", "phone", "id_number", "address", "name")
#: The list of name words is small and fixed; more than this many is an error, as it is sent to every task.
MAX_NAME_WORDS = 100_000

# Wording in English, French, German and Spanish.
_AT = r"(?:@|\s*[\[({<]\s*(?:at|@|arroba|chez|[àa])\s*[\])}>]\s*|\s+(?:AT|at|arroba)\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|\s+(?:DOT|dot|punkt|point|punto)\s+)"
_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_AT_BRACKET = re.compile(r"[\[({<]\s*(?:at|arroba|chez)\s*[\])}>]")
#: Each begins with a word of its own, which is searched for fast; what follows is only looked at.
_AT_WORDS = {
    word: re.compile(word + r"(?=(\s+[A-Za-z0-9-]+(?:\s+(?:DOT|dot|punkt|punto|point)\s|\s*[\[({<]\s*(?:dot|punkt|punto|point)|\.[a-z])))") for word in ("AT", "at", "arroba")
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_FILE_END = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|css|js|html?|pdf|json|ts|zip)$|(?:^|\.)\d+$", re.I)
_NUMBER = re.compile(r"(?<![\w.,@/#%-])(?:\+|\()?\d(?:[\d  ./()‑–-]*\d)(?![\w@]|[.,]\d)")
_ALNUM = re.compile(
    r"(?<![\w-])(?:(?i:[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|\d{8}[ -]?[A-Z]|\d{2}\.\d{3}\.\d{3}[ -]?[A-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]|[A-Z]{1,3}[ -]?\d{6,9}[A-Z]?|\d{2}[A-Z]{2}\d{5})|(?=[A-Z]*\d)(?=[A-Z0-9]*\d[A-Z]*\d[A-Z]*\d[A-Z]*\d)[A-Z][A-Z0-9]{8,9})(?![\w-])"
)
_PHONE_CUE = re.compile(r"(?:\btel\b|t[ée]l|phone|fon\b|\bcall(?:ed|s)?\b|\bmobile\b|\bcell\b|appel|r[ée]pond|llam[ea]|contestaba|\bm[óo]vil\b|\bunter\b|anruf|handy|picked up|as (?:her|his|their) number|\bgives\b|\bnumber\b|\bor by phone to\b|\bor\b|\bou\b|\boder\b|fax|whatsapp|sms)[^\n]{0,24}$", re.I)
_PHONE_AFTER = re.compile(r"^[^\n]{0,6}(?:meldete sich|thx|before noon|as (?:her|his|their) number|that week|ext\b)", re.I)
_ID_CUE = re.compile(
    r"(?:\bssn\b|social[ -]security|national insurance|\bn\.?i\.? ?(?:no|number)|\bnino\b|tax(?:payer)? (?:id|no|number|file)|\btin\b|\bitin\b|passport|passeport|pasaporte|reisepass|identity (?:card|no|number)|\bid (?:card|no|number)|national id|"
    r"\bdni\b|\bnie\b|\bnif\b|\bnir\b|s[ée]curit[ée] sociale|num[ée]ro fiscal|carte (?:nationale )?d.identit[ée]|\bcni\b|\binsee\b|steuer|\bidnr\b|\bausweis|personalausweis|sozialversicherung|rentenversicherung|seguridad social|n[úu]mero de (?:identidad|identificaci[óo]n)|documento|identificaci[óo]n fiscal|number and)[^\n]{0,30}$",
    re.I,
)
_ID_AFTER = re.compile(r"^[^\n]{0,4}(?:as (?:her|his|their) (?:ssn|tax|passport|id|national)|,? ?(?:signed|a sign[ée]|hat .{0,20}unterschr|firm[óo]))", re.I)
_NOT_CUE = re.compile(
    r"(?:\bisbn\b|\bissn\b|\bdoi\b|version|versi[óo]n|\bv\.?$|\bbuild\b|\border\b|commande|bestellung|pedido|\bpart no|\bpages?\b|seiten?\b|p[áa]ginas?|\bvolume\b|\bband\b|\bgrant\b|invoice|\brun\b|\bitem\b|\bat \d|latitude|longitude|coordinates?|\bref\b|figure|table|ticket|\bip\b|\breads\b|reemplaza|remplace|ersetzt|sustituye|tracking|serial|model|\bkB\b|\blot\b|patent)[^\n]{0,14}$",
    re.I,
)
_STREET = r"(?:Street|St|Lane|Ln|Row|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Close|Court|Ct|Way|Walk|Place|Pl|Square|Sq|Terrace|Crescent|Gardens|Grove|Hill|Mews|Parade|Parkway|Pkwy|Highway|Alley|Quay|Wharf|Park|Circle)"
_UNIT = r"(?:(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Floor|Fl|App(?:t|artement)?|Whg|Wohnung|Piso|Puerta|Bât(?:iment)?)\.? ?#?(?:\d{1,4}[A-Za-z]?|[A-Z]),? )"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_NUMBER_FIRST = re.compile(
    rf"\d{{1,5}} ?[A-Za-z]?(?:[/-]\d{{1,4}}[A-Za-z]?)?,? (?:(?:North|South|East|West|[NSEW]\.?|NE|NW|SE|SW) )?(?:(?:Old|New|Upper|Lower|Great|Little|St\.?) )?{_CAP}(?: {_CAP})?(?<!\b[NSEW]) {_STREET}\b"
    rf"|\d{{1,4}} ?(?:bis|ter|quater|[A-Da-d])?,? ?(?:rue|avenue|av\.|impasse|boulevard|bd|place|all[ée]e|chemin|quai|cours|route|square|passage|ruelle|villa|sentier|faubourg)(?: (?:de la|de l'|de l’|du|des|de|d'|d’|le|la|les))? ?{_CAP}(?:-{_CAP})?"
    rf"|\d{{1,4}} ?[A-Za-z]?,? (?:[Cc]alle|[Aa]venida|[Pp]aseo|[Pp]laza|[Cc]amino) (?:(?:de la|de los|de las|del|de) )?{_CAP}"
)
_UNIT_BEFORE = re.compile(rf"(?<![\w-]){_UNIT}$")
_NAME_FIRST = re.compile(
    rf"(?<![\w-])(?:(?:Alte|Neue|Am|An der|Im|Zum|Zur|Auf dem|Unter den|Hinter der)[ -])?[A-ZÄÖÜ][\wäöüß]*(?:[ -][A-ZÄÖÜ][\wäöüß]*)*?(?:[ -]?(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ufer|ring|damm|steig|hof|markt|chaussee|graben|Stra(?:ß|ss)e|Str\.|Weg|Allee|Platz|Gasse|Ufer|Ring|Damm)) $"
    rf"|(?<![\w-])(?:Am|An der|Im|Zum|Zur|Auf dem|Unter den|Hinter der|Beim) (?!Jahr|Jan|Feb|März|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Band|Kapitel){_CAP}(?:[ -]{_CAP})?,? $"
    rf"|(?<![\w-])(?:{_UNIT})?(?:[Cc]alle|C/|[Aa]venida|[Aa]vda\.?|[Pp]aseo|[Pp]laza|[Pp]asaje|[Cc]amino|[Rr]onda|[Tt]raves[íi]a|[Cc]allej[óo]n|[Cc]arretera|[Gg]lorieta|[Cc]uesta)(?: (?:de la|de los|de las|del|de))? ?{_CAP}(?: {_CAP})?,?(?: n\.?[ºo°]\.?| n[úu]m\.?| n[úu]mero)? ?$"
    rf"|(?<![\w-])(?:(?:Old|New|Upper|Lower) )?{_CAP} {_STREET}\.?,? (?:No\.? ?|nr\.? ?)?$"
)
#: Fixed value: what stands in lower case between the words of a street's name and its number.
_SMALL = frozenset(
    "de la los las del den der dem an auf unter hinter am im zum zur beim calle c/ avenida avda avda. paseo plaza pasaje camino ronda travesía travesia callejón callejon carretera glorieta cuesta "
    "n n. nº n° n.º n.° no no. nr nr. núm núm. num num. número numero straße strasse str. weg allee platz gasse ufer ring damm steig hof markt chaussee graben".split()
)


def _lead(text: str, a: int) -> int:
    """Where the run of capitalised and small words, flat numbers and commas before ``a`` begins, within the line."""
    begin = a
    while begin:
        stop = begin
        while stop and text[stop - 1] in " ,\xa0":
            stop -= 1
        word = (text[max(0, stop - 40) : stop].rsplit(None, 1) or [""])[-1] if stop and not text[stop - 1].isspace() else ""
        if len(word) == 40:
            word = text[:stop].rsplit(None, 1)[-1]
        bare = word.lstrip("([{\"'«“„‘¿¡")
        if not bare or not (bare[0].isupper() or bare.lower() in _SMALL or (begin < a and bare.lstrip("#")[:1].isdigit() and len(bare) < 7)):
            break
        begin = stop - len(bare)
        if bare is not word and bare != word:
            break
    return begin


_INTEGER = re.compile(r"\d\d*")  # a first character of its own is searched for faster than \d+
_REST = re.compile(r"\d{1,4} ?[a-zA-Z]?(?:[/-]\d{1,3})?(?![\w:]|[.,]\d)")


def address_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, bool]]:
    """Candidate addresses (start, end, begins with a flat or unit): each house number is tried with what follows and precedes it.

    runs: the text's runs of digits, where they are known.
    """
    out = []
    last = 0
    for a, b in [m.span() for m in _INTEGER.finditer(text)] if runs is None else runs:
        if b - a > 5 or a < last:
            continue
        before = text[a - 1] if a else "\n"
        if b < len(text) and (text[b] in " ,/-" or text[b].isalpha()) and not (before.isalnum() or before in "_.,/-"):
            hit = _NUMBER_FIRST.match(text, a)
            if hit:
                unit = _UNIT_BEFORE.search(text, max(0, a - 24), a)
                start = unit.start() if unit else a
                out.append((start, hit.end(), bool(unit)))
                last = hit.end()
                continue
        if before == " ":
            word = text[text.rfind(" ", 0, a - 1) + 1 : a - 1]
            if word.isalpha() and word.islower() and word not in _SMALL:
                continue  # no street's name
        # what _NAME_FIRST can end with
        begin = _lead(text, a) if b - a <= 4 and (before == " " or before.isalnum() or before in "_'’-,.º°") else a
        if begin < a:
            hit = _NAME_FIRST.search(text[begin:a])
            rest = _REST.match(text, a) if hit else None
            if rest:
                out.append((begin + hit.start(), rest.end(), bool(re.match(_UNIT, hit[0]))))
                last = rest.end()
    return out


def _lettered(text: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches of _ALNUM. Each holds four digits within ten characters, so only the surroundings of such are looked through; with
    fewer than six there, each of its runs follows a capital letter."""
    done, last = 0, len(runs) - 1
    for k, (a, b) in enumerate(runs):
        if b <= done:
            continue
        n, j = b - a, k
        while n < 4 and j < last and runs[j + 1][0] < a + 10:
            j += 1
            n += runs[j][1] - runs[j][0]
        if n < 4:
            continue
        if n < 6 and not (a and "A" <= text[a - 1] <= "Z"):
            i = j
            while n < 6 and i < last and runs[i + 1][0] < a + 10:
                i += 1
                n += runs[i][1] - runs[i][0]
            if n < 6:
                continue
        begin, end = max(done, a - 16), runs[j][1] + 16
        while end < len(text) and (text[end].isalnum() or text[end] in "_-"):
            end += 1
        for m in _ALNUM.finditer(text, begin, end):
            done = m.end()
            yield m
        done = max(done, runs[j][1])


#: What stands between the digits of a number.
_BETWEEN = frozenset("\u00a0 ./()\u2011\u2013-")


def _numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches of _NUMBER that may hold seven digits. Each begins with a run of digits or a sign before it, and ends with a run."""
    done, last = 0, len(runs) - 1
    for k, (a, b) in enumerate(runs):
        if a < done or b - a < 7 and (k == last or text[b] not in _BETWEEN or runs[k + 1][0] > b + 1 and text[b + 1] not in _BETWEEN):
            continue
        m = a and text[a - 1] in "+(" and _NUMBER.match(text, a - 1) or _NUMBER.match(text, a)
        if m:
            done = m.end()
            yield m


_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_COMPANY = frozenset(
    "group labs lab institute institut instituto foundation fondation stiftung systems networks robotics analytics biotech observatory gmbh ag kg inc ltd llc corp corporation company sa sl plc sas sarl "
    "university college school hospital museum society association press media partners holdings consulting studio studios bank church prize prix preis premio award medal médaille medaille medalla "
    "lecture scholarship fellowship grant fund street st lane ln road rd row avenue ave boulevard blvd drive close court way square park bridge hall tower library centre center theorem method filter filters fields "
    "index test algorithm model manual dataset effect law station airport stadium library river lake hill tour cup trophy chair building wing house product products".split()
)
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam mme mlle m monsieur madame docteur professeur herr herrn frau dipl ing sr sra srta don doña señor señora dra".split())
_ROLE_CUE = re.compile(
    r"(?:\bby|\bfrom|\bfrom:|contact:?|contact :|contacto:?|ansprechpartner(?:in)?:?|name(?: is)?:?|nom :?|titular:?|dossier :?|author(?: for correspondence)?:?|speaker \d ?\(|attention of|checked by|regards,|cordialement,|gr[üu](?:ß|ss)en,?|saludo,|geh[öo]rt zu|guest:|patient(?:in)?:?|signed|and|und|et|y|\"name\": \"|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|mme|herr|frau|sr\.?|sra\.?|episode|told|says|said|dit|sagt|dice|recalls|writes|joined|thanks?)\s*$",
    re.I,
)


class Words:
    """Which words can be given or family names: those on the list, and words with a beginning and an end seen on it."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.listed: dict[str, str] = {}
        begins: dict[str, dict[str, int]] = {"given": {}, "family": {}}
        ends: dict[str, dict[str, int]] = {"given": {}, "family": {}}
        for word, role in rows:
            if not word or role not in begins:
                continue
            low = word.lower()
            self.listed[low] = "both" if self.listed.get(low, role) != role else role
            if len(low) >= 5:
                begins[role][low[:3]] = begins[role].get(low[:3], 0) + 1
            ends[role][low[-2:]] = ends[role].get(low[-2:], 0) + 1
        self.begins = {r: {b for b, n in d.items() if n >= 2} for r, d in begins.items()}
        self.ends = {r: set(d) for r, d in ends.items()}
        self.seen: dict[str, tuple[str, bool, bool] | None] = {}
        self.held = _Held(self)

    def look(self, token: str) -> tuple[str, bool, bool] | None:
        """(role, on the list, ordinary word) or None."""
        known = self.seen.get(token, 0)
        if known != 0:
            return known
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[token] = out = self._look(token.lower())
        return out

    def _look(self, low: str) -> tuple[str, bool, bool] | None:
        if "-" in low:
            parts = [self._look(p) for p in low.split("-")]
            if any(p is None for p in parts):
                return None
            role = "family" if any(p[0] != "given" for p in parts) else "given"
            return role, any(p[1] for p in parts), all(p[2] for p in parts)
        role = self.listed.get(low)
        if role:
            plain = not (low[:3] in self.begins["given" if role == "both" else role]) or len(low) <= 4
            return role, True, plain
        begun = [r for r in ("given", "family") if len(low) >= 5 and low[:3] in self.begins[r]]
        roles = [r for r in begun if low[-2:] in self.ends[r]]
        if not roles:
            return None
        return ("both" if len(roles) == 2 else roles[0]), False, False

    def begun(self, token: str, role: str) -> bool:
        """Whether a word begins like the listed words of a role."""
        return len(token) >= 4 and token[:3].lower() in self.begins[role]


class _Held(dict):
    """What a text has between white space, to the name words in it; filled as it comes."""

    def __init__(self, words: Words):
        self.words = words

    def __missing__(self, part: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        out = self[part] = tuple(t for t in _TOKEN.findall(part) if self.words.look(t))
        return out


_GAP = re.compile(r"^(?:\s+|\s+(?:[A-ZÀ-Ý]\.\s*){1,2}|,\s+|\s+(?:[A-ZÀ-Ý]\s+)?)$")
_INITIAL = re.compile(r"(?<![\w.])((?:[A-Za-zÀ-Ý]\.[ -]?){1,3})$")


def name_spans(text: str, words: Words, emails: list[tuple[int, int]] | None = None) -> list[tuple[int, int, dict[str, float]]]:
    """Candidate names with features: chains of name words, and initials with a family name."""
    hits = []
    for token in set(chain.from_iterable(map(words.held.__getitem__, set(text.split())))):
        w = words.look(token)
        at = text.find(token)
        while at >= 0:
            end = at + len(token)
            joined = at and (text[at - 1].isalpha() or (at > 1 and text[at - 1] in "'’-" and text[at - 2].isalpha()))
            if not joined and _TOKEN.match(text, at).end() == end:
                hits.append((at, end, token, w))
            at = text.find(token, end)
    hits.sort()
    if emails:
        hits = [h for h in hits if not any(a <= h[0] < b for a, b in emails)]
    spans = []
    i = 0
    while i < len(hits):
        j = i
        comma = False
        while j + 1 < len(hits) and j - i < 3:
            gap = text[hits[j][1] : hits[j + 1][0]]
            if len(gap) > 9 or not _GAP.match(gap) or ("\n" in gap):
                break
            if gap.startswith(","):
                if comma or j > i + 1 or hits[i][3][0] == "given" or hits[j + 1][3][0] == "family":
                    break
                comma = True
            elif comma and hits[j + 1][3][0] == "family":
                break
            j += 1
        row = hits[i : j + 1]
        start, end = row[0][0], row[-1][1]
        roles = [w[0] for *_, w in row]
        lead = _INITIAL.search(text[max(0, start - 12) : start]) if "." in text[max(0, start - 3) : start] else None
        initial = bool(lead)
        if lead:
            start -= len(lead[1])
            if roles[0] != "family" and lead[1] in ("D. ", "M. "):  # titles before a given name
                start += len(lead[1])
                initial = False
        f = {
            "n": len(row), "given": sum(r != "family" for r in roles), "family": sum(r != "given" for r in roles), "initial": initial,
            "comma": comma, "listed": sum(w[1] for *_, w in row), "plain": sum(w[2] for *_, w in row),
            "order": roles[0] != "family" and roles[-1] != "given", "reverse": roles[0] != "given" and roles[-1] != "family",
        }
        if not initial and (f["given"] == 0 or f["family"] == 0):
            start, end = _guess(text, start, end, f, words)
        if f["n"] == 1 and not initial and f["family"]:
            tail = _TAIL.match(text[end : end + 8])
            if tail:
                end += len(tail[0].rstrip(" "))
                f["initial"] = f["comma"] = True
        spans.append((start, end, f))
        i = j + 1
    return spans


#: A name after a title, whatever its words. It begins with a letter, which is searched for fast, and only then looks back.
_TITLED = re.compile(
    r"(?:M(?<![\w-]M)(?:rs?\.?|s\.?|iss|me|lle|\.|adame|onsieur)|D(?<![\w-]D)(?:r\.?|oña|on)|P(?<![\w-]P)(?:rof\.?|rofessor)|H(?<![\w-]H)errn?|F(?<![\w-]F)rau|S(?<![\w-]S)(?:ra?\.|rta\.|eñora?)) ((?:[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?|[A-ZÀ-ÖØ-Þ]\.)(?: [A-ZÀ-ÖØ-Þ]\.)*(?: [A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?){1,2})(?![\w-])"
)


def titled_spans(text: str, taken: list[tuple[int, int, dict[str, float]]]) -> list[tuple[int, int, dict[str, float]]]:
    """Candidate names after a title, of words that need not be known; those that meet a candidate in ``taken`` are left out."""
    out = []
    for m in _TITLED.finditer(text):
        start, end = m.span(1)
        parts = m[1].split()
        words = [p for p in parts if not p.endswith(".")]
        if any(p.lower() in _COMPANY for p in words) or parts[0].rstrip(".").lower() in _TITLES or any(a < end and start < b for a, b, _ in taken):
            continue
        initial = len(words) < len(parts)
        out.append((start, end, {"n": len(words), "given": len(words) - 1, "family": 1, "initial": initial, "order": True, "guess": 2}))
    return out


_TAIL = re.compile(r",? (?:[A-ZÀ-Ý]\. ?){1,2}(?=\s|[,;:)<]|$)")
_BEFORE = re.compile(r"(?<![\w.@/-])([^\W\d_][\w'’-]+)[  ]+((?:[A-ZÀ-Ý]\. ?){0,2})$")
_AFTER = re.compile(r"^(,?)[  ]+((?:[A-ZÀ-Ý]\. ?){0,2})([A-ZÀ-Ý][\w'’-]+)")


def _guess(text: str, start: int, end: int, f: dict[str, float], words: Words) -> tuple[int, int]:
    """Takes in a neighbour that can be the missing given or family name: formed like one, or after a title or role."""
    role = "given" if f["given"] == 0 else "family"
    m = _BEFORE.search(text[max(0, start - 30) : start]) if role == "given" else None
    if m and m[1][0].isupper() and m[1].lower() not in _TITLES and m[1].lower() not in _COMPANY:
        at = start - len(m[0])
        ahead = text[max(0, at - 30) : at]
        cue = bool(_ROLE_CUE.search(ahead)) or bool(re.search(r"\b(?:Mrs?|Ms|Dr|Prof|Mme|Herr|Frau|Sra?)\.? $", ahead))
        if words.begun(m[1], role) or cue:
            f |= {"n": f["n"] + 1, "given": 1, "order": True, "guess": 1 + cue}
            return at, end
    m = _AFTER.match(text[end : end + 30])
    if m and m[3].lower() not in _COMPANY and (m[1] if role == "given" else words.begun(m[3], role)):
        cue = bool(_ROLE_CUE.search(text[max(0, start - 30) : start]))
        if words.begun(m[3], role) or (cue and role == "given"):
            f |= {"n": f["n"] + 1, role: 1, "comma": bool(m[1]), "guess": 1 + cue, "reverse" if role == "given" else "order": True}
            return start, end + len(m[0])
    return start, end


def _case(s: str) -> int:
    letters = [c for c in s if c.isalpha()]
    return 0 if all(c.islower() for c in letters) else 2 if all(c.isupper() for c in letters) else 1


FEATURES = (
    "kind", "start_plus", "digits", "start_zero", "start_paren", "separators", "groups", "first_group", "last_group", "letters", "cue", "after_cue", "other_cue", "not_cue",
    "shape", "at_sign", "file_end", "domain_parts", "company_next", "title_before", "role_cue", "amp", "n", "given", "family", "initial", "comma", "listed", "plain", "order",
    "reverse", "case", "in_address", "in_email", "number_before", "unit", "capital_next", "at_line_start", "guess",
)
_NANP = re.compile(r"^(?:\+?1[-. ])?\(?[2-9]\d\d\)?[-. ]\d{3}[-. ]\d{4}$|^\+1[2-9]\d{9}$|^\+1 \([2-9]\d\d\) \d{3}-\d{4}$")
_FRENCH = re.compile(r"^0\d(?:[ .-]?\d\d){4}$")
_ZERO = re.compile(r"^\(?0\d{2,4}\)?[ /-]\d[\d -]{4,9}$|^0\d{4}-\d{6}$|^0\d{3,4} ?\d{6,7}$")
_ABROAD = re.compile(r"^(?:\+|00)\d{1,3}[ (.-]*[\d()][\d ()./-]{6,14}$")
_SSN = re.compile(r"^\d{3}([- .]?)\d{2}\1\d{4}$")
_NIR = re.compile(r"^[12] ?\d{2} ?(?:0[1-9]|[1-9]\d) ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?$")
_ELEVEN = re.compile(r"^\d{2} ?\d{3} ?\d{3} ?\d{3}$")
_DATE = re.compile(r"^(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|^\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d\d$")
_IP = re.compile(r"^\d{1,3}(?:\.\d{1,3}){3}$")


def number_shape(s: str) -> int:
    """A coarse format of a number: 1-4 phones, 5-9 identity numbers, -1 dates, addresses of machines and versions, 0 others."""
    s = s.replace(" ", " ")
    if _DATE.match(s) or _IP.match(s):
        return -1
    for k, p in ((1, _NANP), (2, _FRENCH), (4, _ABROAD), (3, _ZERO), (5, _SSN), (6, _NIR), (7, _ELEVEN)):
        if p.match(s):
            return k
    return 8 if re.search(r"[A-Za-z]", s) else 0


def _at_marks(text: str) -> list[int]:
    """Where signs and words for @ stand, in order; of words whose contexts overlap the first."""
    out = [m.start() for m in _AT_BRACKET.finditer(text)]
    at = text.find("@")
    while at >= 0:
        out.append(at)
        at = text.find("@", at + 1)
    done = 0
    for begin, end in sorted((m.start() - 1, m.end(1)) for word, p in _AT_WORDS.items() if word in text for m in p.finditer(text)):
        if begin >= done and text[begin].isspace():
            out.append(begin)
            done = end
    return sorted(out)


def candidates(text: str, words: Words) -> list[tuple[str, int, int, dict[str, float]]]:
    """Overlapping candidates (kind, start, end, features)."""
    out: list[tuple[str, int, int, dict[str, float]]] = []
    emails: list[tuple[int, int]] = []
    for mark in _at_marks(text):
        if emails and emails[-1][1] > mark:
            continue
        begin = mark
        while begin and text[begin - 1].isspace():
            begin -= 1
        stop = begin
        while begin and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < stop and not text[begin].isalnum():
            begin += 1
        m = _EMAIL.match(text, begin) if begin < stop else None
        if m and m.end() > mark:
            s = m[0]
            plain = "@" in s
            domain = re.split(_AT, s, maxsplit=1)[-1]
            out.append(("email", m.start(), m.end(), {"at_sign": plain, "file_end": bool(_FILE_END.search(s)), "domain_parts": len(re.split(_DOT, domain)), "digits": sum(c.isdigit() for c in domain)}))
            emails.append(m.span())
    runs = [m.span() for m in _INTEGER.finditer(text)]
    for matches, lettered in ((_numbers(text, runs), False), (_lettered(text, runs), True)):
        for m in matches:
            s = m[0]
            if len(s) < 6:
                continue
            digits = sum(c.isdigit() for c in s)
            if digits < (5 if lettered else 7):
                continue
            before, after = text[max(0, m.start() - 48) : m.start()], text[m.end() : m.end() + 40]
            if "\n" in before:
                before = before.rpartition("\n")[2] if before.rpartition("\n")[2].strip() else before
            groups = [g for g in re.split(r"\D+", s) if g]
            base = {
                "start_plus": s[0] == "+", "digits": digits, "start_zero": s.lstrip("(").startswith("0"), "start_paren": s[0] == "(", "separators": len(set(s) & set(" -./()")), "groups": len(groups),
                "first_group": len(groups[0]), "last_group": len(groups[-1]), "letters": sum(c.isalpha() for c in s), "shape": number_shape(s), "not_cue": bool(_NOT_CUE.search(before)),
                "in_email": any(a <= m.start() < b for a, b in emails),
            }
            phone_cue, id_cue = bool(_PHONE_CUE.search(before)), bool(_ID_CUE.search(before))
            phone_after, id_after = bool(_PHONE_AFTER.search(after)), bool(_ID_AFTER.search(after))
            if not lettered:
                out.append(("phone", m.start(), m.end(), base | {"cue": phone_cue, "after_cue": phone_after, "other_cue": id_cue or id_after}))
            out.append(("id_number", m.start(), m.end(), base | {"cue": id_cue, "after_cue": id_after, "other_cue": phone_cue or phone_after}))
    places: list[tuple[int, int]] = []
    for start, end, unit in address_spans(text, runs):
        s = text[start:end]
        before, after = text[max(0, start - 40) : start], text[end : end + 24]
        nxt = _TOKEN.match(after.lstrip(" ")) if after[:1] == " " else None
        num = re.search(r"\d+", s)
        out.append(("address", start, end, {
            "unit": unit, "digits": len(num[0]) if num else 0, "company_next": bool(nxt and nxt[0].lower() in _COMPANY), "shape": 1 if s[:1].isdigit() else 2,
            "cue": bool(re.search(r"(?:address|adresse|direcci[óo]n|live[sd]? at|\bat|\bto|from|habite|reste au|wohnt|anschrift|vive en|samples|send|moved|visits?|domicilio|[:,])\s*$", before, re.I)),
            "not_cue": bool(re.search(r"(?:\bin|\bof|\bde|between|from|on|\bauf|von|sur)\s+$", before)) and not s[:1].isalpha(), "case": _case(re.sub(_STREET, "", s)),
        }))
        places.append((start, end))
    names = name_spans(text, words, emails)
    for start, end, f in names + titled_spans(text, names):
        if f["n"] < 2 and not f["initial"]:
            continue
        before, after = text[max(0, start - 30) : start], text[end : end + 24]
        nxt = _TOKEN.match(after.lstrip("  ")) if after[:1] in "  " else None
        last = re.search(r"([^\W\d_]+)\.?\s+$", before)
        f = f | {
            "company_next": bool(nxt and nxt[0].lower().rstrip("s") in _COMPANY or nxt and nxt[0].lower() in _COMPANY), "amp": bool(re.search(r"&\s*$", before) or re.match(r"\s*&", after)),
            "title_before": bool(last and last[1].lower() in _TITLES), "role_cue": bool(_ROLE_CUE.search(before)), "in_address": any(a < end and start < b for a, b in places),
            "in_email": any(a < end and start < b for a, b in emails) or before[-1:] in ("@", "/") or after[:1] in ("@", "_"), "case": _case(text[start:end]),
            "number_before": bool(re.search(r"\d[A-Za-z]?,?\s+(?:[NSEW]\.\s+)?(?:Old\s+)?$", before)), "capital_next": bool(nxt and nxt[0][0].isupper()),
            "at_line_start": not before.strip() or before.endswith("\n"), "file_end": bool(re.search(r"(?:\bthe|\ble|\bder|\bdie|\bdas|\bel|\bla|\bthis|\ba|\ban|\brue|\brue de|\brue du|\bavenue de|\bavenue du|\bimpasse du|\bimpasse de|calle)\s+$", before, re.I)),
        }
        out.append(("name", start, end, f))
    return out


def vector(kind: str, f: dict[str, float]) -> list[float]:
    get = f.get
    return [float(KINDS.index(kind)), *(float(get(x, 0)) for x in FEATURES[1:])]


class Trees:
    """Boosted regression trees; a node is [feature, threshold, left, right], a leaf a number. All rows go down a tree at once."""

    def __init__(self, base: float, trees: list, thresholds: dict[str, float]):
        self.base, self.thresholds = base, thresholds
        nodes: list[tuple[int, float, int, int, float]] = []

        def add(node) -> int:
            at = len(nodes)
            nodes.append((0, 0.0, at, at, float(node) if not isinstance(node, list) else 0.0))
            if isinstance(node, list):
                nodes[at] = (node[0], node[1], add(node[2]), add(node[3]), 0.0)
            return at

        def depth(node) -> int:
            return 1 + max(depth(node[2]), depth(node[3])) if isinstance(node, list) else 0

        self.roots = [(add(t), depth(t)) for t in trees]
        feature, threshold, left, right, value = zip(*nodes) if nodes else ((),) * 5
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (feature, left, right))
        self.threshold, self.value = np.array(threshold, np.float64), np.array(value, np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root, depth in self.roots:
            at = np.full(len(x), root)
            for _ in range(depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


@cache
def model() -> Trees:
    read = json.loads(MODEL.read_text())
    return Trees(read["base"], read["trees"], read["thresholds"])


def find_all(texts: list[str | None], words: Words, trees: Trees | None = None) -> list[list[tuple[str, int, int]]]:
    """Selected spans (kind, start, end) of each text in order, without overlap; the best-scored of overlapping ones is kept."""
    trees = trees or model()
    proposed = [candidates(x, words) if x else [] for x in texts]
    rows = [vector(kind, f) for own in proposed for kind, _, _, f in own]
    scores = iter(trees.scores(np.array(rows)).tolist() if rows else [])
    out = []
    for own in proposed:
        scored = []
        for kind, a, b, _ in own:
            s = next(scores) - trees.thresholds[kind]
            if s >= 0:
                scored.append((s, -(b - a), a, b, kind))
        taken: list[tuple[int, int, str]] = []
        for _, _, a, b, kind in sorted(scored, key=lambda t: (-t[0], t[1], t[2])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        out.append([(kind, a, b) for a, b, kind in sorted(taken)])
    return out


def find_personal(text: str | None, words: Words, trees: Trees | None = None) -> list[tuple[str, int, int]]:
    return find_all([text], words, trees)[0]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by a placeholder of its kind, like [EMAIL]."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


def _name_words(names: DataFrame) -> list[tuple[str, str]]:
    rows = names.select("name_word", "role").dropna().distinct().limit(MAX_NAME_WORDS + 1).collect()
    if len(rows) > MAX_NAME_WORDS:
        raise ValueError(f"more than {MAX_NAME_WORDS} name words")
    return [(r.name_word, r.role) for r in rows]


def personal_spans(docs: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, kind, start_pos, end_pos) of every piece of personal information; positions count code points from 0.

    Null and empty texts have none; repeated rows give repeated spans; null names are left out. Whole texts are read. ``names``:
    (name_word, role), at most MAX_NAME_WORDS rows.
    """
    rows = _name_words(names)

    @F.pandas_udf(_SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(rows)
        for batch in batches:
            yield pd.Series([[{"kind": k, "start_pos": a, "end_pos": b} for k, a, b in spans] for spans in find_all(batch.tolist(), words)])

    return docs.select(F.col(doc), F.inline(spans(F.col(text))))


def without_personal(docs: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """The documents with typed placeholders in ``text``; all columns are kept, null texts stay null."""
    rows = _name_words(names)

    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(rows)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(list(map(redact, texts, find_all(texts, words))), dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
