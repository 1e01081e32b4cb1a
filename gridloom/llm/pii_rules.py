"""Forms of personal information: the exact check after the tagger, and the labeller of its training windows.

All patterns run over folded text (one code point for each of the original, see crf_tagger.fold_text).
"""

from __future__ import annotations

import regex as re

from .crf_tagger import KINDS

# Words of addresses, labels of numbers issued to persons, and the domains' last labels.
STREET_EN = r"(?:Street|Str|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Terrace|Ter|Close|Court|Ct|Drive|Dr|Way|Place|Pl|Square|Crescent|Cres|Grove|Hill|Mews|Parade|Walk|Gardens|Gate|Yard|Boulevard|Blvd|Quay|Wharf|Parkway|Pkwy|Highway|Hwy|Alley|Path|Rise|Green|Bank|View)"
STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|markt|hof|berg|chaussee|pfad|zeile|promenade)"
STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|quai|chemin|place|pl\.|impasse|all[eé]e|route|cours|passage|square|ruelle|faubourg|sentier|voie)"
STREET_ES = r"(?:calle|c/|c\.|avenida|avda?\.?|av\.|plaza|pza\.?|paseo|p\.º|camino|carretera|ronda|traves[ií]a|callej[oó]n|glorieta|cuesta|rambla|v[ií]a)"
ID_LABEL = (
    r"(?:ssn|social\s+security(?:\s+(?:number|no\.?))?|soc\.?\s*sec\.?(?:\s*no\.?)?|national\s+insurance(?:\s+(?:number|no\.?))?|ni\s*(?:number|no\.?)|nino|"
    r"tax(?:payer)?\s*(?:id|identification|file|form|return|reference)(?:\s*(?:number|no\.?))?(?:\s+(?:lists|says|shows|gives))?|tin|steuer[- ]?(?:id(?:[- ]?nr)?|nr|nummer|identifikationsnummer)\.?|sozialversicherungs(?:nummer|[- ]?nr\.?)|"
    r"passport(?:\s*(?:number|no\.?|nr\.?|#))?|(?:reise)?pass(?:nummer|[- ]?nr\.?)|passeport(?:\s*n[°oº]\.?)?|pasaporte(?:\s*n[°oº.ú]\w*\.?)?|reisepass|"
    r"dni(?:\s*/\s*nif)?|nif|nie|(?:personal)?ausweis(?:nummer|[- ]?nr\.?)?|identity\s+card(?:\s*(?:number|no\.?))?|id\s+card(?:\s*(?:number|no\.?))?|carte\s+d.identit[eé]|"
    r"(?:driv(?:ing|er'?s?)\s+)?licen[cs]e(?:\s*(?:number|no\.?|nr\.?|#))?|f[uü]hrerschein(?:nummer|[- ]?nr\.?)?|permis\s+de\s+conduire|s[eé]cu(?:rit[eé]\s+sociale)?|insee|nir|num[eé]ro\s+fiscal)"
)
ID_NUMBER = (
    r"(?:\d{3}[- .]?\d{2}[- .]?\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|\d{2}\s?\d{3}\s?\d{3}\s?\d{3}|[XYZ]?-?\d{7,8}-?[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{9,13}|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?|[A-Z0-9]{9,12})"
)
PARTICLE = r"(?:van\s+der|van\s+den|van\s+de|van|von\s+der|von|de\s+la|de\s+los|de\s+las|de|del|della|di|da|dos|du|al|el|bin|ibn|ten|ter|zu|la|le|st\.)"

_B, _S = r"(?<![\w])", r"[ \t]"
_WORD = r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)*"
_TITLED = r"(?:\p{Lu}[\p{L}\p{M}'’]+)"

EMAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*(?:@|[ ]@[ ]|[ ]?&#64;[ ]?|\s?[\(\[\{<]\s?(?:at|@)\s?[\)\]\}>]\s?)(?:[\w-]+(?:\.(?=[\w-]+)|\s?[\(\[\{]\s?(?:dot|\.)\s?[\)\]\}]\s?|\s+dot\s+))+[A-Za-z]{2,}(?![\w@])"
    r"|(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*\s+(?:at|AT|At)\s+[\w-]+(?:(?:\s+dot\s+|\s+DOT\s+|\s?[\(\[]dot[\)\]]\s?)[\w-]+)+",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.,/-]|\d[ ]?[-/.:]?[ ]?|[+(])(?:"
    r"(?:\+\s?1[-. ]?|1[-. ])?(?:\(\d{3}\)[-. ]?|\d{3}[-. ])\d{3}[-. ]\d{4}|(?:\+?1)?\d{3}555\d{4}|\(\d{3}\)\s?\d{7}|\+1\d{10}"
    r"|(?:\+44|0044)[ -]?(?:\(0\)[ -]?)?\d{2,5}[ -]?\d{3,4}[ -]?\d{3,4}|0(?:20[ -]?\d{4}[ -]?\d{4}|7\d{3}[ -]?\d{3}[ -]?\d{3}|1\d{3}[ -]?\d{6}|1\d{2}[ -]\d{3}[ -]\d{4})"
    r"|(?:\+49|0049)[ -]?(?:\(0\)[ -]?)?\d{2,4}[ /-]?\d{3,8}(?:[ -]?\d{1,5})?|\(0\d{2,4}\)[ -]?\d{3,8}(?:[ -]?\d{1,5})?|0\d{2,4}[/ ]\d{4,8}(?:[- ]\d{1,4})?"
    r"|(?:\+33|0033)[ .-]?(?:\(0\)[ .]?)?[1-9](?:[ .-]?\d{2}){4}|0[1-9](?:[ .-]?\d{2}){4}"
    r"|(?:\+34|0034)[ -]?\d{3}(?:[ -]?\d{2,3}){2,3}|[6789]\d{2}[ ]\d{3}[ ]\d{3}|[89]\d{2}(?:[ ]\d{2}){3}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){2,4}"
    r")(?![\w]|[-/:]\d|\.\d)"
)
ID = re.compile(rf"(?<![\p{{L}}\d_]){ID_LABEL}\s*(?:[:#=.]|is|n[°oº]\.?|no\.?)?\s*({ID_NUMBER})(?![\w])", re.I)
#: A number in brackets right behind a word in capitals, as after a person's name, without a label.
ID_BARE = re.compile(r"(?<=(?:\p{Lu}[\p{L}\p{M}'’-]+|\p{Lu}{3,}|\p{L}{4,})\s\()(\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{2}\s\d{3}\s\d{3}\s\d{3}|[XYZ]?\d{7,8}-?[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2}\d{7})(?=\))", re.I)
ADDRESS = re.compile(
    rf"(?<![\w#/.,-])\d{{1,5}}{_S}?[A-Za-z]?(?:{_S}?[-/]{_S}?\d{{1,5}}[A-Za-z]?)?,?{_S}+(?:(?!(?:was|of|and|the|in|on|for|to|is|at|bars?)\b){_WORD}{_S}+){{1,3}}?{STREET_EN}\b\.?(?!{_S}+(?:was|mix|waltz|blues|and{_S}+\d)\b)"
    rf"|(?<![\w#/.,-])\d{{1,5}}(?:{_S}?(?:bis|ter|quater|[A-Da-d])\b)?,?{_S}+{STREET_FR}{_S}+(?:(?:du|de|des|de{_S}+la|de{_S}+l'|d'|l'){_S}*)*{_WORD}(?:[- ]{_TITLED})?"
    rf"|(?<![\w])(?:{STREET_ES}{_S}*(?:(?:de|del|de{_S}+la|de{_S}+los|de{_S}+las){_S}+)*{_TITLED}(?:{_S}+(?:(?:de|del|la){_S}+)?{_TITLED}){{0,3}},?{_S}+(?:n[º°o.]\.?{_S}*)?\d{{1,4}}[A-Za-z]?)\b"
    rf"|(?<![\w])(?:(?:(?:Alte[rns]?|Neue[rns]?|Gro(?:ß|ss)e[rns]?|Kleine[rns]?|Obere[rns]?|Untere[rns]?|Lange|Hohe){_S}+)?[\p{{L}}-]*{STREET_DE}|(?:Am|An{_S}+der|Im|In{_S}+der|Auf{_S}+dem|Zum|Zur|Unter{_S}+den){_S}+{_TITLED}){_S}+\d{{1,4}}{_S}?[A-Za-z]?(?![\w.:]\d|\w|{_S}*(?:bpm|Hz|dB|cents|Schl|Takt))",
    re.I,
)
_PART = r"(?:\p{L}[\p{L}\p{M}'’]+(?:-\p{L}[\p{L}\p{M}'’]+)*)"
_I = r"\p{L}\."
NAME = re.compile(
    rf"(?<![\p{{L}}\p{{M}}\d_@.+-])(?:{_PART},\s+(?:{_PART}|{_I})(?:\s+{_I})?|(?:{_PART}|{_I})(?:\s+{_I}){{0,2}}\s+(?:{PARTICLE}\s+)?{_PART})(?![\p{{L}}\p{{M}}\d_@])",
    re.I,
)
# Titles, and small words that join a name with what stands beside it.
TITLES = set("mr mrs ms miss mx dr prof professor sir madam herr frau fräulein fraulein monsieur madame mademoiselle mme mlle sr sra srta señor señora senor senora don doña dona".split())
JOINING = set("and with by for from to the a an of at in on who was is ask cc contact attn dear hi hello thanks about before und mit von bei der die das et avec par de le la chez y con por para el".split())
#: Words that open a sentence before a comma, and are then no family name before a given one.
OPENERS = set("also still again then now here there however moreover besides yes no well so but and or today tomorrow yesterday otherwise instead meanwhile please sorry".split())
_PHONE_NOT = re.compile(r"(?:serial|catalogue|cat\.|batch|order|invoice|ticket|matrix|ref|take|seed|preset|codes?|lengths?|checksums?|no\.|number\s+of|catalog|isrc|session|dBFS)[\s:#.=-]*(?:no\.?|number|nr\.?)?[\s:#=-]*$", re.I)
PATTERNS = {"email": EMAIL, "phone": PHONE, "id_number": ID, "address": ADDRESS}
#: Signs without which a form cannot match, looked for in small letters: a sign or word for "at"; six digits close together or a code with
#: a digit; a house number with a word for streets, or such a word with a number.
_EN_WORDS = STREET_EN[3:-1].lower()
_SIGNS = {
    "email": [r"@|&#64;|[(\[{<]\s?at\s?[)\]}>]|\sat\s+[\w-]+(?:\s+dot\s|\s?[(\[]dot)"],
    "id_number": [r"\d(?:[ .-]{0,2}\d){5,}|\b(?=[a-z]*\d)[a-z0-9]{9,12}\b"],
    "address": [
        rf"(?<![\w#/.,-])\d{{1,5}}[ \t]?[a-z]?(?:[ \t]?[-/][ \t]?\d{{1,5}}[a-z]?)?,?[ \t]+(?:[^\W\d_][\w'’]*[ \t]+){{1,3}}?(?:{_EN_WORDS})\b",
        rf"(?<![\w#/.,-])\d{{1,5}}(?:[ \t]?(?:bis|ter|quater|[a-d])\b)?,?[ \t]+{STREET_FR}",
        rf"\b{STREET_ES}[^\n]{{1,90}}?\d",
        rf"{STREET_DE}[ \t]+\d",
        r"\b(?:am|an[ \t]+der|im|in[ \t]+der|auf[ \t]+dem|zum|zur|unter[ \t]+den)[ \t]+[\w'’]+[ \t]+\d",
    ],
}
_SIGNS = {kind: [re.compile(p) for p in ps] for kind, ps in _SIGNS.items()}
#: Characters around a sign in which its form lies.
_SIGN_REACH = {"email": (72, 72), "id_number": (72, 24), "address": (64, 24)}


def lowered(text: str) -> str:
    """In small letters, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def matches(kind: str, text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """Spans of a kind's form in text[lo:hi]; names are not found this way."""
    hi = len(text) if hi is None else min(hi, len(text))
    group = 1 if kind == "id_number" else 0
    out = []
    found = [*PATTERNS[kind].finditer(text, lo, hi), *(ID_BARE.finditer(text, lo, hi) if kind == "id_number" else ())]
    for m in found:
        start, end = m.span(group)
        if kind == "id_number" and not any(c.isdigit() for c in text[start:end]):
            continue
        if kind == "phone":
            if _PHONE_NOT.search(text[max(0, start - 24) : start]) or not 7 <= sum(c.isdigit() for c in text[start:end]) <= 15:
                continue
            if re.search(ID_LABEL + r"[\s:#=.]*$", text[max(0, start - 48) : start], re.I):
                continue
        out.append((start, end))
    return out


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def forms(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the forms of all kinds but names in a whole text, tried around their signs."""
    out = [(KINDS.index("phone"), a, b) for a, b in matches("phone", text)]
    low = lowered(text)
    for kind, signs in _SIGNS.items():
        before, after = _SIGN_REACH[kind]
        near = sorted((max(0, m.start() - before), m.end() + after) for sign in signs for m in sign.finditer(low))
        for a, b in joined(near):
            # not from within a word, nor to the middle of one
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            out += [(KINDS.index(kind), x, y) for x, y in matches(kind, text, a, b)]
    return out


class Lexicon:
    """Known parts of names, folded to lower case. Bounded by the table, whose size the caller checks."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family

    def role(self, part: str) -> str:
        words = re.split(r"[\s-]+", part.lower())
        g, f = any(w in self.given for w in words), any(w in self.family for w in words)
        return "b" if g and f else "g" if g else "f" if f else ""


def split_name(span: str) -> tuple[str, str] | None:
    """Given part (or initial) and family part of a span in either order, or None if it has not that form."""
    if not NAME.fullmatch(span):
        return None
    if "," in span:
        family, _, given = span.partition(",")
        return given.strip(), family.strip()
    given, _, rest = re.sub(r"\s+", " ", span).partition(" ")
    return given, re.sub(rf"^(?:{_I}\s+)*(?:{PARTICLE}\s+)?", "", rest, flags=re.I)
