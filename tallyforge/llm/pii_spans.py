"""Candidate spans of personal details and the labelers that vote on them.

Candidates are found with high recall. Every labeler votes 1 (a detail), -1 (none) or 0 (can't say); none of them decides.
"""

from __future__ import annotations

import re

KINDS = ["email", "phone", "id_number", "address", "name"]

# Common given names, in Latin and in Cyrillic letters.
GIVEN = set("""
aaron adam ahmed aisha alan albert alex alexander alice amir amelia ana andrea andrei andrew angela anja anna anne anton antonio
arthur astrid barbara beatriz ben benjamin bernd birgit bjorn boris brian bruno carl carla carlos carmen caroline catherine
charles charlotte chloe christian christine clara claudia daniel david diana diego dmitri dmitry edward elena elif elizabeth
ella emil emily emma eric erik eva fatima felix fernando francesca frank gabriel george greta hannah hans heidi helen henrik
henry hugo ibrahim igor ingrid irina isabel ivan jack jacob james jan jane javier jean jessica joao johan john jonas jose
joseph juan julia karen karim karl katarina kate katya kevin klaus lara laura lena leo leon liam linda lisa louis lucas lucia
luis luka magda marco maria mariam marie mark marta martin mary matteo max maya mehmet mia michael miguel mila miriam mohammed
monika nadia natalia nina noah nora olga oliver omar oscar otto pablo patrick paul paula pedro peter petra philip pierre
rachel rafael ravi rebecca richard robert rosa ruth samuel sara selma simon sofia sophie stefan susan tomas thomas viktor
victoria wanda yusuf zoe
""".split())
GIVEN_CYRILLIC = set("""
александр алексей анастасия андрей анна антон артём борис вадим валентина варвара василий вера виктор виталий владимир
глеб григорий дарья денис дмитрий евгений екатерина елена иван игорь илья ирина кирилл константин ксения лариса лев лидия
людмила максим марина мария михаил надежда наталья никита николай олег ольга остап павел пётр полина роман светлана семён
сергей софия степан тамара татьяна тимур фёдор юлия юрий яна ярина ярослав
""".split())
# Words that start sentences or name things and are no family names.
NOT_FAMILY = set("""
a all also an and any approved are as ask at because before build but by can cannot clone closing commit confirmed could did do
does done each every file fixed for from has have he here hello hi how i if in is it its job just last let line looks main many
maybe measured menu merged my new no not now of on one only open or our panel phone please plugin power pushed quick ran re
release removed renamed reported rich rule same see send set settings she should since so some still sudo thanks that the
their then there they this those to trace two under until updated use version was we when where which who why will with works
would write you your bar clock deck dock drawer gauge lamp layout theme tray widget window button card dial meter pad radar
rail ring shelf strip tile mini plus badge board der die das ein eine el la los las le les un une o os as um uma bu en
""".split())
GREETINGS = {"hi", "hello", "dear", "hey", "thanks", "hallo", "hola", "bonjour", "привет", "уважением", "regards", "cheers"}

_AT = r"(?:@|＠|&#64;|\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?|(?-i: AT )(?=[\w-]+(?: DOT |\.))|(?-i: at )(?=[\w-]+ dot ))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?| DOT | dot )"
_EMAIL = re.compile(rf"(?<![\w.+%@-])[A-Za-z0-9][\w.+%-]*{_AT}(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,24}}(?![\w-])", re.A | re.I)
_EMAIL_HINT = re.compile(r"[@＠]|&#64;|\bat\b", re.I)
_EXT = r"(?:,?\s?(?:ext\.?|extension|доб\.?|x)\s?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+-])(?<!\d )(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ ./-]?(?:\(0?\d{1,5}\)[ ./-]?)?\d{1,8}(?:[ ./-]\d{2,8}){0,5}"
    r"|(?:1[ .-])?(?:\(\d{3}\)\s?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}"
    r"|8[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}"
    r"|\(?0[1-9]\d{0,4}\)?[ /-]\d{2,8}(?:[ -]\d{2,6}){0,4}"
    rf"){_EXT}(?![\w-])", re.I,
)
_ID = re.compile(
    r"(?<![\w.+-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]\d{2,3}[A-Z]\d{5,6}|\d{8}-?[A-Z]"
    r"|\d{3}([ -])\d{2}\1\d{4}|\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2} \d{3} \d{3} \d{3}|\d{2} \d{2} \d{6}|\d{4} \d{6}"
    r"|(?<=[Nn]umber )\d{8,12}|(?<=passport )\d{8,10}"
    r")(?![\w-]|[.:]\d)",
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Boulevard|Blvd|Court|Crescent|Terrace|Square|Place|Way|Row|Parkway|Highway)"
_CAP = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]*(?:['’-][^\W\d_]+)*"
_FIRST = r"(?:Port|Bad|Puerto|San|Santa|St\.?|Saint|New|Old|Upper|Lower|Great|Little|North|South|East|West|Fort|Mount|Lake|Los|Las|El|La|Le|Sankt|Villa)"
_TOWN = rf"(?:{_FIRST}\s)?{_CAP}(?:[ -](?:upon|on|am|an der|del|de la|de|sur|sous|les)[ -]{_CAP})?"
_POST = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{4,6})"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|#)\s?\d+[A-Za-z]?"
_ADDRESS = [
    re.compile(rf"(?<![\w.,/-])(?:{_FLAT}, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_STREET}\b\.?(?:, {_FLAT})?(?:, {_TOWN}(?:,? {_POST}(?!\w))?)?"),
    re.compile(
        rf"(?<![\w.,/-])(?:{_FLAT.lower().replace('flat', '[fF]lat')}, )?\d{{1,5}}[a-z]? (?:[a-z]+ ){{1,3}}{_STREET.lower()}\b\.?(?:, {_FLAT.lower()})?"
        rf", (?:{_FIRST.lower()}\s)?[^\W\d_]+(?:,? {_POST}(?!\w)|,? [a-z]{{1,2}}\d[a-z\d]? ?\d[a-z]{{2}}(?!\w))?"
    ),
    re.compile(rf"\b(?:(?:Am|Im|An der|An den|Auf der|Auf dem|Zum|Zur|Unter den) {_CAP}|{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|hof))\s\d{{1,4}}[a-z]?\b(?:, \d{{5}} {_TOWN})?"),
    re.compile(rf"\b(?:Calle|Plaza|Avenida|Avda\.|Paseo|Camino|Carrera|Rua|Travessa|C/) ?(?:(?:de la|de los|de las|del|de|da|do|das|dos) )?{_CAP}(?: {_CAP}){{0,3}},? (?:n\.?º ?)?\d{{1,4}}(?:, \d{{1,2}}\.?[ºª°](?: [A-Z]\b)?)?(?:, \d{{4,5}} {_TOWN})?"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_CAP}(?: {_CAP}){{0,2}}(?:, \d{{5}} {_TOWN})?"),
    re.compile(
        rf"(?<!\w)(?:\d{{6}}, )?(?:(?:г\. ?|город ){_CAP}, |{_CAP}, )?(?:ул\.|улица|проспект|просп\.|пр\.|переулок|пер\.|бульвар|площадь|шоссе) ?{_CAP}(?: {_CAP})?"
        rf", (?:д\. ?|дом )?\d{{1,4}}[а-я]?(?:, (?:корп\. ?|к\. ?)\d+)?(?:, (?:кв\. ?|квартира )\d+)?(?:, (?:г\. ?)?{_CAP}(?![\w@]))?"
    ),
]
_ADDRESS_HINT = re.compile(rf"\d (?:[\w'’-]+ ){{1,3}}{_STREET}\b|straße|strasse|weg |gasse|platz |allee|\bAm |\bIm |\bAn de|\bAuf de|Zum |Zur |Calle|Plaza|Avenida|Avda|Paseo|Camino|Rua |rue |avenue |place |ул\.|улица|просп|переул|бульвар|площадь", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

# Words that tell a detail of a kind, and words that tell something else, shortly before or after it.
CUES = {
    "email": r"mail|correo|reach|write|contact|support|signed|\bcc\b|почт|пишите|correo|erreichbar|maintainer|signing|address",
    "phone": r"phone|\btel\b|tel[.:=]|call|ring|sms|mobile|number is|fax|contact|reach|звон|телефон|teléfono|telefono|erreichbar|reported by|\d{1,2}\D{0,12}$",
    "id_number": r"passport|identity|\bid\b|ssn|social|tax|insurance|national|ausweis|steuer|паспорт|снилс|инн|dni|nif|identité|personal number|document|card",
    "address": r"address|lives|live|parcel|send|board|vivo|anschrift|wohn|адрес|domicil|reside|ship|\(c\)|home|office|visit",
    "name": r"author|signed|wrote|write to|spoke|ask|reported|copyright|\(c\)|maintainer|contact|here|approved|hi,|mailto|уважением|сообщает|\bid\b|regards|thanks|by|and",
}
ANTI = {
    "email": r"clone|git@|ssh|scp|prompt|remote|npm|dependency|package|://$|://\S*$",
    "phone": r"build|job|trace|run|version|release|measured|seconds|took|margin|padding|pixel|port|line|step|commit|hash|revision|issue|bytes|ms\b|worker",
    "id_number": r"build|job|trace|version|release|measured|microsecond|commit|hash|sha|revision|rule|runs?\b|theme|color|colour",
    "address": r"fork|theme|plugin|section|step|clock|line|layout|release",
    "name": r"theme|plugin|menu|widget|section|layout|fork|release|package|step",
}
_CUE = {k: re.compile(rf"(?:\b|(?<=_)|(?=\W))(?:{v})", re.I) for k, v in CUES.items()}
_ANTI = {k: re.compile(rf"(?:\b|(?<=_)|(?=\W))(?:{v})", re.I) for k, v in ANTI.items()}
_BOUND = re.compile(r"[.!?\n]\s")
LABELERS = ["cue", "anti", "shape", "gazetteer", "edges", "company", "common"]


# Small words inside family names.
_PARTICLE = r"(?:de|da|do|dos|del|della|di|du|la|le|van|von|der|den|ter|bin|al|el)"
_BETWEEN = re.compile(rf"(?:(?: [^\W\d_]\.)?(?: {_PARTICLE}){{0,2}} |, )$")
#: A given name with a family name has at most so many letters a word.
_LONGEST = 40


def _names(text: str) -> list[tuple[int, int]]:
    """Spans that could be a given name with a family name: two capitalised words, perhaps with an initial, small words or a comma between. Greetings are part of no name."""
    out: list[tuple[int, int]] = []
    before = None
    for m in _WORD.finditer(text):
        w = m[0]
        if w[0].isupper() and 1 < len(w) <= _LONGEST and w.lower() not in GREETINGS:
            if before is not None and _BETWEEN.match(text[before.end() : m.start()]):
                end = m.end() - 2 if w.endswith(("'s", "’s")) else m.end()
                out.append((before.start(), end))
            before = m
        elif before is not None and not (len(w) == 1 or re.fullmatch(_PARTICLE, w)):
            before = None
    return out


def _given(word: str) -> bool:
    return word in GIVEN or word in GIVEN_CYRILLIC or word.split("-")[0] in GIVEN


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span that could be a personal detail."""
    out = []
    if _EMAIL_HINT.search(text):
        out += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text)]
    if any(c.isdigit() for c in text):
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
        out += [("id_number", m.start(), m.end()) for m in _ID.finditer(text)]
        if _ADDRESS_HINT.search(text):
            out += [("address", m.start(), m.end()) for p in _ADDRESS for m in p.finditer(text)]
    out += [("name", *s) for s in _names(text)]
    return out


def votes(text: str, kind: str, start: int, end: int, found: list[tuple[str, int, int]]) -> list[int]:
    """The votes of LABELERS on one candidate: 1 for a detail, -1 against, 0 where a labeler can't say."""
    common = 0
    value = text[start:end]
    head, tail = text[max(0, start - 48) : start], text[end : end + 32]
    sentence = _BOUND.split(head)[-1]
    after = _BOUND.split(tail)[0]
    cue = 1 if _CUE[kind].search(sentence) or (kind in ("name", "email", "id_number") and _CUE[kind].search(after)) else 0
    anti = -1 if _ANTI[kind].search(sentence) or _ANTI[kind].search(after[:16]) else 0
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        shape = 1 if re.search(r"[A-Za-z]{2}", value) else 0
        gazetteer = -1 if re.match(r"(?:git|svn|hg|root|dev|user)(?:@|＠)", value, re.I) else (1 if _known_mailbox(value) else 0)
        edges = -1 if re.match(r":[\w~/]|/", tail) or head.endswith(("/", "@")) else 1
    elif kind == "phone":
        plain = value.isdigit()
        shape = 0 if plain else (1 if 9 <= digits <= 17 else -1)
        gazetteer = 1 if value.startswith(("+", "00", "(")) else 0
        edges = -1 if re.match(r"\s?(?:ms|px|seconds?|times|workers?|failed|bytes|%)", tail) or re.search(r"[#=/]\s?$", head) and not re.search(r"tel=$", head) else 1
    elif kind == "id_number":
        shape = 1 if re.search(r"[A-Z]", value) or " " in value or "-" in value else 0
        gazetteer = 1 if 6 <= digits <= 12 else -1
        edges = -1 if re.match(r"\s?(?:ms|px|seconds?|microseconds|times|workers?|failed|bytes|in (?:three|two) runs)", tail) else 1
    elif kind == "address":
        shape = 1 if "," in value else 0
        gazetteer = 1 if re.search(rf"{_POST}$", value) or re.search(r"(?:straße|strasse|улица|ул\.|calle|rue)", value, re.I) else 0
        edges = -1 if re.match(r" (?:clock|theme|plugin|fork|is the)", tail, re.I) else 1
    else:
        parts = [w.lower() for w in _WORD.findall(value)]
        first, last = _given(parts[0]), _given(parts[-1])
        starts = not head.strip() or head.rstrip(" ")[-1:] in ".!?\n:"
        turned = ", " in value
        shape = 1 if turned and last or first and ("." in value or "-" in value or not starts) else -1 if last and not turned and starts or turned and not last else 0
        gazetteer = 1 if first or last else 0
        common = -1 if any(p in NOT_FAMILY or p in GREETINGS for p in (parts[0], parts[-1])) or any(re.search(rf"\b{re.escape(p)}\b", text) for p in (parts[0], parts[-1])) else 0
        edges = -1 if re.match(r" (?:theme|plugin|menu|clock|widget|fork|bar)\b", tail, re.I) or head[-1:] in "/@." and head[-1:] else 1
    company = 1 if any(k != kind and (0 <= s - end <= 24 or 0 <= start - e <= 24) for k, s, e in found) else 0
    return [cue, anti, shape, gazetteer, edges, company, common]


def _known_mailbox(value: str) -> bool:
    return any(w in GIVEN for w in re.findall(r"[a-z]+", value.lower().split("@")[0])) or bool(re.search(r"[\d._+-]", re.split(r"@|＠|\s", value)[0]))


def features(text: str, kind: str, start: int, end: int, vote: list[int], size: int) -> list[int]:
    """Hashed features of a candidate: votes, the words around it and its shape. Slots are stable across processes."""
    head = _WORD.findall(text[max(0, start - 40) : start].lower())[-2:]
    tail = _WORD.findall(text[end : end + 32].lower())[:1]
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", text[start:end]))[:16]
    names = [f"v{i}{v}" for i, v in enumerate(vote)] + [f"h{i}{w}" for i, w in enumerate(reversed(head))] + [f"t{w}" for w in tail] + [f"s{shape}"]
    return [slot(f"{kind}|{n}", size) for n in names]


def slot(name: str, size: int) -> int:
    h = 2166136261
    for c in name.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % size
