"""Personal information in free text, found in spite of disguises.

A text passes small transducers, each of which keeps, for every character it emits, the
span of source characters it came from: width and homoglyph folding, spelled digits,
at/dot disguises.  Identifiers are recognised in the normalised text, most specific
first, each masking what it covers; their spans are mapped back, so that the source can
be rewritten with typed placeholders and is otherwise left untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.spread import spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "street_address": "<ADDRESS>", "person_name": "<NAME>"}

# -- transducers -----------------------------------------------------------------------

#: Letters of other scripts that look like a Latin one.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁɡһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν‐‑‒–−＿٠١٢٣٤٥٦٧٨٩",
        "ABEKMHOPCTYXaeopcyxijsdghlABEZHIKMNOPTYXoaiv-----_0123456789",
    )
)
_ZERO_WIDTH = dict.fromkeys("​‌‍⁠﻿­")

DIGIT_WORDS = {"zero": "0", "oh": "0", "nought": "0", "null": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_DIGIT_RUN = re.compile(r"\b(?:plus[ ,-]+)?(?:(?:double |triple )?(?:%s)\b[ -]*){5,}" % "|".join(DIGIT_WORDS), re.I)
_DIGIT_WORD = re.compile(r"\b(plus|double|triple|%s)\b" % "|".join(DIGIT_WORDS), re.I)
_AT = re.compile(r"\s*(?:\(\s*(?:at|@)\s*\)|\[\s*(?:at|@)\s*\]|\{\s*(?:at|@)\s*\}|<\s*at\s*>)\s*|(?<=[\w])\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)+)|(?<=[\w])\s+@\s+(?=[\w-]+\s*(?:\.|dot\b))|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]+(?:_dot_|\.)[A-Za-z])", re.I)
#: "jane at corp.example": a word that is no verb or noun of place, and a domain.
_AT_DOMAIN = re.compile(r"(?<![\w.@-])(?!(?:%s)\s)([\w.+-]*[A-Za-z][\w.+-]*)(\s+at\s+)(?=(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b(?![./]\w))" % "look|looking|looked|meet|me|us|it|them|him|her|you|is|are|was|were|be|been|am|site|page|shop|store|blog|docs|available|hosted|hosting|works|working|work|see|seen|found|find|stay|arrive|live|lives|and|or|not|only|here|there|up|out|down|read|online|buy|bought|sold|sell|listed|published|posted|register|registered|sign|login|log|click|visit|more|info|details|start|started|stop|point|points|pointed|server|host|website|forum|wiki|archive|account|order|ordered|download|downloads|free|now|today|again|up-to-date|service|sale", re.I)
#: Letters that are spaced out in front of an at sign.
_SPACED_AT = re.compile(r"(?<!\w)(?<!\b\w )((?:[A-Za-z0-9][ ]){2,40}[A-Za-z0-9])(?=[ ]?(?:@|[(\[{]\s*(?:at|@)))")
_DOT = re.compile(r"\s*(?:\(\s*(?:dot|\.)\s*\)|\[\s*(?:dot|\.)\s*\]|\{\s*(?:dot|\.)\s*\})\s*|(?<=[\w])\s+dot\s+(?=[\w-])|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])", re.I)

Spans = list[tuple[int, int]]


def _fold(text: str) -> tuple[str, Spans]:
    """Full-width, styled and look-alike characters become plain ones; invisible ones vanish."""
    out, spans = [], []
    for i, ch in enumerate(text):
        if ch in _ZERO_WIDTH:
            continue
        # accented letters stay: they belong to names and streets
        plain = HOMOGLYPHS.get(ch) or (ch if ch < "ɐ" else unicodedata.normalize("NFKC", ch))
        for c in plain:
            out.append(c)
            spans.append((i, i + 1))
    return "".join(out), spans


def _replace(text: str, spans: Spans, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, Spans]:
    """Apply edits (start, end, [(new text, from, to)]); from and to say which part each piece stands for."""
    out, new, at = [], [], 0
    for start, end, pieces in edits:
        out.append(text[at:start])
        new += spans[at:start]
        for piece, a, b in pieces:
            out.append(piece)
            new += [(spans[a][0], spans[b - 1][1])] * len(piece)
        at = end
    out.append(text[at:])
    return "".join(out), new + spans[at:]


def _digits(text: str, spans: Spans) -> tuple[str, Spans]:
    """Five or more spelled digits in a row become digits."""
    edits = []
    for m in _DIGIT_RUN.finditer(text):
        pieces, times = [], 1
        for w in _DIGIT_WORD.finditer(m[0]):
            word, a, b = w[0].lower(), m.start() + w.start(), m.start() + w.end()
            if word in ("double", "triple"):
                times = 2 if word == "double" else 3
                continue
            pieces.append(("+" if word == "plus" else DIGIT_WORDS[word] * times, a, b))
            times = 1
        end = pieces[-1][2]
        edits.append((m.start(), end, pieces))
    return _replace(text, spans, edits) if edits else (text, spans)


def _signs(text: str, spans: Spans, pattern: re.Pattern, sign: str) -> tuple[str, Spans]:
    edits = [(m.start(), m.end(), [(sign, m.start(), m.end())]) for m in pattern.finditer(text)]
    return _replace(text, spans, edits) if edits else (text, spans)


def _identity(text: str) -> Spans:
    return [(i, i + 1) for i in range(len(text))]


def normalise(text: str) -> tuple[str, Spans | None]:
    """Normalised text and, per character, its source span; None stands for the identity."""
    spans: Spans | None = None
    if not text.isascii():
        text, spans = _fold(text)
    # each transducer runs where its own pattern matches
    if _DIGIT_RUN.search(text):
        text, spans = _digits(text, spans or _identity(text))
    if ("@" in text or "at" in text) and _SPACED_AT.search(text):
        edits = [(m.start(), m.end(), [(text[i], i, i + 1) for i in range(m.start(), m.end(1), 2)]) for m in _SPACED_AT.finditer(text)]
        text, spans = _replace(text, spans or _identity(text), edits)
    if " at " in text and (hits := list(_AT_DOMAIN.finditer(text))):
        text, spans = _replace(text, spans or _identity(text), [(*m.span(2), [("@", *m.span(2))]) for m in hits])
    if _AT.search(text):
        text, spans = _signs(text, spans or _identity(text), _AT, "@")
    if "@" in text and _DOT.search(text):
        text, spans = _signs(text, spans or _identity(text), _DOT, ".")
    return text, spans


# -- identifiers -------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+'-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")

_PHONES = (
    re.compile(r"(?<![\w+.,])(?:\+|00)[ ]?[1-9]\d{0,2}[ ./-]{0,2}(?:\(\d{1,5}\)[ ./-]{0,2})?\d{1,8}(?:[ ./-]\d{1,8}){0,4}(?!\w)"),
    re.compile(r"(?<![\w.,/+-])\(?0\d{2,4}\)?[ ./-]{1,2}\d{2,8}(?:[ ./-]\d{2,4}){0,3}(?![\w]|[.,/-]\d)"),
    re.compile(r"(?<![\w.,/+-])0\d{9,11}(?![\w]|[.,/-]\d)"),
    re.compile(r"(?<![\w.,/+-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w]|[.,/-]\d)"),
)
_PHONE_WORD = re.compile(r"(?<![A-Za-z])(?:tel|phone|cell|mobile|whatsapp|call|ring|text|fax|fon)[a-z]{0,3}[ _.:=-]{0,3}(?:me on |me at |me |us on |us at |us |on |at |is |no\.? ?|number |nr\.? ?)?(\+?\d{9,13}(?!\d)|\d{7,8}(?!\w|[.,:/-]\d)|\d{3,4}[ ./-]\d{3,4}(?:[ ./-]\d{2,4})?(?!\w|[.,:/-]\d))", re.I)
_BARE = re.compile(r"(?<![\w.,:/-])\+?\d{7,13}(?!\w)")
#: Bank accounts are no kind; they are covered so that no part of one is taken for a phone number.
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")

_IDS = (
    re.compile(r"(?<!\w)[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?!\w)"),
    re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w-])(?:19|20)\d{6}-\d{4}(?![\w-])"),
    re.compile(r"(?<!\w)[A-Z]\d{8}(?!\w)"),
    re.compile(r"(?<!\w)[A-Za-z]\d{3} \d{3} \d{2}[A-Za-z](?!\w)"),
    re.compile(
        r"(?<!\w)(?:ssn|nin|social security|national insurance|national id|insurance|identity card|id card|identity|personal id|passport|personalausweis|reisepass|sozialversicherung\w*)(?: ?(?:no|nr|number|card|code|id))?\.?[ :#]{1,3}(?:is )?((?=[A-Za-z0-9 .-]{6,16})[A-Za-z]{0,3} ?\d[\dA-Za-z]*(?:[ .-]\d+[A-Za-z]?)*)",
        re.I,
    ),
)

_TYPES = "street|st|road|rd|lane|ln|row|court|ct|way|avenue|ave|terrace|close|drive|crescent|square|place|boulevard|blvd|gardens|walk|hill|mews|parade|quay"
_NUMBER = r"(?:\d{1,4} ?[a-f]?|(?:number|no\.?|nr\.?) (?:\d{1,4}[a-f]?|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen))"
_STOP = "the|a|an|am|pm|to|of|on|in|is|and|or|for|at|by|was|are|be|it|this|that|my|your|our|rows?|min|mb|ms|degrees|segments|minutes|points|please|has|have|from|with|took|then|half|main|we|i|you|no|any|each|all|back|late|out|down|up|than|so|as|but|not"
_STREETS_EN = (
    re.compile(rf"(?<![\w.:,/@#-])(?:(?:flat|apt|apartment|unit|suite) ?\d+[a-z]?, ?)?(?<![\w.:/@#-]){_NUMBER},? (?:(?!(?:{_STOP})\b)[^\W\d_][\w'’.-]*[ ]){{1,3}}(?:{_TYPES})\b\.?(?![\w'’])", re.I),
    re.compile(rf"(?<![\w'’])(?:[A-ZÄÖÜ][\w'’.-]*[ ]){{1,3}}(?:(?i:{_TYPES}))\b\.? \d{{1,4}}[a-f]?(?!\w|[.:,/-]\d)"),
    re.compile(r"(?<!\w)(?:rue|avenue|place|boulevard|chemin|impasse|via|calle) (?:[^\W\d_][\w'’-]*[ ]){0,4}\d{1,4}(?!\w)|(?<![\w.:,/-])\d{1,4},? (?:rue|avenue|boulevard|chemin|impasse) (?:de |du |des |la |le |les |l')*[^\W\d_]+", re.I),
)
_STREET_DE = re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|hang|ufer|damm|ring|steig|markt|berg|graben|wehr)\.? \d{1,4} ?[a-f]?(?!\w|[.:/-]\d)")
_STREET_POST = re.compile(r"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß.'-]*[ ]){1,4}\d{1,4}[a-f]?, (?:[A-Z]{1,2}-)?\d{5}(?= [A-ZÄÖÜ])")
_STREET_WORDS = frozenset(_TYPES.split("|")) | frozenset("rue chemin impasse via calle".split())

GIVEN = frozenset(
    "alice amara anna anton april arthur ben bill bob carl carlos charlotte chris clara daniel dario david dawn edith elena eliza ella emily emma erik ethan eva farid felix frank fritz gemma george grace greta hannah hans harry heidi helen henrik henry hope hugo ibrahim ida ingrid irene isaac ivan jack jacob james jane jean john jonas joseph joy julia karin kate kevin klara kurt lars laura leila leo leon liam linda lisa lucas lucia lucy mabel marco maren maria marie mark martin mary matteo max mia michael miles mohammed nadia nina noah noor nora olga oliver omar oscar otto owen pablo paul pavel peter petra philip priya rachel ramon robert rosa rose ruth sam samir samuel sara sarah simon sofia sophie stefan susan tariq theo thomas tobias tom ulrich ursula vera victor wanda will william yusuf zoe zofia".split()
)
#: Endings of family names; case does not matter.
_ENDING = re.compile(r"(?:(?:in|ov|ev|ow|ew)?sk[iya]|ovi[cć]|evi[cć]|i[cć]|[sz]son|sen|mann?|stein|berg|feld|bach|heim|hoff?|hauser|aker|acker|wick|wich|worth|ington|ham|ton|ley|moor|more|well|field|eby|by|strup|gaard|dahl|lund|quist|strom|tner|dner|tter|ette|etti|ardo|ullo|ello|elli|ini|ez|escu|enko|poulos|idis|yan|dze|oglu)$", re.I)
_LONG_ENDING = re.compile(r"(?:inski|owski|ovic|evic|esson|sson|mann|heim|aker|wick|moor|eby|strup|tner|ette|ardo|ullo|enko|escu|poulos)$", re.I)
SURNAMES = frozenset("smith jones taylor brown williams wilson johnson davies evans thomas roberts walker wright robinson thompson white hughes edwards green hall wood harris lewis martin jackson clarke turner hill scott cooper morris ward moore king watson baker harrison morgan patel allen anderson mitchell phillips lee campbell carter kelly garcia martinez lopez mueller müller schmidt schneider fischer weber meyer wagner becker schulz koch richter klein wolf neumann dubois moreau laurent rossi ferrari silva santos khan ahmed nguyen kim chen wang".split())
#: Ordinary words that look like family names.
_NOT_SURNAME = frozenset(
    "baker maker shaker speaker lesson partner cassette palette etiquette silhouette gazette roulette vignette candlewick wick mandolin better letter matter latter butter water later after never ever enter system item human woman german norman common london certain button cotton carton skeleton garden golden broken taken often listen monday tuesday wednesday thursday friday saturday sunday standby nearby hobby lobby baby ruby rugby passerby moor heath berg stein list then when seven eleven sixteen open screen green between been seen kitchen chicken children dozen heaven oven token given driven hidden sudden burden wooden linen raven haven therefore before more anymore furthermore well farewell shell spell smell small hill will still until kill ham exam team dream steam stream program telegram diagram tally valley alley volley barley family only really finally ally early barely daily badly likely".split()
)
_TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|professor|sir|dame|herr|frau|mme|mlle|monsieur|madame|señor|señora)"
_TITLED = re.compile(rf"(?<![\w'’]){_TITLE}\.? (?:(?:dr|prof)\.? )?(?:[A-Z]\.? )?([^\W\d_][\w'’-]+)", re.I)
_INITIALS = re.compile(r"(?<![\w'’.])(?:[A-Za-z]\. ?){1,2}([^\W\d_][\w'’]+(?:-[^\W\d_]+)?)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_AFTER_GIVEN = re.compile(r" (?:(?:[A-Za-z]\.|[A-Z]) )?((?:(?:van|von|de|der|den|del|di|da|le|la|mac|mc|o') ?){0,2}[^\W\d_][\w'’]*(?:-[^\W\d_]+)?)", re.I)
_BEFORE_GIVEN = re.compile(r"([^\W\d_][\w'’]*(?:-[^\W\d_]+)?), ?$")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _surname(word: str, strong: bool = False) -> bool:
    """Whether a word can be a family name; ``strong`` asks for more than a capital letter."""
    parts = word.split("-")
    if len(parts) > 1:
        return all(_surname(p, strong) for p in parts if p)
    low = word.lower().removesuffix("'s").removesuffix("’s")
    if len(low) < 3 or low in _NOT_SURNAME or low in GIVEN:
        return False
    if low in SURNAMES:
        return word[:1].isupper()
    if len(low) >= 6 and _LONG_ENDING.search(low):
        return True
    return not strong and len(low) >= 5 and word[:1].isupper() and bool(_ENDING.search(low))


def _names(text: str) -> list[tuple[int, int]]:
    found = []
    tokens = list(_TOKEN.finditer(text))
    for k, m in enumerate(tokens):
        low = m[0].lower()
        if low in GIVEN:
            after = _AFTER_GIVEN.match(text, m.end())
            if after and _surname(after[1].split(" ")[-1]):
                found.append((m.start(), after.end()))
                continue
            before = _BEFORE_GIVEN.search(text, max(0, m.start() - 40), m.start())
            if before and _surname(before[1], strong=True):
                found.append((before.start(), m.end()))
    if "." in text:
        for m in _INITIALS.finditer(text):
            if _surname(m[1]):
                found.append(m.span())
    for m in _TITLED.finditer(text):
        # "Ms. Old" may be a name, "12 ms. Old" and "MISS YOU" are not
        certain = m[0][0].isupper() and m[0][1:2].islower() and m[1][:1].isupper() and m[1].lower() not in _NOT_SURNAME
        if certain or _surname(m[1], strong=True):
            found.append(m.span())
    return found


#: What stands before or after a person, before a place, and in names that are no persons'.
_PERSON_BEFORE = frozenset("ask asked asking tell told met meet meeting call called phone ring email mailed mail cc thank thanks dear hi hello hey with and by from for of is was has does did to contact contacted named name name's colleague friend neighbour neighbor boss manager teacher doctor nurse lawyer author customer client patient brother sister cousin uncle aunt husband wife son daughter partner regards signed cheers saw know knows knew owe paid invited remind reminded please let says said that because where who".split())
_PERSON_AFTER = frozenset("said says say wrote writes will would is was has had can could should fixed asked called calls lives lived works worked told thinks thought knows knew wants wanted sent signed joined left moved married died born won bought sold owes needs likes broke brought brings came comes went and who whose about's".split())
_PLACE_BEFORE = frozenset("in at near around through towards visit visited across via outside inside behind".split())
_NO_PERSON = frozenset(
    "bakery brewery foundry mill mills works pharmacy clinic garage studio studios shop store stores library gallery cinema theater dairy farm farms logistics systems software solutions services partners holdings industries electronics motors foods books travel insurance energy media design sons brothers bros ltd gmbh inc corporation llc plc ag kg corp co company group bank club court hall house school university college hospital church station airport park bridge lake mount river street road lane avenue square tower museum theatre hotel inn bar cafe restaurant market centre center press news times journal institute association society union party council parliament ministry department office team league cup festival city town county valley island islands bay beach hill forest castle north south east west northern southern eastern western new old saint st port upper lower great little royal national united general central grand holy red green blue black white monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english german french spanish italian dutch polish internet windows linux python java spark chrome google"
    .split()
)
#: Words that begin a sentence with a capital and are no given names.
_STARTERS = frozenset(
    "i the a an and but or so if when while where what who whose which why how is are was were do does did can could will would shall should may might must have has had ask tell call ring text mail meet send ship give take bring see look watch read check thanks thank dear hi hello hey please sorry yes no not never always today tomorrow yesterday now then here there this that these those my your his her our their its it he she we you they in on at by for from with of to as about after before because since until half main new old good bad great nice happy last next first version page order error host serial isbn invoice loved lovely found lost anyone anybody someone nobody everyone somebody ok okay lol honestly listen oh well just only also still even maybe perhaps let say says".split()
)
_GERMAN = frozenset("der die das den dem ein eine und ist sind nicht ich du er sie wir ihr wer wo wann wie kann können hat haben mit von zu im am auf für bitte heute morgen le la les un une et est pas je tu il elle nous vous qui où avec pour dans sur".split())
_CAP_PAIR = re.compile(r"[^\W\d_][a-zß-ÿ'’-]+ (?:(?:van|von|de|der|den|del|di|da|dos|la|le|el|al|bin|ben) |[A-Z]\. ?)?[A-ZÀ-Þ][a-zß-ÿ]")
_PARTICLES = frozenset("van von de der den del di da dos la le el al bin ben".split())


def _capitalised(word: str) -> bool:
    return word[:1].isupper() and len(word) > 1 and any(c.islower() for c in word)


def _pairs(text: str) -> list[tuple[int, int]]:
    """Two to four capitalised words in a row that stand where a person's name stands; no list of names is needed."""
    tokens = list(_TOKEN.finditer(text))
    words = [t[0] for t in tokens]
    foreign = not _GERMAN.isdisjoint(words)  # every noun of such a text may be capitalised
    found, k = [], 0
    while k < len(tokens):
        if not _capitalised(words[k]):
            k += 1
            continue
        end = k
        while end + 1 < len(tokens) and text[tokens[end].end() : tokens[end + 1].start()] in (" ", ". ") and (_capitalised(words[end + 1]) or len(words[end + 1]) == 1 and words[end + 1].isupper() or words[end + 1] in _PARTICLES and end > k - 1):
            if text[tokens[end].end()] == "." and len(words[end]) > 1:
                break
            end += 1
        first, last = k, end
        k = end + 1
        while last > first and not _capitalised(words[last]):
            last -= 1
        before = text[max(0, tokens[first].start() - 2) : tokens[first].start()]
        starts = not before.strip() or before.strip()[-1:] in ".!?:…" or "\n" in before
        if starts and words[first].lower() in _STARTERS and words[first].lower() not in GIVEN:
            first += 1
            starts = False
        if not 1 <= last - first <= 3 or not _capitalised(words[first]):
            continue
        low = [w.lower() for w in words[first : last + 1]]
        prev = words[first - 1].lower() if first and text[tokens[first - 1].end() : tokens[first].start()] == " " else ""
        after = words[last + 1].lower() if last + 1 < len(tokens) and text[tokens[last].end() : tokens[last + 1].start()] in (" ", "'", "’") else ""
        if not _NO_PERSON.isdisjoint(low) or after in _NO_PERSON or low[-1] in _STREET_WORDS or any(w in _STOP_WORDS for w in low) or text[tokens[last].end() : tokens[last].end() + 2] in (" &", "@"):
            continue
        score = 1.0 if not foreign else 0.0
        score += 1.5 * (prev in _PERSON_BEFORE and not starts) + (after in _PERSON_AFTER or after == "s") - 2.0 * (prev in _PLACE_BEFORE)
        score += 2.0 * (low[0] in GIVEN) + 1.0 * (low[-1] in SURNAMES or bool(_ENDING.search(low[-1])))
        if score >= 2.0:
            found.append((tokens[first].start(), tokens[last].end()))
    return found


_STOP_WORDS = frozenset(_STOP.split("|"))
_NAME_WORDS = GIVEN | frozenset(_TITLE[3:-1].split("|"))
_INTERESTING = _NAME_WORDS | _STREET_WORDS


def _is_account(text: str) -> bool:
    """Whether the check digits of an international account number hold."""
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every identifier, in source offsets and order, not overlapping."""
    norm, spans = normalise(text)
    found: list[tuple[str, int, int]] = []

    def take(kind: str, ranges: list[tuple[int, int]]) -> None:
        nonlocal norm
        for a, b in ranges:
            if "\0" not in norm[a:b]:
                found.append((kind, a, b))
                norm = norm[:a] + "\0" * (b - a) + norm[b:]

    if "@" in norm:
        take("email", [m.span() for m in _EMAIL.finditer(norm)])
    digits = sum(map(norm.count, "0123456789"))
    if digits >= 12:
        for m in _ACCOUNT.finditer(norm):
            if _is_account(m[0]):
                norm = norm[: m.start()] + "\0" * len(m[0]) + norm[m.end() :]
    if digits >= 7:
        for p in _PHONES:
            take("phone", [m.span() for m in p.finditer(norm) if 8 <= sum(map(str.isdigit, m[0])) <= 15])
        take("phone", [m.span(1) for m in _PHONE_WORD.finditer(norm) if sum(map(str.isdigit, m[1])) >= 7])
    if digits >= 6:
        for p in _IDS:
            take("id_number", [m.span() for m in p.finditer(norm) if sum(map(str.isdigit, m[0])) >= 6])
    words = _TOKEN.findall(norm.lower())
    known = _INTERESTING.intersection(words)
    if digits or "number" in words or "no" in words:
        if not known.isdisjoint(_STREET_WORDS):
            for p in _STREETS_EN:
                take("street_address", [m.span() for m in p.finditer(norm)])
        if digits:
            take("street_address", [m.span() for m in _STREET_DE.finditer(norm)])
            take("street_address", [m.span() for m in _STREET_POST.finditer(norm)])
    if not known.isdisjoint(_NAME_WORDS) or "." in norm and _INITIALS.search(norm):
        take("person_name", _names(norm))
    if _CAP_PAIR.search(norm):
        take("person_name", _pairs(norm))
    if spans is not None:
        # seven digits or more, spelled out in a row, and no other kind of number
        take("phone", [m.span() for m in _BARE.finditer(norm) if text[spans[m.start()][0]].isalpha() and text[spans[m.end() - 1][0]].isalpha()])
    found.sort(key=lambda f: f[1])
    if spans is not None:
        found = [(k, spans[a][0], spans[b - 1][1]) for k, a, b in found]
    return found


@lru_cache(1 << 16)
def detect_handle(handle: str) -> tuple[tuple[str, int, int], ...]:
    """As :func:`detect`, for user names: words are also parted by case, dots, dashes and underscores."""
    found = detect(handle)
    if not found or all(k not in ("email", "person_name") for k, _, _ in found):
        parts = [m for m in _CAMEL.finditer(handle)] if handle.isascii() else list(_TOKEN.finditer(handle))
        for a, b in zip(parts, parts[1:]):
            if b.start() - a.end() > 1:
                continue
            x, y = a[0].lower(), b[0].lower()
            if x in GIVEN and _surname(b[0], strong=True) or y in GIVEN and x not in GIVEN and _surname(a[0], strong=True):
                found.append(("person_name", a.start(), b.end()))
                break
    return tuple(found)


def redact_text(text: str | None, handle: bool = False) -> str | None:
    """The text with a typed placeholder for each identifier; all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(detect_handle(text) if handle else detect(text), key=lambda f: f[1]):
        if a < at:
            continue
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]]) if at else text


# -- Spark ---------------------------------------------------------------------------------


def _find(fields: dict[str, bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("field", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            ids, rows = b.column(0), []
            for c, (field, handle) in enumerate(fields.items()):
                find = detect_handle if handle else detect
                for i, text in enumerate(b.column(c + 1).to_pylist()):
                    if text:
                        rows += [(i, field, *f) for f in find(text)]
            if rows:
                i, f, k, s, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(f), pa.array(k), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema=schema)

    return run


def findings(messages: DataFrame, id_col: str, texts: tuple[str, ...], handles: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, kind, start, end): identifiers in the given columns, offsets in characters.

    Rows without id are left out; NULL or empty texts hold nothing; a message delivered
    again counts once.  Other columns are ignored.
    """
    fields = {**dict.fromkeys(texts, False), **dict.fromkeys(handles, True)}
    src = messages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), *fields)
    return spread(src).mapInArrow(_find(fields), "id string, field string, kind string, start int, end int").distinct()


def redacted(text: Column, handle: bool = False) -> Column:
    """Column of texts with placeholders."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([redact_text(t, handle) for t in s], dtype=object)

    return F.pandas_udf(run, "string")(text)
