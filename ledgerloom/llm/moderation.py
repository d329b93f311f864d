"""Abusive, hateful and sexually explicit messages.

Words are first freed of disguises (look-alike digits and signs, masked, spaced, dotted or
drawn-out letters).  Each sentence then yields sparse features: its words, pieces of words
and pairs of words, whatever they are; classes of known words and phrases; and conjunctions
of classes, such as an insult next to an address.  One
cumulative-link ordinal regression per kind, its weights shared by all thresholds,
predicts a severity grade: 0 none, 1 present, 2 severe.  The score of a message is the
highest expected severity of its sentences; a message has a kind if grade 1 or more is
the likelier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import exp
from operator import or_
from re import _constants, _parser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.moderation_seeds import write_out
from ledgerloom.llm.ordinal import UNKNOWN, CumulativeLink
from ledgerloom.sources.spread import spread

KINDS = ("abuse", "hate", "sexual")
N_GRADES = 3
#: Greatest number of labelled messages used for fitting, in order of their ids.
MAX_SAMPLE = 50_000


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# -- lexicon ---------------------------------------------------------------------------

INSULT_NOUNS = _set(
    "kys stfu gtfo jackass jackasses simpleton muppet tosser git airhead fraud scumbags creeps cowards fools idiot idiots moron morons imbecile imbeciles cretin cretins bastard bastards asshole assholes arsehole bitch bitches loser losers scumbag scumbags clown clowns jerk dumbass dickhead prick twat wanker retard cunt slut whore coward halfwit dimwit nitwit twit numbskull fool dunce creep weirdo lowlife swine scum failure arschloch depp trottel dummkopf wichser hurensohn schlampe missgeburt vollidiot imbécile connard connasse salope abruti crétin enculé débile dégénéré"
)
INSULT_ADJECTIVES = _set("pathetic useless stupid dumb worthless spineless brainless filthy lying two-faced fat ugly miserable unwanted disgusting braindead ignorant clueless toothless gutless hideous revolting blöd dumm nutzlos stupide nul")
YOU = _set("you your yours yourself u ur ya youre you're du dich dir dein deine tu te toi ton ta t'es")
HARM = _set("kill slit gut skin poison choking stomp smack kys smash break burn cut stab shoot beat beaten hurt bleed strangle hang punch slap choke crush drown murder destroy bury rape ground coffin dead die regret suffer")
GROUPS = _set(
    "foreigners foreigner poles turks russians albanians romanians indians pakistanis sikhs buddhists catholics protestants syrians somalis nigerians ukrainians hungarians serbs kurds latinos hispanics atheists homeless beggars gay lesbian trans queers jew muslim black immigrants immigrant migrants migrant refugees refugee newcomers women girls gays lesbians homosexuals transgender jews muslims christians hindus blacks whites asians arabs africans mexicans gypsies roma cripples cripple disabled believers folk clans tribes natives people pensioners elderly ausländer flüchtlinge frauen juden muslime étrangers immigrés femmes"
)
DEHUMANISING = _set("vermin filth animals animal leeches leech parasites parasite plague rats cockroaches roaches subhuman subhumans trash garbage savages beasts cancer monkeys apes lice thieves criminals rapists terrorists invaders murderers inferior exterminated eliminated disease infestation pigs dogs dirt scum maggots pest breed")
SEXUAL = _set(
    "horny nude nudes naked porn porno xxx sex sexy orgy orgies condoms condom tits tit boobs pussy cock dick penis vagina blowjob handjob fuck fucking fucked cum jerk jerked wank lick masturbate masturbating strip stripping spread wet hard moan suck sucking escort onlyfans uncensored bare topless erotic kinky threesome milf anal nipples cunt bend lust undress cam ass arse butt hole clit thighs breasts fap hump slutty aroused fuckable masturbates cums topless threesome"
)
THINGS = _set(
    "cache build router server parser segment queue index printer backup deploy compaction lock laptop page code pointers docs terminal script test tests machine computer phone bug database query log logs disk mistake idea question weather bus train palette colour color cast form process parent child dir cellar feeder mistake soundtrack money hike film book podcast match concert puzzle"
)
REPORTING = _set("called reported report removed moderators moderator word words said says quote quoted docs list reads wiki screening post posts swore training policy")
SELF = _set("i i'm im me my mine myself")

PHRASES: dict[str, re.Pattern] = {
    k: re.compile(v)
    for k, v in {
        "threat": r"\b(?:i|we|someone|somebody|they) (?:will|'ll|would|am going to|are going to|gonna|should) (?:\w+ ){0,3}(?:kill|smash|break|burn|cut|stab|shoot|beat|hurt|strangle|punch|crush|bury|destroy|make you|put you|find you|get you|end you)\b|watch your back|what happens to you|know where you (?:sit|live|sleep|work)|(?:kill|hang|shoot|hurt) yourself|jump off|jump from|(?:deserve|ought) to be (?:beaten|hurt|shot|killed|hit|slapped)|you(?:'re| are) (?:dead|next)\b|(?:break|smash|cut|burn) (?:your|you) ?(?:legs|face|neck|bones|teeth|house|shed|car|open|fingers|arms)?|bring dich um|crève",
        "dismiss": r"\bget lost\b|\bshut (?:the \w+ )?up\b|\bgo cry\b|\bcrawl back\b|delete your account|(?:nobody|no one|noone) (?:here |really )?(?:likes|loves|wants|would miss|cares about|asked) you|learn to (?:read|write|think)|halt (?:die|deine|dein) (?:klappe|fresse|maul)|\bdégage\b|ferme(?:-| )la|ta gueule|verpiss dich|fuck (?:you|off)|screw you|piss off|go to hell|drop dead|that's all you are|get out of (?:here|my sight)|\bf off\b",
        "demean": r"ashamed of (?:raising|having|you)|(?:my|the|a) (?:dog|cat|grandma|toddler|kid) (?:\w+s|could|can|would)\b|waste of (?:space|air|oxygen|skin)|you (?:are|'re) (?:nothing|a joke|an embarrassment|such a)|you (?:write|code|think|sound|look|smell|talk) like an?\b|what an? (?:\w+ ){0,2}(?:you are)|only an? (?:\w+ ){0,2}would",
        "your_person": r"\b(?:you|your|hey)\b",
        "exclude": r"(?:throw|kick|drive|force|push|get|keep|want) (?:\w+ ){1,4}out\b|\bout,? by force|\bsend (?:\w+ ){1,4}(?:back|home)\b|lock (?:them|\w+) up|(?:should|must) (?:not|never) be (?:let|allowed|permitted|given)|(?:do not|don't) (?:deserve|belong)|never be allowed|(?:no|any) (?:decent )?(?:\w+ )?(?:lets|let|allows) (?:\w+ ){1,4}in\b|rents? to\b|go back to|not welcome|deport|keep (?:\w+ ){1,4}out of|\braus\b|dehors",
        "exterminate": r"let them (?:die|starve|drown|rot)|leave in a coffin|burn (?:down )?(?:the|their) (?:temples?|churches|mosques|synagogues|houses|homes)|wipe (?:them|\w+ \w+) out|round them up|gas (?:them|the)|(?:only|one) good (?:thing|\w+) about|are a burden|get rid of (?:them|the|those|these|all)\b|shoot them|hang them",
        "essence": r"in their (?:blood|nature|genes)|blood tells|never trust|can't (?:code|think|drive|lead|count|read)|belong in the|breed like|nothing but|all of them|was (?:clean|safe|nice|quiet) before|are all (?:the same|thieves|criminals|liars)|,? obviously\b|^typical,|another (?:theft|robbery|break-in|fight|fire|murder)",
        "solicit": r"\bdm (?:me|after|for|now)|\bdm\b|link in bio|come (?:over|to my (?:room|place|bed))|no signup|on cam\b|send (?:me )?(?:\w+ )?(?:nudes|pics|photos)|show me (?:your|more)|hot (?:pics|singles|girls|guys|teens)|private (?:\w+ )?(?:videos|pics)|in my bed|for you\b|profile pic|near (?:me|you|[a-z]+)$|\bwanna\b|\bwant to\b|all night|looking for|bring condoms|anyone\b",
        "act": r"\bbend over\b|sit on my (?:face|lap)|touch (?:myself|yourself|you)|take it off|what (?:are )?you (?:are )?wear(?:ing)?|every inch|so (?:hard|wet|horny)|wet and ready|legs spread|spread your legs|jerk(?:ed|ing)? off|give it to you|\bsleep with me|\bmake love|bare (?:tits|ass|body)|inside (?:you|me)\b|(?:my|your) (?:pussy|tits|cock|dick|boobs|ass|nipples)|needs? you\b|feel you inside|lick (?:every|you|your|my)",
        "ad": r"\bxxx\b|\bporn\b|\bnudes\b|sex (?:show|video|videos|chat|cam|tape|toys)|uncensored|hot singles|\borgy\b|\bescort|onlyfans|18\+|naked\b(?! pointers| eye)",
        "of_a_thing": r"\b(?:of an?|for an?) (?:\w+)$|of an? \w+ (?:ate|took|broke|died|crashed|failed|is|was|does|keeps)|\b(?:that|this|the) \w+ of an? ",
        "said_by_others": r"(?:called|calls|calling) (?:me|him|her|us|them|people|someone|newcomers)|reported it|removed a|stop using|the word|don't call|do not call|be kind|reads badly|is on the wiki|was (?:banned|reported|removed)|, good$|report for|not ok to|how can (?:people|someone) say",
        "figurative": r"take my money|kill me\b|(?:dying|die) (?:of|laughing)|scary good|a beast at|killer \w+|(?:beat|kill(?:ed)?|destroyed) (?:you )?(?:by|at) |next game|shoot me (?:the|an?|your)|hard to swallow|of mine\b|\bsorry\b|sucks at|just kill the|killed its|\bholy\b|\bdamn\b|\bbloody\b|the naked|reserved word|colour palette|color palette|breast cancer|age and sex|explicit cast|great tits|tits at the|cock crow|pest control|exterminator|garbage collection|trash the|dumb terminal|nude colou?r|hard (?:drive|disk|to|coded)|naked eye|rats in the|vermin in the",
        "harmless_group": r"festival|lovely|pay the same|won the|welcome|equal rights|support for|thank|(?:women|men) (?:and|or) (?:men|women)|celebrate|recipe|helped|invited|history of",
    }.items()
}
_DEMONYM = re.compile(r"\b(?:the|those|these) (?!plans\b|fans\b|scans\b|means\b|cleans\b|loans\b|trans\b|clans\b|pans\b|vans\b|cans\b|beans\b|humans\b|veterans\b|oceans\b)[a-z]{3,}(?:ans|ites|ish|ese)\b")
#: An animal's name is an insult after an insulting adjective.
_BEAST = re.compile(r"\b(?:%s) (?:cow|pig|dog|rat|goat|donkey|ape|sheep|snake|worm|weasel)s?\b" % "|".join(map(re.escape, sorted(INSULT_ADJECTIVES))))
_NAMED = re.compile(r"(?:^|[,.!?;:] |\b(?:lol|honestly|listen|hey|please|@\w+),? )(?!(?:it|this|that|he|she|what|there|which|who|the|my|your|our|here|life|today|everything)\b)(@?[a-z]{2,}) is (?:such )?an? ")

CUE_WORDS = INSULT_NOUNS | INSULT_ADJECTIVES | HARM | DEHUMANISING | SEXUAL | GROUPS
#: Words that disguises are resolved to.
_TARGETS = INSULT_NOUNS | INSULT_ADJECTIVES | DEHUMANISING | SEXUAL | _set("kill shit")
_MASKED: dict[tuple[str, str, int], str] = {}
for _words in (SEXUAL, DEHUMANISING, _set("kill shit"), INSULT_ADJECTIVES, INSULT_NOUNS):  # the later, the likelier
    for _w in sorted(_words, reverse=True):
        _MASKED[_w[0], _w[-1], len(_w)] = _w

# -- disguises ----------------------------------------------------------------------------

_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_TOKENS = re.compile(r"[^\s,;:?!\"()\[\]{}<>]+|[,;:?!]")
_SPACED = re.compile(r"(?<![\w'])(?:[a-z] ){2,}[a-z](?![\w'])")
_LONG = re.compile(r"(.)\1{2,}")
_SENTENCES = re.compile(r"\n+|(?<=[.!?…😡🙂])\s+|\s[-–—/]\s|\s*[!?]{2,}\s*")


def _spaced(m: re.Match) -> str:
    letters = m[0].replace(" ", "")
    for cut in range(3):  # "a i d i o t": the article is not part of the word
        if letters[cut:] in _TARGETS:
            return " ".join([*letters[:cut], letters[cut:]])
    return m[0]


def _plain(token: str) -> str:
    """A token without its disguise; unchanged if none of the lexicon hides in it."""
    t = token.strip(".…'’\"-_~")
    if not t or t in CUE_WORDS:
        return t
    if not t.isascii() and t not in CUE_WORDS:
        return t
    if "*" in t:
        core = t.strip("*")
        if len(core) >= 2 and (hit := _MASKED.get((core[0], core[-1], len(core)))) and all(a == b or a == "*" for a, b in zip(core, hit)):
            return hit
        for w in _TARGETS:
            if len(w) == len(core) and all(a == b or a == "*" for a, b in zip(core, w)):
                return w
        return t
    if any(c in "0134578@$!|" for c in t) and any(c.isalpha() for c in t):
        # 1 may be i or l
        for table in (_LEET, str.maketrans("0134578@$!|", "oleastbasll")):
            u = t.translate(table)
            if u in _TARGETS:
                return u
    if "." in t or "_" in t or "-" in t:
        u = re.sub(r"[._-]", "", t)
        if u in _TARGETS:
            return u
    if _LONG.search(t):
        for u in (_LONG.sub(r"\1", t), _LONG.sub(r"\1\1", t)):
            if u in _TARGETS:
                return u
    return t


class _Plain(dict):
    """Memory of :func:`_plain`."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1 << 17:
            self.clear()
        self[token] = t = _plain(token)
        return t


_plains = _Plain()


def clean(text: str) -> str:
    """Lower-case text with disguises of lexicon words resolved."""
    text = text.lower()
    if "’" in text:
        text = text.replace("’", "'")
    if _SPACED.search(text):
        text = _SPACED.sub(_spaced, text)
    return " ".join(map(_plains.__getitem__, _TOKENS.findall(text)))


# -- features -----------------------------------------------------------------------------


_LITERAL, _AT, _SUBPATTERN, _MAX_REPEAT, _BRANCH = (getattr(_constants, n) for n in ("LITERAL", "AT", "SUBPATTERN", "MAX_REPEAT", "BRANCH"))


def _fragments(pattern: re.Pattern) -> frozenset[str] | None:
    """Word pieces of which every match holds one at least, read from the pattern; None if it needs none."""
    return _fragments_of(_parser.parse(pattern.pattern))


def _fragments_of(tree) -> frozenset[str] | None:
    needed: list[frozenset[str] | None] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is _LITERAL and (chr(arg).isalnum() or arg == ord("'")):
            run += chr(arg)
            continue
        if op is _AT:
            continue
        needed.append(frozenset([run]) if run else None)
        run = ""
        if op is _SUBPATTERN:
            needed.append(_fragments_of(arg[-1]))
        elif op is _MAX_REPEAT and arg[0] > 0:
            needed.append(_fragments_of(arg[2]))
        elif op is _BRANCH:
            parts = [_fragments_of(b) for b in arg[1]]
            needed.append(None if None in parts else frozenset().union(*parts))
    return max((n for n in needed if n), key=lambda n: min(map(len, n)), default=None)


class _Possible(dict):
    """Per word, the bits of the patterns it lets match; remembered."""

    def __init__(self, patterns: dict[str, re.Pattern]):
        self.bit = {k: 1 << i for i, k in enumerate(patterns)}
        needs = {k: _fragments(p) for k, p in patterns.items()}
        self.always = sum(self.bit[k] for k, n in needs.items() if n is None)
        self.needs = [(self.bit[k], n) for k, n in needs.items() if n is not None]

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = m = sum(bit for bit, n in self.needs if any(f in word for f in n))
        return m

    def of(self, words: list[str]) -> int:
        return reduce(or_, map(self.__getitem__, words), self.always)


_possible = _Possible({**PHRASES, "_demonym": _DEMONYM, "_beast": _BEAST, "_named": _NAMED})


def features(sentence: str, context: str = "") -> dict[str, float]:
    """Sparse features of a cleaned sentence; ``context`` is the one before it.

    A pattern is searched for only where the words hold a piece it cannot match without.
    """
    words = sentence.replace(" ,", "").split()
    bag = set(words)
    may, bit = _possible.of(words), _possible.bit
    demonym = bool(may & bit["_demonym"] and _DEMONYM.search(sentence))
    f: dict[str, float] = {}
    classes = {
        "insult": bool(bag & INSULT_NOUNS) or "piece of shit" in sentence or bool(may & bit["_beast"] and _BEAST.search(sentence)),
        "insult_adj": bool(bag & INSULT_ADJECTIVES),
        "you": bool(bag & YOU),
        "harm": bool(bag & HARM),
        "group": bool(bag & GROUPS) or demonym,
        "dehumanising": bool(bag & DEHUMANISING),
        "sexual": bool(bag & SEXUAL),
        "thing": bool(bag & THINGS),
        "reporting": bool(bag & REPORTING),
        "self": bool(bag & SELF),
        "named": bool(may & bit["_named"] and _NAMED.search(sentence)),
    }
    flat = sentence.replace(" ,", ",").replace(" ;", ";").replace(" :", ":").replace(" ?", "?").replace(" !", "!")
    for k, p in PHRASES.items():
        classes[k] = bool(may & bit[k] and p.search(flat))
    on = [k for k, v in classes.items() if v]
    if not on:
        return f
    for k in on:
        f[k] = 1.0
    if len(on) > 1:
        for k in on:
            for other, name in _PAIRS_OF.get(k, ()):
                if classes[other]:
                    f[name] = 1.0
    quiet = classes["said_by_others"] or classes["figurative"] or classes["of_a_thing"]
    if not quiet:
        for k in ("insult", "harm", "sexual", "dehumanising", "threat", "act", "ad"):
            if classes[k]:
                f[f"{k}!"] = 1.0
    if (classes["exclude"] or classes["essence"] or classes["exterminate"] or classes["dehumanising"]) and classes["group"] and not quiet and not classes["harmless_group"]:
        f["against_group"] = 1.0
    if context and classes["essence"] and _group_in(context):
        f["group_before"] = 1.0
    for w in bag & _SCORED_WORDS:
        f[f"w:{w}"] = 0.5
    return f


def _group_in(sentence: str) -> bool:
    return not GROUPS.isdisjoint(sentence.split()) or bool(_DEMONYM.search(sentence))


_PAIRS = (
    ("insult", "you"), ("insult", "named"), ("insult", "demean"), ("insult", "dismiss"), ("insult_adj", "you"), ("insult", "insult_adj"), ("insult", "thing"), ("harm", "you"), ("threat", "you"), ("dismiss", "you"), ("group", "dehumanising"), ("group", "exclude"), ("group", "essence"), ("group", "exterminate"), ("dehumanising", "essence"),
    ("sexual", "solicit"), ("sexual", "you"), ("sexual", "act"), ("sexual", "ad"), ("sexual", "thing"), ("act", "you"), ("act", "solicit"), ("sexual", "reporting"), ("insult", "reporting"), ("insult", "said_by_others"), ("harm", "figurative"), ("group", "harmless_group"), ("insult", "of_a_thing"), ("sexual", "dismiss"), ("group", "insult"),
)
_PAIRS_OF: dict[str, list[tuple[str, str]]] = {}
for _a, _b in _PAIRS:
    _PAIRS_OF.setdefault(_a, []).append((_b, f"{_a}&{_b}"))
_SCORED_WORDS = INSULT_NOUNS | SEXUAL | DEHUMANISING | HARM


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCES.split(text) if s and s.strip()]


# -- model ---------------------------------------------------------------------------------

_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def ngrams(sentence: str) -> list[str]:
    """Words, pieces of four letters, neighbouring words and words two apart of a cleaned sentence; no list is asked."""
    words = _WORDS.findall(sentence)
    out = [f"1:{w}" for w in words]
    for w in words:
        if len(w) > 4:
            out += [f"c:{w[i : i + 4]}" for i in range(len(w) - 3)]
    ends = ["<", *words, ">"]
    out += [f"2:{a} {b}" for a, b in zip(ends, ends[1:])]
    out += [f"3:{a} {b}" for a, b in zip(ends, ends[2:])]
    return out


#: Words, sentences and feature sets whose sums a task remembers.
_MEMORY = 1 << 16
_NOTHING = (0.0, 0.0, 0.0)

#: Weight of an n-gram beside a class: many of them fire at once.
GRAM = 0.3
#: Weight of a harmless training message: harmless text is far more varied than what is written here.
HARMLESS = 1.5
#: N-grams of the training messages are kept if at least so many messages have them.
LEAST_MESSAGES = 2
LEAST_PIECES = 6


@dataclass
class Model:
    by_kind: dict[str, CumulativeLink]
    _seen: dict[tuple[str, ...], tuple[float, ...]] = field(default_factory=dict)
    _of_word: dict[str, tuple[float, ...]] = field(default_factory=dict)
    _sentences: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = {n for m in self.by_kind.values() for n in m.weights}
        of = lambda n, by: tuple(by * m.weights.get(n, 0.0) for m in self.by_kind.values())
        self._classes = {n: of(n, 1.0) for n in names if n[1:2] != ":" or n[0] == "w"}
        grams = {n: of(n, GRAM) for n in names if n not in self._classes}
        self._grams = {n: x for n, x in grams.items() if n[0] in "1c"}
        self._two, self._three = ({tuple(n[2:].split(" ")): x for n, x in grams.items() if n[0] == k} for k in "23")
        self._cuts = [m.cuts.tolist() for m in self.by_kind.values()]

    def severities(self, text: str | None) -> tuple[list[float], list[bool]]:
        """Expected severity per kind and whether grade 1 or more is likelier than not.

        Every sentence is scored, whether or not a word of it stands in a list.
        """
        best, hit = list(self.floor), [False] * len(KINDS)
        if not text:
            return best, hit
        before = ""
        for s in sentences(text):
            c = clean(s)
            for i, (cuts, x) in enumerate(zip(self._cuts, self._links(c, before))):
                if x - cuts[0] > -6:
                    e = sum(1 / (1 + exp(min(35.0, cut - x))) for cut in cuts)
                    if e > best[i]:
                        best[i] = e
                    hit[i] = hit[i] or x > cuts[0]
            before = c
        return best, hit

    def _links(self, c: str, before: str) -> tuple[float, float, float]:
        """Sums of the weights of a cleaned sentence, per kind."""
        known = self._sentences.get(c)
        if known is not None:
            return known
        f = features(c, before)
        key = tuple(f)
        z = self._seen.get(key)
        if z is None:
            if len(self._seen) > _MEMORY:
                self._seen.clear()
            parts = [tuple(v * x for x in self._classes[n]) for n, v in f.items() if n in self._classes]
            z = self._seen[key] = tuple(map(sum, zip(*parts))) if parts else (0.0,) * len(KINDS)
        p, q, r = z
        words = _WORDS.findall(c)
        of_word, last, last2 = self._of_word, "<", None
        for w in words:
            x = of_word.get(w)
            if x is None:
                x = self._word(w)
            if x is not _NOTHING:
                p, q, r = p + x[0], q + x[1], r + x[2]
        two, three = self._two, self._three
        for w in [*words, ">"]:
            if x := two.get((last, w)):
                p, q, r = p + x[0], q + x[1], r + x[2]
            if last2 is not None and (x := three.get((last2, w))):
                p, q, r = p + x[0], q + x[1], r + x[2]
            last, last2 = w, last
        if "essence" not in f:  # else the sentence before may matter
            if len(self._sentences) > _MEMORY:
                self._sentences.clear()
            self._sentences[c] = p, q, r
        return p, q, r

    def _word(self, w: str) -> tuple[float, ...]:
        """What a word and its pieces weigh, remembered."""
        if len(self._of_word) > _MEMORY:
            self._of_word.clear()
        own = [o for o in map(self._grams.get, (n for n in ngrams(w) if n[0] in "1c")) if o]
        x = self._of_word[w] = tuple(map(sum, zip(*own))) if own else _NOTHING
        return x

    @property
    def floor(self) -> tuple[float, ...]:
        """Expected severities of a message that says nothing."""
        if not hasattr(self, "_floor"):
            self._floor = tuple(m.expected({}) for m in self.by_kind.values())
        return self._floor


def fit(sample: DataFrame, msg: str = "msg", kind: str = "kind", order: str = "sample_id") -> Model:
    """Fit on labelled messages and on messages written from templates.

    The labels name a kind, not a severity: a labelled message tells that grade 1 is reached
    and nothing about grade 2.  Rows with another label or a NULL message are left out.
    """
    rows = sample.where(F.col(kind).isin("none", *KINDS) & F.col(msg).isNotNull()).select(order, msg, kind).distinct().orderBy(order).limit(MAX_SAMPLE).collect()
    return fit_rows([(r[kind], None, r[msg]) for r in rows])


def _merged(text: str) -> dict[str, float]:
    out: dict[str, float] = {}
    before = ""
    for s in sentences(text):
        c = clean(s)
        for k, v in [*features(c, before).items(), *((n, GRAM) for n in ngrams(c))]:
            out[k] = max(out.get(k, 0.0), v)
        before = c
    return out


def fit_rows(rows: list[tuple[str, int | None, str]], templates: list[tuple[str, int, str]] | None = None) -> Model:
    rows = [*rows, *(write_out() if templates is None else templates)]
    xs = [_merged(m) for _, _, m in rows]
    often = Counter(n for x in xs for n in x)
    xs = [{n: v for n, v in x.items() if often[n] >= (LEAST_MESSAGES if n[:2] != "c:" else LEAST_PIECES)} for x in xs]
    weights = [HARMLESS if label == "none" else 1.0 for label, _, _ in rows]
    models = {}
    for kind in KINDS:
        grades = [0 if label != kind else severity or UNKNOWN for label, severity, _ in rows]
        models[kind] = CumulativeLink(N_GRADES).fit(xs, grades, weights)
    return Model(models)


# -- Spark ---------------------------------------------------------------------------------


def _score(model: Model, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scored = [model.severities(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([s[0][i] for s in scored], pa.float64()) for i in range(len(KINDS))]
            hits = [pa.array([s[1][i] for s in scored], pa.bool_()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(keep)], *cols, *hits], names=[*b.schema.names[:keep], *KINDS, *[f"is_{k}" for k in KINDS]])

    return run


def scores(messages: DataFrame, model: Model, *, id_col: str, msg: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., abuse, hate, sexual, is_abuse, is_hate, is_sexual), one row per message.

    NULL or empty messages score as harmless ones.  Rows without id are left out; a
    message delivered again counts once, with the highest scores if deliveries differ.
    """
    src = messages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.col(msg).alias("__msg"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = spread(src).mapInArrow(_score(model, 1 + len(keep)), f"{head}, {', '.join(f'{k} double' for k in KINDS)}, {', '.join(f'is_{k} boolean' for k in KINDS)}")
    return out.groupBy("id").agg(*[F.min(c).alias(c) for c in keep], *[F.max(c).alias(c) for c in (*KINDS, *[f"is_{k}" for k in KINDS])])


def found(messages: DataFrame, model: Model, *, id_col: str, msg: str) -> DataFrame:
    """(id, kind) of the messages that have a kind; only those are shuffled."""
    src = messages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(msg).alias("__msg"))
    kind = src.schema["id"].dataType.simpleString()
    out = spread(src).mapInArrow(_score(model, 1), f"id {kind}, {', '.join(f'{k} double' for k in KINDS)}, {', '.join(f'is_{k} boolean' for k in KINDS)}")
    return cases(out.where(" OR ".join(f"is_{k}" for k in KINDS))).distinct()


def cases(scored: DataFrame) -> DataFrame:
    """(id, kind), one row per scored row and kind."""
    kinds = F.filter(F.array(*[F.when(F.col(f"is_{k}"), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    return scored.select("id", F.explode(kinds).alias("kind"))


def rates(scored: DataFrame, source: str) -> DataFrame:
    """Messages, share of cases and mean severity per source and kind."""
    g = scored.groupBy(source).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"is_{k}").alias(f"n_{k}") for k in KINDS], *[F.avg(k).alias(f"avg_{k}") for k in KINDS])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n_cases"), (F.col(f"n_{k}") / F.col("n")).alias("rate"), F.col(f"avg_{k}").alias("mean_severity")) for k in KINDS])).alias("r")
    return g.select(source, "n", rows).select(source, "r.kind", "n", "r.n_cases", "r.rate", "r.mean_severity")
