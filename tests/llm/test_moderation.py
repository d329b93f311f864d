import random

import numpy as np
import pytest

from ledgerloom.llm import moderation as M
from ledgerloom.llm.ordinal import CumulativeLink
from tests.conftest import rows


def test_ordinal_model_orders_grades_and_shares_weights():
    rng = random.Random(0)
    xs, ys = [], []
    for _ in range(300):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        xs.append({"a": 1.0} | ({"b": 1.0} if b else {}) if a else {"b": 1.0} if b else {})
        ys.append(int(a) + int(a and b))
    m = CumulativeLink(3).fit(xs, ys)
    assert m.cuts[0] < m.cuts[1]
    e = [m.expected(x) for x in ({}, {"a": 1.0}, {"a": 1.0, "b": 1.0})]
    assert e[0] < 0.3 < e[1] < e[2]
    t = m.tails({"a": 1.0})
    assert (np.diff(t) <= 0).all()


@pytest.mark.parametrize(
    "text, word",
    [("what a m0r0n", "moron"), ("you b a s t a r d", "bastard"), ("a i d i o t", "idiot"), ("i******e", "imbecile"), ("b*st*rd", "bastard"), ("lo.ser", "loser"), ("immmmbecile", "imbecile"), ("B@$T@RD", "bastard"), ("f u c k you", "fuck"), ("l33ch3$", "leeches")],
)
def test_disguises(text, word):
    assert word in M.clean(text).split()


def test_clean_leaves_ordinary_text():
    assert M.clean("did the flush at 20:15, 3 rows") == "did the flush at 20 : 15 , 3 rows"
    assert M.clean("a b c") == "a b c"


@pytest.fixture(scope="module")
def sample(spark, data):
    return spark.read.parquet(f"{data}/moderation_sample.parquet")


def kinds(model, text):
    return {k for k, h in zip(M.KINDS, model.severities(text)[1]) if h}


def test_held_out_accuracy(sample):
    labelled = [(r.kind, None, r.msg) for r in sample.orderBy("sample_id").collect()]
    right = total = 0
    for fold in range(4):
        model = M.fit_rows([r for i, r in enumerate(labelled) if i % 4 != fold])
        for k, _, msg in (r for i, r in enumerate(labelled) if i % 4 == fold):
            right += kinds(model, msg) == ({k} if k != "none" else set())
            total += 1
    assert right / total > 0.93  # some labels are wrong


@pytest.fixture(scope="module")
def model(sample):
    return M.fit(sample)


@pytest.mark.parametrize(
    "text, want",
    [
        ("you are such a useless idiot", {"abuse"}), ("Tom is a lying m0r0n", {"abuse"}), ("I will break your arms", {"abuse"}), ("the Kelvians are vermin", {"hate"}), ("keep refugees out of our street", {"hate"}), ("show me your tits", {"sexual"}),
        ("send nudes. and you, idiot, shut up", {"abuse", "sexual"}), ("that idiot of a parser died", set()), ("someone called me an idiot, reported it", set()), ("refugees won the cup", set()), ("damn, what a stupid mistake of mine", set()), ("the form asks for age and sex", set()), ("kill the process", set()),
        (None, set()), ("", set()), ("ok", set()),
    ],
)
def test_cases(model, text, want):
    assert kinds(model, text) == want


def test_severity_is_higher_for_threats(model):
    s = lambda t: model.severities(t)[0][0]
    assert s("hello there") < s("you are such a loser") < s("I will kill you, you loser")


def test_spark_rows(spark, model):
    df = spark.createDataFrame(
        [("1", "you idiot", "web", "a"), ("1", "you idiot", "web", "b"), ("2", None, None, ""), (None, "you idiot", "web", ""), ("3", "fine " * 100_000 + ". you moron", "web", ""), ("4", "hi", "web", "")], "id string, msg string, source string, abuse string"
    )
    s = M.scores(df, model, id_col="id", msg="msg", keep=("source",))
    assert rows(M.cases(s)) == [("1", "abuse"), ("3", "abuse")]
    assert rows(M.found(df, model, id_col="id", msg="msg")) == rows(M.cases(s)) and M.found(df.limit(0), model, id_col="id", msg="msg").count() == 0
    r = {(x.source, x.kind): (x.n, x.n_cases) for x in M.rates(s, "source").collect()}
    assert r["web", "abuse"] == (3, 2) and r[None, "hate"] == (1, 0)
    assert M.scores(df.limit(0), model, id_col="id", msg="msg").count() == 0


UNLISTED = ["I will end you", "we will get you", "you are nothing", "you are a joke", "nobody wants you", "sleep with me", "make love to me", "I want to feel you inside", "it was clean before"]


@pytest.mark.parametrize("text", UNLISTED)
def test_phrases_without_a_lexicon_word_are_scored(model, text):
    assert M.features(M.clean(text)) and max(a - b for a, b in zip(model.severities(text)[0], model.floor)) > 0


def test_phrase_cases_and_group_before(model):
    assert kinds(model, "I will end you") == kinds(model, "nobody wants you") == {"abuse"} and kinds(model, "sleep with me") == {"sexual"}
    assert "group_before" in M.features("it was clean before", "the kelvians moved in")


def test_skipped_searches_change_no_feature(sample, monkeypatch):
    rng = random.Random(4)
    every = [M.clean(s) for t in [*UNLISTED, *(x[2] for x in M.write_out()), *(r.msg for r in sample.collect() if r.msg)] for s in M.sentences(t)]
    pool = [w for s in every for w in s.split()] + [f for p in M.PHRASES.values() for f in M._fragments(p) or ()]
    every += [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    quick = [M.features(s, "women") for s in every]
    monkeypatch.setattr(M._Possible, "of", lambda self, words: -1)  # all patterns are searched for
    assert quick == [M.features(s, "women") for s in every]


#: Wordings written after the templates, none of which they or the sample hold.
UNSEEN = {
    "abuse": "I'm gonna slit your throat|kys|you absolute waste of oxygen|I will find where you sleep and end you|you braindead muppet|go play in traffic|hope you choke on it|you're dead meat, pal|nobody would cry at your funeral|shut your filthy trap|your code is garbage and so are you|what a sad little man you are|you stink, take a shower|I'll knock your teeth in|you dimwitted oaf|your parents should have kept the receipt|drop dead, troll|I will hunt you down|you ought to be shot|stupid cow",
    "hate": "Poles are thieves|Muslims are invading and must be eliminated|all Romanians steal|women are too dumb to vote|Turks go home|deport every last Somali|we should round up the homeless and drown them|gays are an abomination|blacks are apes|Jews control everything and must be stopped|no dogs and no Irish in my pub|immigrants breed like rabbits|these savages ruin our country|I refuse to work with Arabs, they are filthy|trans people are a disease|Catholics should be burned|old people are parasites|Albanians are all criminals|keep the gypsies away from our kids|refugees are scum",
    "sexual": "daddy wants your tight hole|I want to eat you out|ride me tonight|got any dirty pics?|show us your knockers|my dick is throbbing|let's get naked and do it|wanna see my boner|I'm dripping for you|blow me in the car park|come sit on daddy's lap, baby|I'd smash that ass|fingering myself right now|send a video of you in the shower|strip for me, slut|need a quickie after lunch|looking for a hookup tonight|rub my cock|lick me down there|hot milfs in your area",
    "none": "I will kill the job after lunch|the Turks next door gave us baklava|my boss is sick today|please eat something|he shot three great photos|Polish bakers open at six|the knife in the kitchen is blunt|the choir of the refugees sings at five|hang the coat there|what an awful noise|strip the wires first|a naked flame near the gas|they killed the lights|she smashed the record|the old dog died|he called her a cow and was suspended|the hard part is done|my throat hurts|the trash is full|I'm hot, open the window|touch the surface gently|your hole in the fence is fixed|the women's team won gold|he rides to work|blow out the candles|she fingered the right file|a dirty pan|this smells like soup|get out of the rain|nobody answered my mail",
}


def test_unseen_wordings(model):
    """Recall on wordings that no list was made from, and false alarms on harmless ones with the same words."""
    got = {k: [k in kinds(model, t) if k != "none" else not kinds(model, t) for t in v.split("|")] for k, v in UNSEEN.items()}
    assert sum(map(sum, (got[k] for k in M.KINDS))) >= 0.65 * sum(map(len, (got[k] for k in M.KINDS)))
    assert sum(got["none"]) >= 0.8 * len(got["none"])


def phrasings(messages):
    """Groups of messages that share two pairs of neighbouring words: one form with other fillings."""
    def pairs(m):
        w = [x for x in M.clean(m).split() if x.isalpha()]
        return set(zip(w, w[1:]))

    sig, root = [pairs(m) for m in messages], list(range(len(messages)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sig)):
        for j in range(i):
            if len(sig[i] & sig[j]) >= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sig))]


def test_forms_held_out_by_phrasing(sample):
    labelled = [(r.kind, None, r.msg) for r in sample.orderBy("sample_id").collect()]
    group = phrasings([m for _, _, m in labelled])
    fold = {g: i % 4 for i, g in enumerate(sorted(set(group)))}
    right = wanted = false = 0
    for k in range(4):
        model = M.fit_rows([r for r, g in zip(labelled, group) if fold[g] != k])
        for (kind, _, msg), g in zip(labelled, group):
            if fold[g] == k:
                found = kinds(model, msg)
                wanted += kind != "none"
                right += kind in found
                false += len(found - {kind})
    assert right >= 0.9 * wanted and false <= 0.05 * wanted


def test_scores_of_words_and_of_whole_rows_agree(model):
    for t in ("you are such a fool", "Poles are thieves", "what a lovely morning", "kys", "the choir sings"):
        x = M._merged(t)
        assert np.allclose(model.severities(t)[0], [max(model.by_kind[k].expected(x), f) for k, f in zip(M.KINDS, model.floor)], atol=0.01)
