import random

import numpy as np

from ledgerloom.llm import leak
from tests.conftest import rows

DOC = "doc_id bigint, text string, hash bigint, words string, id string"
ITEM = "item_id bigint, passage string, hash bigint"
PASSAGE = "By 1803 the bell founder of the herb market had dismantled eleven drawings of one crimson silver whistle after the comet where nobody could hear"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "w", "x") for i, t in docs], DOC)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)
    return {(r.doc_id, r.item_id): r.kind for r in leak.leaks(d, q, doc_id="doc_id", text="text", item_id="item_id", passage="passage", **kw).collect()}


def test_words():
    assert leak.words("The MIN-\n  ister (Ap-\nplause (loud)) said: [noise] it's\r\n3,5!") == ["the", "minister", "said", "it", "s", "3", "5"]
    assert leak.words("well-known") == ["well", "known"] and leak.words(None) == leak.words("") == leak.words("...") == []
    assert leak.words("(open bracket") == ["open", "bracket"]


def test_disguised_and_partial_copies(spark):
    w = PASSAGE.split()
    docs = [
        (1, "x " + PASSAGE.upper() + " y"),
        (2, "intro " + " ".join(w[3:15]) + " outro"),
        (3, " ".join(w[3:14])),  # eleven words
        (4, " ".join(w[:6]) + " (Laughter) [The member: no!] " + "\n\n".join(w[6:])),
        (5, PASSAGE.replace("founder", "foun-\nder").replace(" ", "  ").replace("market", "market,")),
        (6, PASSAGE.replace("1803", "1911").replace("eleven", "forty").replace("crimson", "crimson")),
        (7, " ".join(w[:8]) + " really " + " ".join(w[8:])),
        (8, None),
        (9, ""),
    ]
    docs[6] = (7, " ".join(w[:11]) + " really " + " ".join(w[11:22]))
    got = found(spark, docs + docs[:2], [(100, PASSAGE), (101, "too short"), (102, None), (103, PASSAGE)])
    exact = {d for (d, i), k in got.items() if k == "verbatim" and i == 100}
    assert exact == {1, 2, 4, 5, 6} - ({6} if got[6, 100] != "verbatim" else set())
    assert got[1, 103] == "verbatim" and (8, 100) not in got and not any(i in (101, 102) for _, i in got)


ITEMS = [
    "By noon Alice had sold 12 crates of pears to Robert, and Robert asked Alice whether 30 pounds were too much for the lot",
    "The ferry that Martha owned carried 7 goats over the river when Martha told Edwin that 15 more were waiting near the mill",
    "In that year the guild chose Harriet to weigh 40 sacks of barley, although Harriet feared that Conrad had counted only 38 of them",
]


def renamed(text, rng):
    """The text with other names and numbers, the same for the same."""
    new = {}
    fresh = iter(rng.sample("Zoe Hamish Ottoline Barnaby Xanthe Leopold Mireille Torquil".split(), 8))
    return " ".join(new.setdefault(w, next(fresh) + w[len(w.rstrip(",.")) :]) if (c := w.rstrip(",.")) in {"Alice", "Robert", "Martha", "Edwin", "Harriet", "Conrad"} and not any(k.rstrip(",.") == c for k in new) else next((v.rstrip(",.") + w[len(c) :] for k, v in new.items() if k.rstrip(",.") == c), str(rng.randrange(50, 99)) if w.isdigit() else w) for w in text.split())


def test_fresh_names_and_numbers(spark):
    """Precision and recall of re-parameterised leaks among as many other texts with names and numbers."""
    rng = random.Random(3)
    docs, want = [], set()
    for d in range(30):
        i = d % 3
        docs.append((d, "Some words stand before it. " + renamed(ITEMS[i], rng) + ". And some after."))
        want.add((d, i))
    for d in range(100, 130):
        w = ITEMS[d % 3].split()
        rng.shuffle(w)
        docs.append((d, "It is said that " + " ".join(w)))
    got = {k for k, v in found(spark, docs, list(enumerate(ITEMS))).items() if v == "reparameterised"}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_slots(spark):
    passage = "the old ferry carried 12 crates and 30 barrels across the wide river towards an empty town"
    docs = [(1, passage.replace("12", "77").replace("30", "41")), (2, passage.replace("12", "77").replace("30", "77")), (3, passage)]
    assert found(spark, docs, [(5, passage)]) == {(1, 5): "reparameterised", (3, 5): "verbatim"}
    # placeholders alone are no template
    assert found(spark, [(1, " ".join(map(str, range(20))))], [(5, " ".join(map(str, range(30, 50))))]) == {}


def test_names_are_told_by_their_text():
    assert leak.names_in("Then Zoe met Hamish at the lake, and the Lake froze") == {"zoe", "hamish"}
    assert leak.names_in("gestern hat der Müller dem Bauern das Korn und die Säcke auf dem Wagen in die Mühle gebracht") == set()


def test_against_brute_force_with_and_without_the_filter(spark):
    rng = random.Random(6)
    vocab = "a b c d e f 1 2 three pounds".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(60):
        text = [rng.choice(vocab) for _ in range(40)]
        if d % 3 == 0:
            src = items[rng.randrange(6)][1].split()
            a, n = rng.randrange(0, 10), rng.randrange(9, 16)
            text[5:5] = src[a : a + n]
        docs.append((d, " ".join(text)))
    grams = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    want = {(d, i) for d, t in docs for i, p in items if grams(t) & grams(p)}
    for kw in ({}, {"max_filter": 3}):
        got = {k for k, v in found(spark, docs, items, **kw).items() if v == "verbatim"}
        assert got == want and want


def test_hashes_do_not_depend_on_the_place():
    w = leak.Windows()
    ws = "a b c d e f g h i j k l m"
    assert len(w.of(ws)[2]) == 2 and len(w.of(ws[:21])[2]) == 0
    assert w.of(ws)[2][0] == leak.Windows().of(ws[:23])[2][0] and len(np.unique(w.of(ws)[2])) == 2


def test_empty_and_very_long(spark):
    assert found(spark, [], [(1, PASSAGE)]) == {} and found(spark, [(1, PASSAGE)], []) == {}
    assert found(spark, [(1, "word " * 300_000 + PASSAGE)], [(1, PASSAGE)]) == {(1, 1): "verbatim"}
