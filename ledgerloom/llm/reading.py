"""Reading level of documents on the scale of a graded sample.

Boosted regression trees over distributions of length, vocabulary, syntax and cohesion
predict a grade (0 plain, 1 middle, 2 demanding).  Predictions for sources that were held
out give an isotonic calibration, which is applied to every document.  Fitting takes at most
``MAX_SAMPLE`` graded passages on the driver; scoring is one pass over Arrow batches and
reads whole texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Boosted, isotonic
from ledgerloom.sources.spread import spread

BANDS = ("plain", "middle", "demanding")
#: Greatest number of graded passages used for fitting, in order of their ids.
MAX_SAMPLE = 20_000
FOLDS = 5

_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*(?:\r\n|\r|\n)\s*(?=[^\W\d_])")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)]*(?:\s+|$)|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyäöüéèêà]+")
COMMON = frozenset(
    "the of and to a in that is was he for it with as his on be at by i this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back where much your way well down should because each just those people mr how too little".split()
)
LINKS = frozenset("because although though unless whereas since while whether if when that which who whose whom notwithstanding insofar inasmuch irrespective however therefore thus hence moreover nevertheless neither nor rather upon whereby".split())

FEATURES = (
    ["words_mean", "words_p10", "words_p50", "words_p90", "letters_mean", "letters_p50", "letters_p90", "long7", "long10", "long13", "syllables", "syl4", "common", "links", "distinct", "commas", "overlap"]
    + [f"sent_letters_p{q}" for q in (10, 40, 50, 60, 90)]
    + ["sent_hard", "sent_easy", "word_share_hard", "word_share_easy"]
)


class _Syllables(dict):
    """Vowel groups of a word, remembered."""

    def __missing__(self, w: str) -> int:
        n = max(1, len(_VOWELS.findall(w)))
        if len(self) > 1 << 18:
            self.clear()
        self[w] = n
        return n


_syllables = _Syllables()


def _quantile(ordered: list[float], q: float) -> float:
    """Linear interpolation between order statistics."""
    at = q * (len(ordered) - 1)
    i = int(at)
    return ordered[i] + (at - i) * (ordered[min(i + 1, len(ordered) - 1)] - ordered[i])


def features(text: str | None) -> list[float] | None:
    """Features of a whole text without bracketed interruptions; None if it has no words."""
    if not text:
        return None
    if "(" in text or "[" in text:
        text = _ASIDE.sub(" ", text)
    if "\n" in text:
        text = _DIVIDED.sub("", text)
    all_words: list[str] = []
    sizes, letters_of, hard, easy = [], [], 0, 0
    hard_words = easy_words = 0
    shared, pairs, last = 0.0, 0, None
    for s in _SENTENCE.split(text.lower()):
        ws = _WORD.findall(s)
        if not ws:
            continue
        n = len(ws)
        mean = sum(map(len, ws)) / n
        all_words += ws
        sizes.append(n)
        letters_of.append(mean)
        if mean >= 7.0 and n >= 5:
            hard, hard_words = hard + 1, hard_words + n
        elif mean < 5.0 and n <= 14:
            easy, easy_words = easy + 1, easy_words + n
        content = set(ws) - COMMON
        if last is not None:
            pairs += 1
            shared += len(content & last) / (min(len(content), len(last)) or 1)
        last = content
    if not all_words:
        return None
    n, k = len(all_words), len(sizes)
    letters = sorted(map(len, all_words))
    n7, n10, n13 = (n - bisect_left(letters, x) for x in (7, 10, 13))
    counts = Counter(all_words)
    syl = syl4 = common = links = 0
    for w, c in counts.items():
        v = _syllables[w]
        syl += v * c
        if v >= 4:
            syl4 += c
        if w in COMMON:
            common += c
        if w in LINKS:
            links += c
    sizes.sort()
    letters_of.sort()
    return [
        n / k, *[_quantile(sizes, q) for q in (0.1, 0.5, 0.9)], sum(letters) / n, _quantile(letters, 0.5), _quantile(letters, 0.9), n7 / n, n10 / n, n13 / n, syl / n, syl4 / n, common / n, links / n,
        len(counts) / n**0.75, (text.count(",") + text.count(";")) / n, shared / pairs if pairs else 0.0, *[_quantile(letters_of, q) for q in (0.1, 0.4, 0.5, 0.6, 0.9)], hard / k, easy / k, hard_words / n, easy_words / n,
    ]


@dataclass
class ReadingModel:
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]
    #: Per passage of the sample: group, band number, grade by a model and a calibration that did not see its fold.
    held_out: list[tuple[str, int, float]]

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), *self.knots)


def _kin(texts: list[str]) -> list[str]:
    """Groups of passages that share five words in a row, directly or through others."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple[str, ...], int] = {}
    for i, t in enumerate(texts):
        ws = _WORD.findall(t.lower())
        for j in range(len(ws) - 4):
            other = first.setdefault(tuple(ws[j : j + 5]), i)
            root[find(i)] = find(other)
    return [str(find(i)) for i in range(len(texts))]


def fit(sample: DataFrame, text: str = "text", band: str = "band", order: str = "sample_id", source: str | None = None) -> ReadingModel:
    """Fit on graded passages; rows with another band or without words are left out.

    Validation holds out whole sources.  Where the sample names none, passages that share
    wording count as one source.  The calibration of a fold comes from the other folds.
    """
    rows = sample.where(F.col(band).isin(*BANDS) & F.col(text).isNotNull())
    rows = rows.select(order, text, band, *([source] if source else [])).distinct().orderBy(order).limit(MAX_SAMPLE).collect()
    rows = [(f, BANDS.index(r[band]), r) for r in rows if (f := features(r[text])) is not None]
    if len(rows) < 2 * FOLDS:
        raise ValueError(f"{len(rows)} graded passages are too few")
    group = [str(r[source]) for _, _, r in rows] if source else _kin([r[text] for _, _, r in rows])
    x, y = np.array([p[0] for p in rows]), np.array([p[1] for p in rows], float)
    names = sorted(set(group))
    if len(names) < FOLDS:  # too few to hold any out
        group = names = list(map(str, range(len(rows))))
    place = dict(zip(names, np.random.default_rng(11).permutation(len(names)) % FOLDS))
    fold = np.array([place[g] for g in group])
    oof, cal = np.empty(len(y)), np.empty(len(y))
    for k in range(FOLDS):
        oof[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    for k in range(FOLDS):
        cal[fold == k] = np.interp(oof[fold == k], *isotonic(oof[fold != k], y[fold != k]))
    return ReadingModel(Boosted().fit(x, y), isotonic(oof, y), list(zip(group, y.astype(int).tolist(), cal.tolist())))


def validation(spark: SparkSession, model: ReadingModel) -> DataFrame:
    """(source, band, n, n_right, rmse) of passages graded while their source was held out."""
    held = spark.createDataFrame(model.held_out, "source string, at int, grade double")
    band = F.element_at(F.array(*map(F.lit, BANDS)), F.col("at") + 1).alias("band")
    return held.groupBy("source", "at").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.rint("grade") == F.col("at")).alias("n_right"), F.sqrt(F.avg((F.col("grade") - F.col("at")) ** 2)).alias("rmse")).select("source", band, "n", "n_right", "rmse")


def grade(text: Column, model: ReadingModel) -> Column:
    """Calibrated grade in [0, 2]; NULL for texts without words."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = [features(t) for t in s]
            has = [i for i, r in enumerate(rows) if r is not None]
            out = np.full(len(rows), np.nan)
            if has:
                out[has] = model.grade(np.array([rows[i] for i in has]))
            yield pd.Series(out).astype("Float64").where(~np.isnan(out), None)

    return F.pandas_udf(score, "double")(text)


def band_of(g: Column) -> Column:
    """Nearest band of a grade."""
    return F.when(g >= 1.5, BANDS[2]).when(g >= 0.5, BANDS[1]).when(g.isNotNull(), BANDS[0])


def levels(documents: DataFrame, model: ReadingModel, *, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., grade, band), one row per document.

    A document delivered again with the same content counts once; deliveries with
    different texts keep the highest grade.  NULL or wordless texts have no grade.
    """
    d = spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__text")))
    d = d.select("doc_id", *keep, grade(F.col("__text"), model).alias("grade"))
    d = d.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in keep], F.max("grade").alias("grade"))
    return d.withColumn("band", band_of(F.col("grade")))
