import numpy as np
import pytest

from ledgerloom.llm import queries, reading
from ledgerloom.llm.boosting import Boosted, isotonic
from tests.conftest import rows


def test_boosting_learns_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + (x[:, 1] > 1)
    m = Boosted().fit(x[:200], y[:200])
    assert np.sqrt(((m.predict(x[200:]) - y[200:]) ** 2).mean()) < 0.35
    assert (m.predict(x) == Boosted().fit(x[:200], y[:200]).predict(x)).all()
    constant = Boosted(n_trees=3).fit(np.zeros((20, 2)), np.ones(20))
    assert (constant.predict(np.ones((5, 2))) == 1).all()


def test_isotonic_is_monotone():
    k, v = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]))
    assert (np.diff(v) >= 0).all() and list(v) == [0, 1.5, 3] and list(k) == [1, 2.5, 4]


def test_features():
    assert reading.features(None) is reading.features("") is reading.features("12 34 !?") is None
    f = dict(zip(reading.FEATURES, reading.features("We can fix this. It is time to act. [Applause] (Laughter)")))
    assert f["words_mean"] == 4.5 and f["long7"] == 0 and len(f) == len(reading.FEATURES) == len(reading.features("a"))
    assert reading.features("the indemni-\nfication") == reading.features("the indemnification")


@pytest.fixture(scope="module")
def model(spark, data):
    return reading.fit(spark.read.parquet(f"{data}/reading_sample.parquet"))


def test_held_out_accuracy(model):
    errors = [abs(g - b) for _, b, g in model.held_out]
    assert sum(e < 0.5 for e in errors) > 0.95 * len(errors) and sum(e * e for e in errors) < 0.25**2 * len(errors)
    assert len({g for g, _, _ in model.held_out}) >= 5


def test_levels(spark, data, model):
    sample = spark.read.parquet(f"{data}/reading_sample.parquet")
    plain, hard = (sample.where(f"band = '{b}'").first().text for b in ("plain", "demanding"))
    docs = [(1, plain, "s", "x"), (2, hard, "s", "x"), (2, hard, "s", "x"), (3, None, "s", "x"), (4, "...", "s", "x"), (None, hard, "s", "x"), (5, (hard + " ") * 300, None, "x"), (6, hard[:300] + " " + (plain + " ") * 6, "s", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, grade string")
    out = {r.doc_id: r.band for r in reading.levels(df, model, doc_id="doc_id", text="text", keep=("source",)).collect()}
    assert out == {1: "plain", 2: "demanding", 3: None, 4: None, 5: "demanding", 6: out[6]} and out[6] != "demanding"
    assert reading.levels(df.limit(0), model, doc_id="doc_id", text="text").count() == 0


def test_too_small_a_sample(spark):
    with pytest.raises(ValueError):
        reading.fit(spark.createDataFrame([(1, "a b", "plain"), (2, None, "middle"), (3, "x", "other")], "sample_id int, text string, band string"))


def test_band_borders(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.49,), (1.5,), (None,)], "g double")
    assert rows(df.select("g", reading.band_of(df.g))) == [(0.0, "plain"), (0.5, "middle"), (1.49, "middle"), (1.5, "demanding"), (None, None)]


def test_queries_grade_documents_of_every_lang(spark, data, tmp_path):
    sample = spark.read.parquet(f"{data}/reading_sample.parquet")
    sample.write.parquet(f"{tmp_path}/reading_sample.parquet")
    hard = sample.where("band = 'demanding'").first().text
    docs = [(1, hard, "en", "a"), (2, hard, None, "a"), (3, "Die Regierung berät heute den Haushalt.", "de", "b"), (4, "Nous allons voter ce budget.", "fr", "b"), (5, None, "de", "b")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.p9_levels(spark, str(tmp_path)).collect()}
    assert {i: r.lang for i, r in got.items()} == {i: lang for i, _, lang, _ in docs}
    assert got[2].band == "demanding" and all(got[i].grade is not None for i in (1, 2, 3, 4)) and got[5].grade is None
    assert {r.source: r.n_docs for r in queries.p9_profile(spark, str(tmp_path)).collect()} == {"a": 2, "b": 3}
    assert rows(queries.p9_found(spark, str(tmp_path))) == [(1,)]
