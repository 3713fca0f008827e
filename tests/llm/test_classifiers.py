import collections
import os
import zlib

import numpy as np
import pytest
from tables import docs, tuples

from examlens.llm import language, quality, toxicity

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def data(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double")


def truth(data, column):
    return {r.doc_id: r[column] for r in data["labels"].collect()}


def test_quality_on_held_out_rows(spark, data):
    model = quality.learn(data["documents"], data["labels"])
    got = quality.scored(data["documents"], model).collect()
    want = truth(data, "quality")
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(got) == data["documents"].count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    again = quality.learn(data["documents"], data["labels"])
    assert np.array_equal(again.weights, model.weights) and again.shift == model.shift
    kept = quality.accepted(data["documents"], model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_awkward(spark):
    d = docs(spark)
    model = quality.learn(d, labels(spark, [(5, 1, 0, "x", 0.0), (8, 0, 0, "x", 0.0), (4, 0, 0, "x", 0.0), (None, 1, 1, "x", 0.0), (9, None, None, "x", 0.0)]))
    got = quality.scored(d, model).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (3, 4, 6)}) == 1
    empty = quality.learn(d, labels(spark, []))
    assert {r.score for r in quality.scored(d, empty).collect()} == {0.5}
    assert quality.scored(docs(spark, []), model).count() == 0
    assert quality.accepted(d, empty).columns == d.columns


def test_ftrl_against_a_plain_loop():
    spec = quality.QualitySpec(bits=6, epochs=1)
    rng = np.random.default_rng(0)
    data = [(np.sort(rng.choice(64, 5, replace=False)), np.full(5, 0.2), int(k % 3 == 0)) for k in range(40)]
    model = quality.QualityModel(spec).fit(data)
    z, n = [0.0] * 65, [0.0] * 65

    def w(i):
        l1 = 0.0 if i == 64 else spec.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((spec.beta + n[i] ** 0.5) / spec.alpha + spec.l2)

    for k in np.random.default_rng(1).permutation(40):
        at, x, y = data[k]
        x = {**{int(i): float(v) * spec.scale for i, v in zip(at, x)}, 64: 1.0}
        now = {i: w(i) for i in x}
        p = 1 / (1 + np.exp(-sum(now[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / spec.alpha * now[i]
            n[i] += g * g
    assert np.allclose(model.weights, [w(i) for i in range(64)]) and np.isclose(model.shift, w(64))


def test_language_on_held_out_rows(spark, data):
    got = language.identify(data["documents"], language.learn(data["documents"])).collect()
    want = {r.doc_id: r.lang for r in data["documents"].select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out and want[r.doc_id]]
    assert len(got) == len(want) and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(spark):
    d = docs(spark)
    got = language.identify(d, language.learn(d)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 11 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 6))
    assert by[1].lang_pred == "en"
    nothing = language.learn(docs(spark, []))
    assert {r.lang_pred for r in language.identify(d, nothing).collect()} == {"und"}
    assert language.identify(docs(spark, []), nothing).count() == 0
    only = language.learn(docs(spark, [(1, "some english", "en", "a", 0), (3, "12 34", "xx", "a", 0)]))
    assert only.predict("anything") == ("en", 1.0) and only.predict("12 !") == ("und", 0.0)


def test_families_come_first():
    spec = language.LanguageSpec(dims=512, rounds=200)
    texts = {"en": "the quick and the slow", "de": "der schnelle und der langsame", "fr": "le rapide et la lente", "es": "el rápido y la lenta", "zz": "qqq xxq zzq"}
    x = np.array([language.grams(t, 512) for t in texts.values() for _ in range(3)])
    model = language.LanguageModel(x, np.array([k for k in texts for _ in range(3)], dtype=object), spec)
    assert set(model.families) == {"germanic", "romance", "zz"} and ("de", "en") in model.duels and ("en", "fr") not in model.duels
    assert all(model.predict(t)[0] == k for k, t in texts.items())


def test_toxicity_on_held_out_rows(spark, data):
    model = toxicity.learn(data["documents"], data["labels"])
    got = toxicity.scored(data["documents"], model).collect()
    want = truth(data, "toxic")
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if not want[r.doc_id]]) < 0.02
    assert toxicity.learn(data["documents"], data["labels"]).lexicon == model.lexicon


def test_toxicity_awkward(spark):
    d = docs(spark)
    model = toxicity.learn(d, labels(spark, [(i, 0, int(i % 2), "x", 0.0) for i in range(1, 10)] + [(None, 1, 1, "x", 0.0), (1, None, None, "x", 0.0)]))
    got = toxicity.scored(d, model).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (3, 4, 6)}) == 1
    assert toxicity.scored(docs(spark, []), model).count() == 0
    assert toxicity.learn(d, labels(spark, [])).lexicon == {}


def test_folding_and_exceptions():
    spec = toxicity.ToxicitySpec(exceptions=("trash can", "pond scum"))
    model = toxicity.ToxicityModel(spec, {" idiot": 3.0, " trash ": 2.0, " scum": 2.0})
    for text in ("idiot", "IDIOT!", "1d10t", "іdіоt", "ïdíöt", "an idiotic one", "i​diot", "$cum", "tr@sh.", "scum$$$"):
        assert model.measures(text)[0] > 0, text
    for text in ("", None, "videot", "trashy", "the trash can", "pond scum", "101 45 7", "$$$ @@@"):
        assert model.measures(text) == (0.0, 0.0), text
    assert model.measures("trash in the trash can")[0] == pytest.approx(np.log1p(2.0))
    assert model.measures("idiot " + "word " * 99)[1] == pytest.approx(0.03)
    assert model.score("x") < 0.5


def test_exceptions_are_learned(spark):
    """A word that only toxic texts hold, but for one neighbour with which only clean texts have it."""
    rows = [(i, f"you are trash and text {i}", "en", "a", 0) for i in range(200)]
    rows += [(200 + i, f"a calm text number {i} about gardens", "en", "a", 0) for i in range(400)]
    rows += [(600 + i, f"put number {i} in the Trash c4n please", "en", "a", 0) for i in range(25)]
    known = labels(spark, [(i, 0, int(i < 200), "x", 0.0) for i in range(625)])
    model = toxicity.learn(docs(spark, rows), known)
    assert any(k.strip().startswith("tras") for k in model.lexicon)
    assert "trash can" in model.learned and not any("and" in p.split() or "are" in p.split() for p in model.learned)
    assert model.measures("the trash can") == (0.0, 0.0) and model.score("you are trash") > 0.5 > model.score("the trash can")
    assert model.measures("trash in the trash can")[0] > 0
    # As the plain rule has it, over the texts that were learned from.
    taught = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5}
    good, bad = collections.Counter(), collections.Counter()
    for d, text, *_ in rows:
        if d in taught:
            w = toxicity.fold(text).split()
            hit = [any(f" {x} ".startswith(k) for k in model.lexicon) for x in w]
            (bad if d < 200 else good).update({f"{w[i]} {w[i + 1]}" for i in range(len(w) - 1) if hit[i] or hit[i + 1]})
    n1 = sum(d < 200 for d in taught)
    odds = lambda p: np.log((good[p] + 0.5) / (len(taught) - n1 + 1)) - np.log((bad[p] + 0.5) / (n1 + 1))
    assert set(model.learned) == {p for p in good if good[p] >= 3 and odds(p) >= 1.5}


def test_many_exceptions_take_no_square():
    import time

    model = toxicity.ToxicityModel(toxicity.ToxicitySpec(exceptions=("trash can",)), {" idiot": 3.0, " trash ": 2.0})
    start = time.perf_counter()
    assert model.measures("idiot " * 50_000 + "trash can " * 50_000)[0] == pytest.approx(np.log1p(150_000.0))
    assert time.perf_counter() - start < 20


def test_lexicon_choice():
    spec = toxicity.ToxicitySpec()
    got = toxicity.choose([(" bad", 60, 0), (" badly ", 30, 0), (" the ", 90, 890), (" rare ", 2, 0), (" mild ", 20, 150)], 100, 900, spec)
    assert set(got) == {" bad"}
    assert tuples is not None


def test_no_letter_is_no_language():
    only = language.LanguageModel(np.ones((2, 512), np.float32), np.array(["en", "en"], dtype=object), language.LanguageSpec(dims=512))
    for text in ("½ ²", "12 ½ _", "¼", "--"):
        assert only.predict(text) == ("und", 0.0)
    assert only.predict("½ a")[0] == "en"


def test_folding_takes_one_pass():
    """Runs of signs of any length between letters, and no time in their square."""
    import time

    start = time.perf_counter()
    for n in (1, 2, 5, 1_000_000):
        assert toxicity.fold("a" + "1" * n + "b") == f" a{'i' * n}b "
    assert toxicity.fold("1" * 1_000_000) == "  " and toxicity.fold("a" + "$" * 1_000_000).split() == ["a"]
    assert time.perf_counter() - start < 20
    assert toxicity.fold("1diot tr4$h 21st @ss $$x 5") == " idiot trash st ass x "


def test_an_id_on_many_rows_is_learned_once(spark):
    """What comes to the driver is bounded by the sample, whatever is repeated."""
    many = spark.range(100_000).selectExpr("case when id < 60000 then 7 when id < 90000 then null else id end as doc_id", "concat('some words of text ', id % 50000) as text", "'en' as lang")
    known = spark.range(100_000).selectExpr("case when id < 60000 then 7 else id end as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    seen = []
    fit = quality.QualityModel.fit
    quality.QualityModel.fit = lambda self, examples: seen.append(len(examples)) or fit(self, examples[:50])
    try:
        quality.learn(many, known, quality.QualitySpec(sample=500, epochs=1))
    finally:
        quality.QualityModel.fit = fit
    assert 0 < seen[0] <= 800
    assert toxicity.learn(many, known, toxicity.ToxicitySpec(sample=300)) is not None
    model = language.learn(many, language.LanguageSpec(dims=512, sample=400, per_language=400, rounds=5))
    assert model.langs == ["en"]
