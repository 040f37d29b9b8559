"""Rejection is calibrated on all labelled rows that the model was not fitted on."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm import langid

WORDS = {"a": "tree house river stone bread water light", "b": "arbol casa pueblo piedra camino agua fuego", "c": "wald haus brot licht strasse berg feuer"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        lang = "abc"[int(rng.integers(0, 3))]
        words = WORDS[lang].split() + (["zug", "lumen"] if i % 9 == 0 else [])
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(1, 30)))), lang))
    rows += [(1000, "", "a"), (1001, None, "b"), (1002, "123 456", "c")]
    return spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)


def plain(model, rows, alpha, pieces=3):
    """All rows in one place."""
    parts = [(name, i == 0, p) for text, name in rows for i, p in enumerate(langid.pieces_of((text or "").encode(), pieces)) if langid._letters(p) and name in model.languages]
    label, whole = np.array([model.languages.index(p[0]) for p in parts]), np.array([p[1] for p in parts])
    raw, usual, n = model.scores([p[2] for p in parts])
    raw, n = raw.astype(np.float32).astype(float), np.maximum(1, n)
    best = raw.argmax(axis=1)
    temperature = min(langid.TEMPERATURES, key=lambda t: -np.log(langid.softmax(raw / t)[np.arange(len(label)), label] + 1e-12).mean())
    k = len(model.languages)
    centre, spread, noise = np.full(k, usual.mean()), np.full(k, usual.var() + 1e-9), np.zeros(k)
    for i in range(k):
        own = usual[best == i]
        if len(own) > 1:
            centre[i] = np.median(own)
            square = np.minimum((own - centre[i]) ** 2, 9 * ((own - centre[i]) ** 2).mean())
            spread[i], noise[i] = np.maximum(np.linalg.lstsq(np.column_stack((np.ones(len(own)), 1 / n[best == i])), square, rcond=None)[0], [1e-4, 0])
    out = replace(model, temperature=temperature, centre=centre, spread=spread, noise=noise)
    cut = lambda v: np.sort(v)[int(alpha * len(v))]
    return replace(out, least_score=cut(langid.softmax(raw / temperature).max(axis=1)[whole]), least_usual=cut(out.unusual(best, usual, n)))


def test_every_row_the_fit_did_not_see_is_calibrated_on(spark, labelled):
    counts = langid.language_counts(labelled)
    fit_on, check_on = langid.samples(labelled, counts, 30)
    # No bound on the rows that are checked.
    assert fit_on.count() + check_on.count() == labelled.count() and check_on.count() > 700
    assert langid.samples(labelled, {x: 10_000_000 for x in counts}, 600)[1].count() > 890


@pytest.mark.parametrize("direct", [None, 50])
def test_calibration_equals_that_of_all_rows_in_one_place(spark, labelled, monkeypatch, direct):
    if direct:
        monkeypatch.setattr(langid.R, "DIRECT_VALUES", direct)
    fit_on, check_on = langid.samples(labelled, langid.language_counts(labelled), 60)
    model = langid.fitted(langid.example_features(fit_on))
    got = langid.calibrated(model, check_on, 0.01)
    want = plain(model, [(r.text, r.lang) for r in check_on.collect()], 0.01)
    assert got.temperature == pytest.approx(want.temperature)
    for name in ("centre", "spread", "noise", "least_score", "least_usual"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-7, atol=1e-9), name


def test_calibration_without_rows_or_known_languages(spark, labelled):
    model = langid.fitted(langid.example_features(langid.samples(labelled, langid.language_counts(labelled), 60)[0]))
    assert langid.calibrated(model, labelled.select("text", "lang").limit(0)) is model
    assert langid.calibrated(model, labelled.select("text", F.lit("x").alias("lang"))) is model
