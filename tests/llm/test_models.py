"""Quality and toxicity classifiers: held-out accuracy, odd inputs."""

import numpy as np

from leadforge.llm import quality, toxicity

from .conftest import ODD, prose


def labelled(n=400):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = prose(i, 60 + i % 50)
        if bad:
            text = " ".join(w.upper() + "$$$" for w in text.split()) * 2
        if toxic:
            text = text.replace("garden", "scumbag").replace("winter", "scumlike") + " scumbag"
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic), "x"))
    return rows, labels


def tables(spark, docs_of, extra=()):
    rows, labels = labelled()
    y = spark.createDataFrame([*labels, (None, 1, 0, "x"), (9999, 1, 1, "x"), (0, None, None, "x"), labels[3]],
                              "doc_id bigint, quality int, toxic int, text string")
    return docs_of([*rows, *extra]), y, {i: (q, t) for i, q, t, _ in labels}


def check(result, truth, column, remainder_ok):
    rows = result.collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    right = np.mean([r["predicted"] == truth[r["doc_id"]][column] for r in held])
    assert right >= remainder_ok, right
    return rows


def test_quality_held_out(spark, docs_of):
    docs, labels, truth = tables(spark, docs_of, [(i + 5000 if i else None, t) for i, t in ODD])
    rows = check(quality.quality(docs, labels), truth, 0, 0.95)
    assert len(rows) == 400 + len(ODD)


def test_toxicity_held_out(spark, docs_of):
    docs, labels, truth = tables(spark, docs_of, [(i + 5000 if i else None, t) for i, t in ODD])
    rows = check(toxicity.toxicity(docs, labels), truth, 1, 0.93)
    assert len(rows) == 400 + len(ODD)
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    assert sum(truth[i][1] for i in left if i in truth) <= 8 and sum(1 for i in truth if not truth[i][1] and i in left) >= 300


def test_without_labels(spark, docs_of, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = docs_of(ODD)
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}
    assert not any(r["rejected"] for r in toxicity.toxicity(docs, none).collect())
    assert quality.quality(empty, none).count() == toxicity.toxicity(empty, none).count() == 0


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = rng.integers(1, 6, 12).astype(float)
        s = np.array([rng.integers(0, k + 1) for k in n], dtype=float)
        fit = quality.isotonic(n, s)
        mean = s / n
        # the min-max formula of isotonic regression
        want = [max(min((s[a:b + 1].sum() / n[a:b + 1].sum()) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, want) and len(mean) == 12


def test_filters_are_max_pooled_within_their_text():
    model = toxicity.constant_model(0.5)
    model.word = np.zeros_like(model.word)
    model.word[1], model.word[2] = 1, 2
    for k, tap in enumerate(model.taps):
        tap[:, :toxicity.DIM] = 0.25
    a = np.array([1, 2, 2, 0, 1], np.int32)
    first = np.array([0, 2, 2, 5])
    got = model.pooled(a, np.zeros(5, np.int32), first)
    assert np.allclose(got[:, 0], [2, 0, 2]) and np.allclose(got[:, 6], [3, 0, 2]) and np.allclose(got[:, 12], [0, 0, 3])
