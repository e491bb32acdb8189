import json
import math

import pandas as pd
from pyspark.sql import functions as F

from conftest import one
from leadforge.operators import evaluate as ev
from leadforge.operators import nb
from leadforge.sources import model_store

TRAIN = [
    (1, "Richiesta preventivo urgente per impianto fotovoltaico, grazie"),
    (1, "Vorremmo una quotazione per la fornitura di pannelli"),
    (1, "Buongiorno, potete inviarci un preventivo dettagliato?"),
    (0, "Newsletter di ottobre: novita e eventi"),
    (0, "Conferma ricezione fattura numero 42"),
    (0, "Aggiornamento password del portale clienti"),
]


def test_tokens_and_bigrams(spark):
    t = one(spark, F.array_join(nb.ml_tokens(F.col("x")), "|"), x="I'm asking for THE price of solar-panels, okay?")
    assert t == "asking|price|solar|panels|okay"
    b = one(spark, F.array_join(nb.bigrams(nb.ml_tokens(F.col("x"))), "|"), x="alpha beta gamma")
    assert b == "alpha beta|beta gamma"
    assert one(spark, F.size(nb.bigrams(nb.ml_tokens(F.col("x")))), x="alpha") == 0


def test_features(spark):
    f = one(spark, nb.text_features(F.col("x")), x="Hello, urgent?\nTel 02 5551234\n\n")
    assert f["urgency_score"] == 1 / 3 and f["has_greeting"] == 1.0 and f["has_contact_info"] == 1.0
    assert f["question_density"] == 1.0 and f["length_score"] == 5 / 200
    assert f["signature_score"] == 0.5  # 2 non-blank lines in the window, 1 with an indicator
    legacy = one(spark, nb.text_features(F.col("x"), legacy_train=True), x="Hello, urgent?\nTel 02 5551234\n\n")
    assert legacy["signature_score"] == 1 / 5


def _python_nb(train, text):
    """Brute-force reference: the two-class model written out in plain Python."""
    import re
    from leadforge.functions.lexicon import ml_stopwords
    stop = set(ml_stopwords())
    tok = lambda s: [t for t in re.findall(r"[\w']+", s.lower()) if len(t) > 2 and t not in stop]
    big = lambda ts: [" ".join(ts[i:i + 2]) for i in range(len(ts) - 1)]
    cnt = {1: {}, 0: {}}
    bcnt = {1: {}, 0: {}}
    for y, s in train:
        ts = tok(s)
        for t in ts:
            cnt[y][t] = cnt[y].get(t, 0) + 1
        for b in big(ts):
            bcnt[y][b] = bcnt[y].get(b, 0) + 1
    V = len(set(cnt[1]) | set(cnt[0]))
    N = {y: sum(cnt[y].values()) for y in (0, 1)}
    prior = {1: sum(1 for y, _ in train if y == 1) / len(train)}
    prior[0] = 1 - prior[1]
    ts = tok(text)
    if not ts:
        return 0.0
    lp = {y: math.log(prior[y]) + sum(math.log((cnt[y].get(t, 0) + 1) / (N[y] + V)) for t in ts)
          + sum(0.5 * math.log((bcnt[y].get(b, 0) + 1) / (N[y] + V)) for b in big(ts)) for y in (0, 1)}
    return 1 / (1 + math.exp(lp[0] - lp[1]))


def test_nb_matches_brute_force(spark):
    train = spark.createDataFrame(TRAIN, "label int, text string")
    model = nb.train_nb(train, use_features=False)
    docs = spark.createDataFrame([(1, "preventivo per pannelli fotovoltaici"), (2, "fattura del portale"), (3, "ok")],
                                 "id long, text string")
    got = {r["id"]: r["nb_score"] for r in nb.nb_score(docs, model, "id", "text").collect()}
    for i, text in [(1, "preventivo per pannelli fotovoltaici"), (2, "fattura del portale"), (3, "ok")]:
        assert abs(got[i] - _python_nb(TRAIN, text)) < 1e-9
    assert got[3] == 0.0


def test_model_roundtrip_and_legacy_import(spark, tmp_path):
    train = spark.createDataFrame(TRAIN, "label int, text string")
    model = nb.train_nb(train)
    model_store.save_model(spark, model, str(tmp_path / "m"), threshold=0.0)
    back = model_store.load_model(spark, str(tmp_path / "m"))
    assert back.vocabulary_size == model.vocabulary_size and back.threshold == 0.0
    doc = {"version": 2, "class_priors": {"1": 0.5, "0": 0.5},
           "token_counts": {"1": {"preventivo": 3, "prezzo": 2}, "0": {"fattura": 4}},
           "total_tokens": {"1": 5, "0": 4}, "vocabulary_size": 3,
           "bigram_counts": {"1": {"preventivo prezzo": 1}, "0": {}},
           "feature_weights": {"has_greeting": 0.4}}
    (tmp_path / "legacy.json").write_text(json.dumps(doc))
    legacy = model_store.import_legacy_json(spark, str(tmp_path / "legacy.json"))
    assert legacy.vocabulary_size == 3 and legacy.terms.count() == 4
    docs = spark.createDataFrame([(1, "Buongiorno, preventivo prezzo"), (2, "fattura")], "id long, text string")
    scores = {r["id"]: r["nb_score"] for r in nb.nb_score(docs, legacy, "id", "text").collect()}
    assert all(0.0 <= v <= 1.0 for v in scores.values()) and scores[1] > 0.5 > scores[2]


def _brute_roc(labels, scores):
    pairs = sorted(zip(scores, labels), key=lambda p: -p[0])
    P = sum(labels)
    N = len(labels) - P
    pts = [(0.0, 0.0)]
    for s in sorted(set(scores), reverse=True):
        tp = sum(1 for sc, y in pairs if sc >= s and y == 1)
        fp = sum(1 for sc, y in pairs if sc >= s and y != 1)
        pts.append((fp / N, tp / P))
    auc = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    return pts, auc


def test_curves_with_ties_match_brute_force(spark):
    labels = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1]
    scores = [0.9, 0.9, 0.8, 0.7, 0.7, 0.5, 0.5, 0.4, 0.3, 0.3, 0.1, 0.9]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    roc = ev.roc_curve(df).orderBy("point").collect()
    pts, auc = _brute_roc(labels, scores)
    assert [(round(r["fpr"], 12), round(r["tpr"], 12)) for r in roc] == [(round(a, 12), round(b, 12)) for a, b in pts]
    assert roc[0]["threshold"] == 1.9
    assert abs(ev.roc_auc(ev.roc_curve(df)).first()["roc_auc"] - auc) < 1e-12
    pr = ev.pr_curve(df).orderBy("point").collect()
    assert (pr[0]["precision"], pr[0]["recall"]) == (1.0, 0.0) and pr[-1]["recall"] == 1.0
    cm = ev.confusion(df).first()
    assert (cm["tp"], cm["fp"], cm["tn"], cm["fn"]) == (5, 3, 3, 1)


def test_split_sizes(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(50)]
    s = ev.stratified_split(spark.createDataFrame(rows, "id long, label int"), test_size=0.25).toPandas()
    for lab, g in s.groupby("label"):
        n = len(g)
        assert g["is_train"].sum() == max(1, int(n * 0.75))
        assert sorted(g["split_rank"]) == list(range(1, n + 1))
    one_row = ev.stratified_split(spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id long, label int")).toPandas()
    pos = one_row[one_row["label"] == 1].iloc[0]
    assert bool(pos["is_train"]) and bool(pos["is_test"])  # a group of one is reused for testing


def test_ordered_running_matches_pandas(spark):
    from leadforge.functions.ranking import ordered_running
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "b", "c"]), float(rnd.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = ordered_running(df, ["k"], ["v"], group_cols=["g"], partitions=5).toPandas().sort_values(["g", "k"])
    want = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values(["g", "k"])
    want["rank"] = want.groupby("g").cumcount() + 1
    want["cum_v"] = want.groupby("g")["v"].cumsum()
    assert list(got["rank"]) == list(want["rank"]) and list(got["cum_v"]) == list(want["cum_v"])


def test_ordered_running_on_a_large_input(spark):
    """200,000 rows over 16 input partitions with a payload column that one branch prunes."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from leadforge.functions.ranking import ordered_running

    n = 200_000
    df = spark.range(n, numPartitions=16).select(
        ((F.col("id") * 7919) % n).alias("seq"), (F.col("id") % 5).cast("double").alias("v"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = ordered_running(df, ["seq"], ["v"], rank_col="position")
    want = df.select("seq", F.row_number().over(Window.orderBy("seq")).alias("w_position"),
                     F.sum("v").over(Window.orderBy("seq")).alias("w_cum"))
    wrong = got.join(want, "seq").filter((F.col("position") != F.col("w_position")) | (F.col("cum_v") != F.col("w_cum"))
                                         | (F.col("group_rows") != n) | (F.col("total_v") != 2.0 * n))
    assert got.count() == n and wrong.count() == 0


def test_a_model_above_the_broadcast_budget_is_joined_without_a_sort(spark):
    train = spark.createDataFrame(TRAIN, "label int, text string").withColumn("id", F.monotonically_increasing_id())
    model = nb.train_nb(train)
    small = {r["id"]: r["nb_score"] for r in nb.nb_score(train, model, "id", "text").collect()}

    def plan_and_scores(n_bytes):
        model.term_bytes = n_bytes
        s = nb.nb_score(train, model, "id", "text")
        return s._jdf.queryExecution().executedPlan().toString(), {r["id"]: r["nb_score"] for r in s.collect()}
    middle, scores = plan_and_scores(1 << 28)
    assert "ShuffledHashJoin" in middle and "SortMergeJoin" not in middle
    huge, same = plan_and_scores(1 << 50)
    assert "SortMergeJoin" in huge
    for i, s in small.items():
        assert abs(scores[i] - s) < 1e-12 and abs(same[i] - s) < 1e-12


def test_tfidf_of_repeated_ids_and_its_shuffles(spark):
    """F16: rows with one id are one document; terms are shuffled by term and by id, texts by id."""
    import math
    from collections import Counter

    from leadforge.operators import features as fx
    texts = [(1, "gatto nero gatto"), (1, "nero lupo"), (2, "gatto nero"), (3, ""), (4, None), (5, "lupo lupo lupo")]
    got = fx.tfidf_weights(spark.createDataFrame(texts, "id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    tf = {}
    for i, t in texts:
        words = (t or "").split()
        tf.setdefault(i, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(term for c in tf.values() for term in c)
    want = {}
    for i, c in tf.items():
        raw = {t: k * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want.update({(i, t): round(x / norm, 9) for t, x in raw.items()})
    assert {(r["id"], r["term"]): round(r["weight"], 9) for r in got.collect()} == want


def test_legacy_documents_plain_and_odd(spark):
    """plain documents never reach Spark's JSON parser; odd ones mean what it says."""
    from leadforge.sources import model_store
    docs = [
        ('{"version":2,"token_counts":{"1":{"lupo":2,"gatto":1},"0":{"lupo":3}},"bigram_counts":{"0":{"lupo nero":1}}}',
         [("bi", "lupo nero", 0, 1), ("uni", "gatto", 1, 0), ("uni", "lupo", 2, 3)]),
        ('{"token_counts":{"2":{"z":1},"1":{"a":1,"a":2}},"bigram_counts":null}', [("uni", "a", 3, 0)]),
        ('{"token_counts":{}}', []), (None, [])]
    odd = [
        ("{'token_counts':{'1':{'a':1}}}", [("uni", "a", 1, 0)]), ('{"token_counts":{"1":{"a":1}}} tail', [("uni", "a", 1, 0)]),
        ('{"token_counts":{"1":{"a":1.5}}}', []), ('{"token_counts":{"1":{"a":null}}}', [("uni", "a", None, 0)]),
        ('{"token_counts":{"1":{"a":1}},"token_counts":{"1":{"b":1}}}', [("uni", "b", 1, 0)]),
        ('{"token_counts":{"1":{"a":99999999999999999999}}}', []), ('[1]', []), ('{"token_counts":{"1":{"a":1}}', []),
        ('{"token_counts":[1],"bigram_counts":{"0":{"a b":3}}}', [("bi", "a b", 0, 3)])]
    assert all(model_store.plain_entries(text) is not None for text, _ in docs)
    assert all(model_store.plain_entries(text) is None for text, _ in odd)
    given = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(docs + odd)], "model long, value string")
    rows = model_store.legacy_terms(given).collect()
    for i, (text, want) in enumerate(docs + odd):
        assert sorted(tuple(r)[1:] for r in rows if r["model"] == i) == want, text


def test_slices_and_frequent_terms_give_the_same_scores(spark, monkeypatch):
    """Against a large model, messages are scored slice by slice and nothing of a slice stays shuffled;
    the most frequent terms are valued beside the text, the others by the join."""
    texts = [t for _, t in TRAIN] + ["preventivo preventivo per pannelli", "mai visto", "ok", "", None, "Fattura\tdel portale"]
    docs = spark.createDataFrame([(i, f"k{i % 3}", t) for i, t in enumerate(texts)], "id long, extra string, text string")
    model = nb.train_nb(spark.createDataFrame(TRAIN + [(1, "preventivo per pannelli")], "label int, text string"))
    want = {r["id"]: r["nb_score"] for r in nb.nb_score(docs, model, "id", "text").collect()}
    model.term_bytes = 1 << 28
    for frequent in (0, 3, 100_000):
        monkeypatch.setattr(nb, "FREQUENT", frequent)
        monkeypatch.setattr(nb, "SLICE_BYTES", 0)
        s = nb.nb_score(docs, model, "id", "text", carry=["extra"])
        assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r for r in s.collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert abs(r["nb_score"] - want[i]) < 1e-12 and r["extra"] == f"k{i % 3}"


def test_odd_model_terms_meet_no_other_kind(spark):
    """A word with a space or a bigram without one, as an imported document may hold them, meets no term of a text."""
    terms = spark.createDataFrame([("uni", "lupo", 3, 0), ("uni", "lupo nero", 50, 0), ("bi", "nero", 0, 50), ("bi", " 1", 9, 0),
                                   ("bi", "lupo nero", 0, 1)], "kind string, term string, n_pos long, n_neg long")
    model = nb.NBModel(terms, 0.5, 0.5, 53, 0, 2, use_features=False, term_bytes=500)
    docs = spark.createDataFrame([(1, "lupo nero")], "id long, text string")
    odds = math.log(4) - 0.5 * math.log(2) - 2.5 * (math.log(55) - math.log(2))
    assert abs(nb.nb_score(docs, model, "id", "text").first()["nb_score"] - 1 / (1 + math.exp(-odds))) < 1e-12
