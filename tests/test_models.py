"""Trained models: held-out accuracy, calibration by hand, and small frames with nulls."""

import pytest
from pyspark.sql import functions as F

from quillmark import catalog
from quillmark.operators import metrics, models

SF = "/root/testdata/sf0.01"


def auc(rows):
    return metrics.roc_auc(rows.select("label", F.round("p", 6).alias("p"))).first().auc


def made(spark, n=400):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.rand(1) + F.col("id") % 2).alias("x"), F.rand(2).alias("noise"), (F.col("id") % 2).cast("int").alias("label"))


def test_boosted_trees_learn_and_take_nulls(spark):
    rows, columns = made(spark).persist(), ("x", "noise")
    model = models.fit_gbt(rows, columns, rounds=5)
    assert auc(models.score_gbt(rows, model, columns)) > 0.95
    odd = rows.select("doc_id", F.lit(None).cast("double").alias("x"), "noise", F.lit("kept").alias("features")).limit(2)
    found = models.score_gbt(odd, model, columns).collect()
    assert len(found) == 2 and all(0 <= r.p <= 1 and r.features == "kept" for r in found)


def test_folds_calibrate_and_importances_average(spark):
    rows, columns = made(spark).persist(), ("x", "noise")
    pairs = models.fit_calibrated_gbt(rows, columns=columns, folds=3, rounds=3)
    scored = models.score_calibrated_gbt(rows, pairs, columns)
    assert len(pairs) == 3 and auc(scored) > 0.95 and scored.columns == [*rows.columns, "p"]
    table = models.feature_importances(rows, pairs, columns).collect()
    assert table[0].feature == "x" and sum(r.importance for r in table) == pytest.approx(1)


def test_isotonic_pools_interpolates_and_clips(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.2, 0), (0.3, 0), (0.8, 1), (0.9, 1), (None, 1)], "p double, label int")
    at = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,), (0.5,), (0.8,), (1.0,)], "p double")
    found = [r.calibrated for r in models.calibrate(at, models.fit_isotonic(rows)).orderBy("p").collect()]
    assert found == pytest.approx([0, 0, 1 / 3, 1 / 3, 0.6, 1, 1])


def test_text_model_beats_chance_and_is_chosen(spark):
    words = lambda a, b: F.concat_ws(" ", *[F.when(F.rand(k) < 0.7, a).otherwise(b) for k in range(12)])
    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 2 == 1, words(F.lit("alpha"), F.lit("beta"))).otherwise(words(F.lit("beta"), F.lit("alpha"))).alias("text")).persist()
    model = models.fit_text_model(rows, size=1024, rounds=10)
    assert auc(model.score(rows)) > 0.8
    odd = spark.createDataFrame([(None,), ("",), ("one",), ("word " * 3000,)], "text string")
    assert all(0 <= r.p <= 1 for r in model.score(odd).collect())
    ranked = models.short_auc({"flat": lambda d: d.withColumn("p", F.lit(0.5)), "text": model.score}, rows, (5, 8)).collect()
    assert [r.model for r in ranked] == ["text", "flat"] and ranked[1].mean_auc == 0.5


def test_grams_are_found_once_and_as_by_expressions(spark, monkeypatch):
    """Fits and scores took the grams of whole texts seven times; arrays give the very slots that expressions and HashingTF give."""
    odd = ["", None, "One two, two-three; ONE two.", "Ünï cödé ß 12 a1 x_y", "Слова и СЛОВА.  Ещё", "line\u2028end \u0085 \t\r\n tab", "smile \U0001f600\U0001f600 end", "a", "ab", "word " * 700]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(odd * 3)], "doc_id long, text string, label int").repartition(2)
    monkeypatch.setattr(models, "HELD", 60)
    for size in (1 << 16, 1000):
        want = {r.doc_id: r._tf for r in models.gram_counts(rows, size).collect()}
        got = {r.doc_id: r._tf for r in models.gram_table(rows, ["doc_id", "label"], size).collect()}
        assert got == want and len(got) == 30
    taken, grams = [], models._grams
    monkeypatch.setattr(models, "_grams", lambda text: taken.append(text) or grams(text))
    model = models.fit_text_model(rows, size=1000, rounds=3)
    assert not taken
    by_text = {r.doc_id: r.p for r in model.score(rows).collect()}
    assert {r.doc_id: pytest.approx(r.p) for r in model.score_counted(models.gram_table(rows, ["doc_id"], 1000)).collect()} == by_text


def test_linear_probe_separates(spark):
    rows = made(spark).select("label", F.array(F.col("x").cast("float"), F.col("noise").cast("float")).alias("embedding"))
    odd = spark.createDataFrame([(1, None)], "label int, embedding array<float>")
    model = models.fit_linear_probe(rows.union(odd))
    assert auc(models.score_linear_probe(rows.union(odd), model)) > 0.95


def test_mean_pool_weighs_repeats_and_skips_unknown(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "?"), (2, "?"), (3, None)], "doc_id long, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("c", None)], "token string, vector array<float>")
    found = models.mean_pool(tokens, vectors).collect()
    assert [(r.doc_id, r.n_tokens, r.pooled) for r in found] == [(1, 3, [2.0, 1.0])]


def test_mean_pool_moves_a_vector_once_a_group_of_documents(spark, monkeypatch):
    """Each token of each document took its vector through a shuffle; ids that repeat count with each of their vectors."""
    rows = [(k, f"t{(k * i) % 7}") for k in range(40) for i in range(30)]
    tokens = spark.createDataFrame(rows, "doc_id long, token string").repartition(5)
    vectors = spark.createDataFrame([(f"t{k}", [float(k), 1.0]) for k in range(6)] + [("t1", [9.0, 2.0])], "token string, vector array<double>")
    monkeypatch.setattr(models, "POOLED", 50)
    monkeypatch.setattr(models, "COUNTED", 20)
    found = models.mean_pool(tokens, vectors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Summarizer" not in plan and "FlatMapCoGroupsInArrow" in plan
    met = {k: [(v.vector, 1) for d, t in rows if d == k for v in vectors.collect() if v.token == t] for k in range(8)}
    got = {r.doc_id: r for r in found.where("doc_id < 8").collect()}
    for k, each in met.items():
        assert got[k].n_tokens == len(each) and got[k].pooled == pytest.approx([sum(v[d] for v, _ in each) / len(each) for d in (0, 1)])


def test_registry(spark):
    constant = models.Scorer("constant", lambda d: d.withColumn("p", F.lit(0.9)))
    try:
        models.register_scorer(constant)
        rows = spark.createDataFrame([("some text",), (None,)], "text string")
        assert [(r.threshold, r.verdict) for r in models.detect(rows, "constant").collect()] == [(0.86, True)] * 2
        assert models.get_scorer().name == "a"
        with pytest.raises(KeyError):
            models.get_scorer("missing")
    finally:
        models.SCORERS.pop("constant", None)


@pytest.mark.parametrize("name,least", [("gbt", 0.8), ("text_model", 0.8)])
def test_held_out_accuracy(spark, name, least):
    assert auc(catalog.QUERIES[name](spark, SF)) > least
