"""Plans and results of what a scan and a sweep are made of."""

import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from quillmark import catalog
from quillmark.functions import features, prefix
from quillmark.functions import text as T
from quillmark.operators import metrics, segments

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_filter_writes_a_scorer_out(spark):
    """A filter that Spark infers and pushes below an aggregation may hold a column's whole expression many times over."""
    fitted = {"gbt", "calibrated_gbt", "feature_importances", "isotonic", "text_model", "select_by_short_auc", "linear_probe"}
    long = {}
    for name, query in catalog.QUERIES.items():
        if name not in fitted:
            plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
            worst = max([len(line) for line in plan.splitlines() if re.search(r"[+:\- ]*Filter ", line)] or [0])
            if worst > 3000:
                long[name] = worst
    assert not long


def test_scan_reads_and_shuffles_a_text_once(spark):
    plan = executed(catalog.QUERIES["document_scan"](spark, SF))
    shuffles = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
    assert len([line for line in plan.splitlines() if "Scan parquet" in line]) == 1
    assert len([line for line in shuffles if "doc_id" in line]) == 1 and len(shuffles) == 2  # the other one sums by language and label


@pytest.mark.parametrize("name", ["glue_stats", "map_glued"])
def test_glue_reads_one_scan(spark, name):
    plan = executed(catalog.QUERIES[name](spark, SF))
    assert len(re.findall(r"Scan parquet[^\n]*text", plan)) == 1


@pytest.mark.parametrize("name", ["report_markdown", "report_html"])
def test_reports_take_their_parts_from_a_finished_scan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "ArrowEvalPython" in plan and plan.count("ArrowEvalPython") == 1  # fragments alone are scored


def test_language_model_shuffles_texts_for_pairs_and_sums_alone(spark):
    """Words find the one before them inside their row, and tables of words go to the tasks."""
    plan = executed(catalog.QUERIES["lm_features"](spark, SF))
    shuffles = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line) and "doc_id" in line]
    assert len(shuffles) <= 2 and "Window" not in plan


def test_features_are_taken_in_one_pass(spark):
    """One Arrow pass a text, no set of words for each window; values as in the plain definition."""
    rng = random.Random(7)
    texts = [None, "", "One two. Three", *[" ".join(rng.choice(["the", "and", "End.", "a-b", "x", "né?!", "of", "in", "3"]) for _ in range(n)) for n in (1, 19, 20, 21, 60, 300)]]
    df = features.with_features(docs(spark, *texts))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_distinct" not in plan
    for row in df.collect():
        words = [w for w in re.findall(r"[\w-]+", (row.text or "").lower()) if w.isalpha()]
        wins = [words[i : i + 20] for i in range(len(words) - 19)] or ([words] if words else [])
        want = sum(len(set(w)) / len(w) for w in wins) / max(len(wins), 1)
        assert abs(row.mattr - want) < 1e-9


def test_sweep_scores_once(spark):
    plan = executed(catalog.QUERIES["length_sweep"](spark, SF))
    assert len(re.findall(r"Scan parquet[^\n]*text", plan)) == 1


TEXTS = [
    None, "", "   ", "...", "one", "One two. Three", "well-known facts-of-life. so it is -odd- and_ 3d x9 12 a1-b2", "a.b c!? d... e", "The the THE. And that! With of the in the — «x»",
    "é ÉÉ ß. Größe und so", "no-break " * 12, "word-" * 15 + "end. tail",
]


def test_prefix_features_are_those_of_cut_texts(spark):
    rng = random.Random(3)
    pieces = ["the", "and", "That", "with-out", "x", "of the", "end.", "really?!", "3", "a-b-c", "né", "(so)", "wait...", "—", "foo_bar"]
    rows = docs(spark, *TEXTS, *[" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 90))) for _ in range(60)])
    lengths = (60, 33, 20, 3, 2, 1)
    got = prefix.with_prefixes(rows, lengths)
    cut = rows.select("doc_id", F.explode(F.array(*map(F.lit, lengths))).alias("n"), "text").withColumn("text", T.truncate_words(F.coalesce("text", F.lit("")), F.col("n")))
    want = features.with_features(cut).select(*got.columns)
    near = lambda df: sorted(tuple(round(v, 9) for v in row) for row in df.collect())
    assert near(got) == near(want)


@pytest.mark.parametrize("n", [1, 3, 20, 500])
def test_cut_by_one_match_is_the_cut_by_sums(spark, n):
    rows = docs(spark, *TEXTS, "w " * 499, "w " * 500 + "...", "w " * 501)
    both = rows.select(T.truncate_words(F.col("text"), n).alias("a"), T.truncate_words(F.col("text"), F.lit(n)).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]


def test_quantiles(spark):
    rng = random.Random(5)
    values = {k: [round(rng.random() ** 3 * 2 - 0.5, 6) for _ in range(n)] for k, n in (("x", 1), ("y", 2), ("z", 4000))}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, p double")
    at = (0.0, 0.1, 0.5, 0.975, 1.0)
    got = {(r.k, r.q): r.p for r in metrics.quantiles(rows.groupBy("k", "p").agg(F.count("*").alias("c")), at, ("k",), weight=F.col("c")).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        for q in at:
            r = q * (len(vs) - 1)
            low = vs[int(r)]
            assert abs(got[k, q] - (low + (vs[min(int(r) + 1, len(vs) - 1)] - low) * (r - int(r)))) < 1e-9
    assert metrics.quantiles(rows.where("false").groupBy("k", "p").agg(F.count("*").alias("c")), at, weight=F.col("c")).count() == 0
    whole = metrics.quantiles(rows.groupBy("p").agg(F.count("*").alias("c")), (0.5,), weight=F.col("c")).first()
    assert abs(whole.p - statistics.median(v for vs in values.values() for v in vs)) < 1e-9


def test_windows_and_scores_of_a_long_text_in_linear_time(spark):
    took = []
    for n in (125_000, 1_000_000):
        text = "\n\n".join(" ".join(f"w{i}" for i in range(k, k + 100)) + "." for k in range(0, n, 100))
        rows = segments.split_paragraphs(docs(spark, text)).cache()
        rows.count()
        began = time.time()
        wins = segments.build_windows(rows).agg(F.count("*"), F.max("cend")).first()
        assert tuple(wins) == (n // 75 - 1 + (n % 75 > 0), len(text) - 1)
        scored = segments.score_paragraphs(rows)
        assert scored.where("p_a is not null").count() == n // 100
        took.append(time.time() - began)
    assert took[1] < 20 * took[0]


def test_scores_do_not_depend_on_odd_paragraphs(spark):
    """Texts without words, one short paragraph, and service paragraphs between content."""
    long = "Many words stand here and more of them follow. " * 20
    rows = segments.split_paragraphs(docs(spark, "...\n\n!!!", "short", f"{long}\n\n...\n\n{long}"))
    got = {(r.doc_id, r.idx): (r.covered_chars, r.p_a is None) for r in segments.score_paragraphs(rows).collect()}
    assert got == {(0, 0): (0, True), (0, 1): (0, True), (1, 0): (5, True), (2, 0): (len(long) - 1, False), (2, 1): (3, True), (2, 2): (len(long) - 2, False)}
    kinds = rows.withColumn("kind", F.when((F.col("doc_id") == 2) & (F.col("idx") == 0), "service").otherwise("content"))
    served = {(r.doc_id, r.idx): r.covered_chars for r in segments.score_paragraphs(kinds).collect()}
    assert served[2, 0] == 0 and served[2, 2] > 900
    sizes = segments.score_paragraphs(rows, sizes=((150, 75), (75, 25))).groupBy("size").count().collect()
    assert {(r["size"], r["count"]) for r in sizes} == {(150, 6), (75, 6)}
