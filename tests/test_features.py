"""Words, blanks and features at the edges that plain texts don't have."""

from pyspark.sql import functions as F

from quillmark.functions import features
from quillmark.functions import text as T
from quillmark.operators import corpus, models


def test_blanks_before_a_line_separator_at_the_end_stay(spark):
    """Only blanks at the very ends go, as in SQL; a separator that is no blank ends the text."""
    row = spark.createDataFrame([("\t a b \u2028",)], "x string").select(T.strip(F.col("x"))).first()[0]
    assert row == "a b \u2028"


def test_features_in_a_pass_match_the_built_in_ones(spark):
    """Texts of Latin-1 and others, with repeats within and beyond a window, marks inside words and runs of marks."""
    texts = ["", "...", "A b. C-d e_f 3.14 g?! h!\x0bi", " ".join("abcde"[i % 5] for i in range(90)), " ".join(f"w{'x' * (i % 23)} y" for i in range(60)), "Слово раз. Слово два!.. и three", "Größe é. ßa x", "the and that " * 40 + "ж"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    names = ["n_chars", "n_words", *features.FEATURES]
    found = [{r.k: tuple(round(r[c], 9) for c in names) for r in df.collect()} for df in (features.with_features(rows), features.with_built_in_features(rows))]
    assert found[0] == found[1]
    assert features._measures(texts, features.PHRASES, 20).to_pylist() == [features._measures([x], features.PHRASES, 20).to_pylist()[0] for x in texts]


def test_a_phrase_is_looked_for_before_it_is_replaced(spark):
    """Sentences without a plain phrase are left at once; a phrase that is a pattern is still matched as one."""
    rows = spark.createDataFrame([("The dog and the cat",), ("the end",), ("theatre",), ("a cot, a cut",)], "s string")
    edit = T.perturb_phrase(F.col("s"), 7, 0, "the", "this", 1.1)
    assert [r[0] for r in rows.select(edit).collect()] == ["This dog and this cat", "this end", "theatre", "a cot, a cut"]
    assert "contains" in str(edit).lower()
    assert [r[0] for r in rows.select(T.perturb_phrase(F.col("s"), 7, 0, "c.t", "x", 1.1)).collect()] == ["The dog and the x", "the end", "theatre", "a x, a x"]


def test_linear_scorers_share_a_pass(spark):
    """Detection by two linear scorers reads the rows and takes the features once, with the rows of detection by each."""
    rows = spark.createDataFrame([(1, "One, two. Three!"), (2, None), (3, "the and that " * 30)], "doc_id int, text string")
    found = models.detect_each(rows, ("default", "b"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("LogicalRDD") == 1
    columns = ["doc_id", "p", "n_words", "threshold", "verdict"]
    alone = sorted((s, *r) for s in ("a", "b") for r in models.detect(rows, s).select(*columns).collect())
    assert sorted((r["scorer"], *[r[c] for c in columns]) for r in found.collect()) == alone


def test_assembled_documents_take_texts_after_ranks(spark):
    """Ranks come from digests alone, as from texts; a row that is there twice fills two slots, and none is lost or doubled."""
    rows = spark.createDataFrame([(1, "aa", 0), (1, "aa", 0), (2, "bb", 0), (3, "bb", 0), (4, "cc", 1), (5, "dd", 1)], "doc_id long, text string, label int")
    keyed = rows.select("doc_id", "label", F.md5(F.concat(F.lit("mix:"), "text")).alias("k"))
    ranks = sorted(tuple(r) for r in corpus.hash_rank(rows, ["label"], "mix").select("label", "rank", "doc_id").collect())
    assert sorted(tuple(r) for r in corpus.hash_rank(keyed, ["label"], "mix", digest="k").select("label", "rank", "doc_id").collect()) == ranks
    text = {1: "aa", 2: "bb", 3: "bb", 4: "cc", 5: "dd"}
    human, model = ([text[d] for label, _, d in ranks if label == k] for k in (0, 1))
    found = {r.doc_no: (r.text, r.truth) for r in corpus.assemble_documents(rows, "HAH", 3, [], []).collect()}
    assert found == {n: ("\n\n".join([human[2 * n], model[n], human[2 * n + 1]]), [0, 1, 0]) for n in (0, 1)}
