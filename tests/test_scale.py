"""What scans, glue and fits make of odd texts, and how often they read their input."""

from pyspark.sql import functions as F

from quillmark import catalog
from quillmark.operators import models, segments

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, *texts):
    rows = [(k, text, "en", "s") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_genre_of_a_text_without_signals(spark, tmp_path):
    """Documents of ids that are 2 by 3 get no mark of a citation, so both signals of digits alone are 0."""
    found = catalog.QUERIES["genre_decision"](spark, folder(spark, tmp_path, "1", "2", "1234 5678 90.")).where("doc_id = 2").first()
    assert (found["genre"], found["recommended"], found["confident"]) == ("mixed", "agree", False)


def test_models_from_files_take_a_sentence_of_any_length(spark, tmp_path):
    """Thousands of words without an end made the power of a shipped model overflow, 50,000 the sum of squares of lengths."""
    texts = ("word " * 9_000, "other " * 50_000, "One two. Three four.", "")
    found = {(r.doc_id, r.scorer): r.p for r in catalog.QUERIES["detect_by_model"](spark, folder(spark, tmp_path, *texts)).collect()}
    assert len(found) == 8 and all(found[k, "pipeline"] == found[k, "shipped"] for k in range(4)) and found[0, "shipped"] == found[1, "shipped"] == 0.0 < found[2, "shipped"]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_aggressive_glue_reads_one_scan(spark):
    """Tables and the members' texts come from the scan that finds short prose."""
    plan = executed(catalog.QUERIES["glued_aggressive"](spark, SF))
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and plan.count("ArrowEvalPython") == 2


def test_a_part_is_shuffled_once_and_scores_are_laid_back_in_batches(spark):
    plan = executed(catalog.QUERIES["document_map"](spark, SF))
    assert "_extract_part" not in plan and "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1


def test_markers_of_headings_are_found_at_the_start_alone(spark):
    texts = ["1.2. Введение", "введение", "Список \n литературы", "1\nвведение", "2 1 глава", "о введение", " \t3) литература", "Contents of it", "1.1.раздел", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    markers = segments.START + segments.CHAPTER + segments.TOC + segments.BACKMATTER
    got = rows.select("text", segments._heads(F.col("text"), markers).alias("a"), segments._starts(segments.norm_heading(F.col("text")), markers).alias("b")).collect()
    assert all(r.a == r.b for r in got) and [r.a for r in got].count(True) == 5


def test_selection_of_a_model_finds_the_grams_of_whole_texts_once(spark, monkeypatch):
    """Each of four fits took the grams of its texts several times over; now one table of them serves all, and scores take those of cut texts."""
    taken, grams = [], models._grams
    monkeypatch.setattr(models, "_grams", lambda text: taken.append(text) or grams(text))
    found = catalog.QUERIES["select_by_short_auc"](spark, SF)
    assert "documents.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(taken) == 5 and {r.model for r in found.collect()} == {"penalty 0.001", "penalty 0.1", "linear a"}
