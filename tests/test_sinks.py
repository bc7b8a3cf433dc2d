"""Files written one a document, and rows counted as they are read."""

import math
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillmark.operators import lm, reports, segments
from quillmark.sources import files, readers

SF = "/root/testdata/sf0.001"


def held(path):
    return {p.name: p.read_text() for p in path.rglob("*") if p.is_file() and not p.name.startswith("_")}


def test_one_file_a_document(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, "zwei\n"), (3, None), (40, "é")], "doc_id long, body string").repartition(3)
    files.write_files(rows, str(tmp_path / "out"))
    assert held(tmp_path / "out") == {"1.txt": "one", "2.txt": "zwei\n", "3.txt": "", "40.txt": "é"}
    assert (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_pending").exists()
    files.write_files(rows.where("doc_id > 2").select(F.concat(F.lit("a/"), "doc_id").alias("k"), "body"), str(tmp_path / "out"), "k", "body", ".md")
    assert held(tmp_path / "out") == {"a%2f3.md": "", "a%2f40.md": "é"}


def test_a_failed_task_leaves_nothing_half_written(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, body string").repartition(4)
    files.write_files(rows.where("doc_id < 3"), str(tmp_path / "out"))
    before = held(tmp_path / "out")
    broken = rows.withColumn("body", F.when(F.col("doc_id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken, str(tmp_path / "out"))
    assert held(tmp_path / "out") == before and not (tmp_path / "out" / "_pending").exists()


def test_reports_as_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 5")
    rows = segments.scan_all(docs, sep="\n")
    results = rows.where("kind = 'content'")
    glued = segments.score_fragments(segments.glue_short_prose(results), 0.72, keep=("text",))
    md = reports.report_markdown(results, rows.where("kind = 'service'"), glued)
    reports.write_reports(md, str(tmp_path / "md"))
    want = {f"{r.doc_id}.report.md": r.md for r in md.collect()}
    assert held(tmp_path / "md") == want and len(want) == 5 and all("## Shares" in x and x.endswith(f"{reports.NOTE}\n") for x in want.values())
    reports.write_reports(reports.report_html(results), str(tmp_path / "html"))
    assert all(x.startswith("<html>") and "<h2>" not in x for x in held(tmp_path / "html").values())


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "label": 1}\n\n{"text": "cut\n[1]\n{"text": "two", "label": 0}\n')
    rows, seen = readers.read_corpus_counted(spark.newSession(), str(tmp_path / "a.jsonl"))
    assert [(r.text, r.label) for r in rows.collect()] == [("one", 1), ("two", 0)]
    assert seen.get == {"lines": 4, "bad": 2}


def test_metrics_as_json(spark, tmp_path):
    readers.write_metrics(spark.createDataFrame([("fpr", 0.02)], "name string, value double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"name": "fpr", "value": 0.02}


def test_skipped_rows_are_counted_with_the_features(spark):
    docs = spark.newSession().createDataFrame([(1, "One two three. Four.", 0), (2, None, 1), (3, "Text here.", None), (4, "a", 1)], "doc_id long, text string, label int")
    seen = Observation()
    assert {r.doc_id for r in lm.feature_matrix(docs, docs, seen).collect()} == {1, 4} and seen.get == {"rows": 4, "skipped": 2}


def test_frequent_words_are_dealt_out(spark, monkeypatch):
    """Half of all words are one word: the same features whether it is dealt to many tasks or to none."""
    docs = spark.createDataFrame([(k, " ".join("the" if i % 2 else f"{chr(97 + i * k % 23)}x" for i in range(60)) + ". the the end.") for k in range(1, 40)], "doc_id long, text string")
    monkeypatch.setattr(lm, "PARTS", 1)
    want = sorted(lm.lm_features(docs, docs.where("doc_id % 2 = 0")).collect())
    for parts in (50, 10_000):
        counts = lm.tokens(docs).groupBy("doc_id", "sent", "v", "w").agg(F.count("*").alias("k"))
        heads = {r.w: r._parts for r in lm.frequent(counts, ["w"], parts).collect()}
        assert heads["the"] >= parts // 4 and sum(heads.values()) < 2 * parts
        found = counts
        dealt = lm.dealt_join(found, lm.fit(lm.tokens(docs))[2], ["w"], lm.frequent(counts, ["w"], parts), ["doc_id", "sent"])
        assert dealt.count() == counts.count() and dealt.where("n_w is null").count() == 0
    monkeypatch.setattr(lm, "PARTS", 50)
    assert sorted(lm.lm_features(docs, docs.where("doc_id % 2 = 0")).collect()) == want


def test_bigrams_are_asked_about_in_chunks(spark, monkeypatch):
    """Every token went through four shuffles; now none does. The same features in chunks and groups of any size, frequent words dealt out or
    not, as by a plain count over words in ASCII, Latin-1 and beyond."""
    texts = [" ".join("the" if i % 2 else f"{'xéя'[k % 3]}{chr(97 + i * k % 11)}" for i in range(20 + k)) + ("! The end. the The" if k % 4 else ".") for k in range(1, 30)] + ["", "1 2.", "Один. Два"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 3 <> 0")
    found = lm.lm_features(docs, train)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted(found.collect())
    words = {k: [[w for w in s.lower().split()] for s in t.replace("!", ".").split(".") if any(c.isalpha() for c in s)] for k, t in enumerate(texts)}
    flat = {k: [w for s in v for w in s] for k, v in words.items()}
    uni = Counter(w for k, v in flat.items() if k % 3 for w in v)
    pairs = Counter(p for k, v in flat.items() if k % 3 for p in zip(v, v[1:]))
    of = Counter()
    for (v, _), n in pairs.items():
        of[v] += n
    whole = sum(uni.values()) + len(uni) + 1
    losses = {k: [-math.log((0.7 * pairs[v, w] / of[v] if pairs[v, w] else 0) + 0.3 * (uni[w] + 1) / whole if v else (uni[w] + 1) / whole) for v, w in zip([None, *x], x)] for k, x in flat.items() if x}
    assert {r.doc_id: (r.n_tokens, r.perplexity) for r in want} == {k: (len(x), pytest.approx(math.exp(sum(x) / len(x)), abs=1e-4)) for k, x in losses.items()}
    for chunk, dealt, held in ((40, 1_000_000, 1_000_000), (200, 4, 60), (2_000_000, 3, 1)):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "DEALT", dealt)
        monkeypatch.setattr(lm, "HELD", held)
        assert sorted(lm.lm_features(docs, train).collect()) == want
        assert sorted(lm.lm_features(docs, F.col("doc_id") % 3 != 0).collect()) == want
    # an id of two rows makes one document of them
    again = docs.unionByName(docs.where("doc_id = 4"))
    found = {r.doc_id: r for r in lm.lm_features(again, train).collect()}
    assert sorted(r for k, r in found.items() if k != 4) == [r for r in want if r.doc_id != 4] and found[4].n_tokens == 2 * len(flat[4])
    assert found[4].perplexity == pytest.approx({r.doc_id: r for r in want}[4].perplexity, abs=2e-4)


def test_the_matrix_shuffles_no_tokens(spark):
    """It takes the language model's features from the same chunks; before, every token of labelled texts was exploded and shuffled."""
    docs = spark.createDataFrame([(1, "One two three. Four.", 0), (2, "Two three!", 1), (3, "Text here.", None), (4, "a", 1), (5, "", 0)], "doc_id long, text string, label int")
    found = lm.feature_matrix(docs, docs)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r for r in found.collect()}
    plain = {r.doc_id: r for r in lm.lm_features(docs, docs).collect()}
    assert set(rows) == {1, 2, 4, 5} and all(rows[k].perplexity == plain[k].perplexity > 0 for k in (1, 2)) and rows[4].perplexity == rows[5].perplexity == 0.0
