"""The library's own operators: every registered query against DuckDB, and row fixtures with results derived by hand."""

import datetime
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark import catalog
from quillmark.functions import text as T
from quillmark.operators import corpus, segments
from quillmark.sources import readers

SF = "/root/testdata/sf0.001"
LONG = "Текст абзаца, который достаточно длинный для надёжной оценки. " * 5


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sections_of_a_thesis(spark):
    parts = ["Титул"] * 6 + [LONG, "Содержание", *[f"Введение\t{k}" for k in range(3, 8)], "ВВЕДЕНИЕ", LONG, "ГЛАВА 1. АНАЛИЗ", LONG, "⟦таблица: 4 ячеек⟧", LONG, "ЗАКЛЮЧЕНИЕ", LONG, "СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ", "1. Книга", "2. Книга", "ПРИЛОЖЕНИЯ", "приложение А"]
    rows = segments.classify_sections(segments.split_paragraphs(docs(spark, "\n\n".join(parts)))).collect()
    kept = sorted(r.idx for r in rows if r.kind == "content")
    assert kept == [13, 14, 15, 16, 18, 19, 20]
    reasons = {}
    for r in rows:
        reasons[r.drop_reason] = reasons.get(r.drop_reason, 0) + 1
    assert reasons == {None: 7, "title": 7, "toc": 6, "table": 1, "backmatter": 5}


def test_paragraph_positions(spark):
    text = "  one \n \n\ntwo  lines\nof it\n\n\n\n  \n\nthree"
    rows = segments.split_paragraphs(docs(spark, text, None, "")).orderBy("idx").collect()
    assert [(r.idx, r.text, text[r.start : r.end]) for r in rows] == [(0, "one", "one"), (1, "two  lines\nof it", "two  lines\nof it"), (2, "three", "three")]


@pytest.mark.parametrize("n, wins", [(1, 1), (150, 1), (151, 2), (225, 2), (226, 3)])
def test_windows(spark, n, wins):
    paras = segments.split_paragraphs(docs(spark, " ".join(["словословослово"] * n)))
    rows = segments.build_windows(paras).orderBy("win_no").collect()
    # a last window of 76 words or more is over 200 characters, so no tail is merged here
    assert len(rows) == wins and rows[-1].cend == 16 * n - 1 and all(r.n_wins == wins for r in rows)
    assert [r.cstart for r in rows] == [75 * 16 * k for k in range(wins)]


def test_glue(spark):
    rows = [(0, i, "п" * (n - 1) + ".", None, "short_prose") for i, n in ((3, 90), (4, 90), (5, 90), (7, 60), (8, 60))]
    results = spark.createDataFrame(rows, "doc_id long, idx int, text string, p double, subcat string")
    frags = segments.glue_short_prose(results).collect()
    assert [(r.member_idxs, r.n_chars) for r in frags] == [([3, 4, 5], 272)]


def test_aggressive_glue(spark):
    rows = [(0, i, "п" * n, None, "short_prose") for i, n in ((1, 120), (3, 100), (5, 90), (7, 50), (9, 260))]
    results = spark.createDataFrame(rows, "doc_id long, idx int, text string, p double, subcat string")
    tables = spark.createDataFrame([(0, 8)], "doc_id long, idx int")
    assert [r.member_idxs for r in segments.glue_aggressive(results, tables).collect()] == [[1, 3, 5]]


def test_labels_and_thresholds(spark):
    rows = spark.createDataFrame([(0.72,), (0.5,), (0.4999,), (None,)], "p double")
    assert [r[0] for r in rows.select(T.label_for(F.col("p"), 0.72)).collect()] == ["suspicious", "uncertain", "human", "insufficient"]
    words = spark.createDataFrame([(39,), (40,)], "n int")
    assert [r[0] for r in words.select(T.threshold_for(F.col("n"), F.lit(0.834), F.lit(0.889), F.lit(40))).collect()] == [0.889, 0.834]
    none = F.lit(None).cast("double")
    assert [r[0] for r in words.select(T.threshold_for(F.col("n"), none, none, none)).collect()] == [0.86, 0.86]


def test_short_kinds(spark):
    texts = {"Рис. 3 Схема": "caption", "x = y + 1": "formula", "Глава 2": "heading", "1.2 Метод": "heading", "– пункт списка": "list_item", "Это короткая мысль.": "short_prose", "ячейка": "table_cell", "ВЫВОДЫ ПО РАБОТЕ": "heading"}
    rows = docs(spark, *texts).select("text", segments.classify_short(F.col("text")).alias("k")).collect()
    assert {r.text: r.k for r in rows} == texts


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" текст \n", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("  ", encoding="utf-8")
    (tmp_path / "in" / "c.txt").write_text("other", encoding="utf-8")
    (tmp_path / "in" / "labels.json").write_text(json.dumps({"a.txt": 1}), encoding="utf-8")
    (tmp_path / "in" / "d.jsonl").write_text('{"text": "line"}\n\n{"text": " "}\n', encoding="utf-8")
    path = str(tmp_path / "in")
    assert {(r.file, r.text, r.label) for r in readers.read_labelled_dir(spark, path).collect()} == {("a.txt", "текст", 1), ("c.txt", "other", None)}
    assert {(r.source, r.text) for r in readers.read_human_dir(spark, path).collect()} == {("local:a.txt", "текст"), ("local:c.txt", "other"), ("local:d.jsonl", "line")}
    rows = spark.createDataFrame([("t", 1, "s", "g", 0.7, "A")], readers.CORPUS)
    readers.write_corpus(rows, str(tmp_path / "out"))
    assert readers.read_corpus(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_tables_in_pages(spark):
    page = [(0, "<p>a &amp; b</p><table><thead><tr><td>1</td><td> </td><th>2</th></tr></thead></table><script>x</script><h2>Head</h2>")]
    rows = readers.extract_blocks(spark.createDataFrame(page, "page_id long, html string")).orderBy("idx").collect()
    assert [(r.text, r.style, r.is_table, r.is_heading) for r in rows] == [("a & b", "p", False, False), ("⟦таблица: 2 ячеек⟧", "table", True, False), ("Head", "h2", False, True)]


def test_scans_reach_every_label(spark):
    """The fixture of reports and glue has scored paragraphs of all labels beside short ones, and fragments."""
    labels = {r.label: r.chars for r in catalog.QUERIES["label_shares"](spark, SF).groupBy("label").agg(F.sum("chars").alias("chars")).collect()}
    assert set(labels) == {"human", "insufficient", "suspicious", "uncertain"} and min(labels.values()) > 0
    assert catalog.QUERIES["glued"](spark, SF).count() > 0


def test_truth_by_text_and_by_prefix(spark):
    paras = spark.createDataFrame([(0, 0, "alpha beta"), (0, 1, "alpha"), (1, 0, "gamma")], "doc_id long, idx int, text string")
    truth = spark.createDataFrame([(0, "alpha", 1), (0, "alpha", 0), (2, "gamma", 1)], "doc_id long, text string, label int")
    assert [(r.idx, r.truth) for r in segments.attach_truth(paras, truth).collect()] == [(1, 1)]
    prefixes = spark.createDataFrame([("al", 0), ("alpha b", 1), ("zzz", 1)], "prefix string, truth int")
    assert {(r.doc_id, r.idx, r.truth) for r in corpus.match_prefix(paras, prefixes).collect()} == {(0, 0, 1), (0, 1, 0)}
    assert corpus.match_prefix(paras, prefixes.limit(0)).count() == 0


def test_empty_class(spark):
    with pytest.raises(ValueError):
        corpus.balance(spark.createDataFrame([(0, "t", 0)], "doc_id long, text string, label int"))


def test_edits_are_deterministic(spark):
    texts = docs(spark, "The cat sat with the dog and the long sentence went on and on that day with many more words than it should have. The end.", "", None)
    first = texts.select("doc_id", T.perturb(F.col("text"), 7).alias("t")).collect()
    assert first == texts.select("doc_id", T.perturb(F.col("text"), 7).alias("t")).collect() and first[1].t == "" and first[2].t is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_russian_defaults(spark):
    """The fixed Russian phrases, terms and code words against Python's expressions."""
    import re

    from quillmark.functions import features
    from quillmark.operators import genre

    texts = [
        "Важно отметить, что система и база данных, БД, код и кодекс: function f = 1. Таким образом, класс int x.",
        "Гипотеза и выборка; данный роман, данные КОРПУСА. Подводя итог, functional и def.", "", "Просто слова.",
    ]
    rows = spark.createDataFrame([(i, t, 1, 0) for i, t in enumerate(texts)], "doc_id long, sample string, n_paras long, n_cited long")
    got = genre.genre_features(rows, genre.RUSSIAN_TERMS, genre.CODE).orderBy("doc_id").collect()
    plain = lambda rx: rx.replace(r"\p{L}\p{N}_", r"\w")
    for row, text in zip(got, texts):
        words = max(row.n_words, 1)
        for name, rx in genre.RUSSIAN_TERMS.items():
            assert row[f"{name}_per1k"] == pytest.approx(len(re.findall(plain(rx), text, re.I)) / words * 1000, abs=0.06)
        assert row.mathcode_per_w == pytest.approx(len(re.findall(f"{genre.MATH}|{plain(genre.CODE)}", text, re.I)) / words, abs=6e-4)
    rates = [r.phrase for r in features.with_features(rows, "sample", features.CLICHES).orderBy("doc_id").collect()]
    assert rates[0] > rates[1] > 0 == rates[2] == rates[3]
