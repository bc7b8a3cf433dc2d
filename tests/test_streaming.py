"""Streams give the rows that the same operators give on the whole table."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import models, segments
from quillmark.plans import studies
from quillmark.plans.models import linear_files
from quillmark.streaming import jobs
from quillmark.streaming.cache import ScoreCache

SF = "/root/testdata/sf0.001"


def source(spark, tmp_path, files=3):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    docs.repartition(files).write.parquet(str(tmp_path / "in"))
    return docs, spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2 if files == 3 else 1).parquet(str(tmp_path / "in"))


def test_detect(spark, tmp_path):
    docs, stream = source(spark, tmp_path)
    jobs.stream_detect(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    want, got = jobs.detect(docs), spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert not studies.compared(want, got).where("differ").count()
    # another threshold in the stream is found, and so is a document that is missing
    other = jobs.detect(docs, models.Scorer("other", models.get_scorer().add, 0.834, 0.9, 40))
    short = want.where("threshold = 0.889").count()
    assert short and studies.compared(other, got).where("differ").count() == short
    assert studies.compared(want.where("doc_id > 0"), got).where("differ").count() == 1


def test_detect_by_scorers_from_files(spark, tmp_path):
    docs, stream = source(spark, tmp_path)
    saved, shipped, loads = linear_files(spark, models.features.SCORERS["a"])
    want = sorted(jobs.detect(docs).collect())
    for k, scorer in enumerate((saved, shipped)):
        assert models.get_scorer(scorer.name) is scorer
        jobs.stream_detect(stream, str(tmp_path / f"out{k}"), str(tmp_path / f"c{k}"), scorer.name).awaitTermination()
        assert sorted(spark.read.parquet(str(tmp_path / f"out{k}")).collect()) == want
    before = loads.value
    assert 1 <= before <= spark.sparkContext.defaultParallelism  # one a worker, and workers serve many tasks
    assert sorted(jobs.detect(docs.repartition(20), "shipped").collect()) == want
    assert loads.value <= max(before, spark.sparkContext.defaultParallelism)


def test_scan(spark, tmp_path):
    docs, stream = source(spark, tmp_path)
    jobs.stream_scan(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    want = segments.scan_documents(docs).select("doc_id", "idx", "p", "covered_chars", "label", "subcat")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def run_cached(spark, stream, tmp_path, fan=8):
    jobs.stream_score_cached(stream, str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "c"), fan).awaitTermination()


def test_cached(spark, tmp_path):
    docs, stream = source(spark, tmp_path)
    ScoreCache(spark, str(tmp_path / "cache")).seed(spark.createDataFrame([], "text_md5 string, p double"))
    run_cached(spark, stream, tmp_path)
    cache = ScoreCache(spark, str(tmp_path / "cache")).table(1)
    assert cache.count() == docs.select(F.md5("text")).distinct().count() == cache.select("text_md5").distinct().count()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "p")
    assert sorted(got.collect()) == sorted(jobs.detect(docs).select("doc_id", "p").collect())


def test_cached_batch_again(spark, tmp_path):
    """A batch whose commit was lost is run again: cache and output stay as they were."""
    docs, stream = source(spark, tmp_path)
    ScoreCache(spark, str(tmp_path / "cache")).seed(spark.createDataFrame([], "text_md5 string, p double"))
    run_cached(spark, stream, tmp_path)
    read = lambda: sorted(ScoreCache(spark, str(tmp_path / "cache")).table(1).collect())
    before = read()
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run_cached(spark, stream, tmp_path)
    assert read() == before and len(before) > 0 and spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_cached_batch_that_fails_halfway(spark, tmp_path, monkeypatch):
    """A crash after the generation is written, before its manifest is: the version before stays, and the next run mends all."""
    docs, stream = source(spark, tmp_path)
    held = ScoreCache(spark, str(tmp_path / "cache"))
    held.seed(spark.createDataFrame([("0" * 32, 0.5)], "text_md5 string, p double"))
    write = ScoreCache._write

    def broken(self, rows, gen, level):
        write(self, rows, gen, level)
        raise RuntimeError("lost")

    monkeypatch.setattr(ScoreCache, "_write", broken)
    with pytest.raises(Exception, match="lost"):
        run_cached(spark, stream, tmp_path)
    assert held.generations(-1) == ["gen-seed"]
    monkeypatch.setattr(ScoreCache, "_write", write)
    run_cached(spark, stream, tmp_path)
    assert held.table(1).count() == 1 + docs.select(F.md5("text")).distinct().count()


def test_generations_merge_and_filters_keep_reads_few(spark, tmp_path):
    held = ScoreCache(spark, str(tmp_path / "cache"), fan=2)
    rows = lambda k: spark.range(100 * k, 100 * k + 100).select(F.md5(F.col("id").cast("string")).alias("text_md5"), (F.col("id") / 1000).alias("p"))
    held.seed(rows(0))
    for version in range(6):
        held.commit(version, rows(version + 1))
    assert held.table(5).count() == 700
    assert len(held.generations(5)) <= 3  # 7 generations of 100 rows as powers of two
    assert sorted(held.lookup(5, rows(2)).collect()) == sorted(rows(2).collect())
    assert len(held.may_hold(5, rows(6).limit(3))) <= 2
    assert held.may_hold(5, rows(50).limit(1)) == [] or held.lookup(5, rows(50).limit(1)).count() == 0
    plan = held.lookup(5, rows(6).limit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2
