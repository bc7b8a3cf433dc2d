"""Streaming jobs: texts are scored as they arrive; a document's windows need the whole document, which is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import features
from ..operators import corpus, models, segments
from .cache import ScoreCache


def detect(docs: DataFrame, scorer: str | models.Scorer = "default") -> DataFrame:
    """(doc_id, p, threshold, verdict) of each text by any scorer; narrow and stateless, for batches and streams alike."""
    rows = models.detect(docs.select("doc_id", "text"), scorer)
    return rows.select("doc_id", F.round("p", 6).alias("p"), "threshold", "verdict")


def stream_detect(source: DataFrame, path: str, checkpoint: str, scorer: str | models.Scorer = "default") -> StreamingQuery:
    """Appends `detect` of a stream of (doc_id, text) to Parquet files at `path`, until the source has no more."""
    return detect(source, scorer).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scan(source: DataFrame, path: str, checkpoint: str, threshold: float = 0.72) -> StreamingQuery:
    """Scans each micro-batch of whole documents and appends the paragraphs with scores and labels."""

    def scan(batch: DataFrame, number: int) -> None:
        rows = segments.scan_documents(batch, threshold).select("doc_id", "idx", "p", "covered_chars", "label", "subcat")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same batch again replaces itself

    return source.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_score_cached(source: DataFrame, cache: str, path: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Scores each text once: micro-batches look texts up in the `ScoreCache` at `cache`, which must have been seeded, score what is new
    and leave it there as the version of their number. Output and cache of a batch that is run again replace their own."""

    def score(batch: DataFrame, number: int) -> None:
        held = ScoreCache(batch.sparkSession, cache, fan)
        known = held.lookup(number - 1, batch.select(F.md5("text").alias("text_md5")))
        _, misses = corpus.cache_split(batch, known)
        new = held.commit(number, features.with_scores(misses).select("text_md5", F.round("p_a", 6).alias("p")))
        rows = batch.withColumn("text_md5", F.md5("text")).join(known.unionByName(new), "text_md5")
        rows.select("doc_id", "text_md5", "p").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
