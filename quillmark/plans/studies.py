"""Studies over scans: window sizes, entry points and the table of all features, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features
from ..operators import lm, metrics, models, segments
from ..sources.folders import scratch
from ..streaming import jobs
from . import corpus as C
from . import documents as D
from .metrics import AVG, THR
from .metrics import ORACLES as METRIC_SQL

QUERIES, ORACLES = {}, {}
#: Window sizes and their steps.
SIZES = ((300, 150), (150, 75), (75, 25))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _windowed(size: int, step: int) -> str:
    wins = D.WINS.replace("150", "SIZE").replace("75", "STEP").replace("SIZE", str(size)).replace("STEP", str(step))
    return f"select {size} as size, doc_id, p from (with {D.LINED}, {D.CONTENT_ALL}, {D.SPANS}, {wins}, {D.sql_scored()}, {D.sql_projected()} select doc_id, p from results where p is not null)"


_ALL = " union all ".join(_windowed(*size) for size in SIZES)
_ALONE = f"select 0 as size, doc_id, round(p_a, 6) as p from (with {D.LINED}, long as (select * from paras where length(text) >= 200) select * from ({features.sql_features('long')}))"


@query(f"with e as ({_ALL} union all {_ALONE}), s as (select size, p, 1 - quality as label from e join labels using (doc_id)) select size, count(*) as n, {AVG.format(THR, 0)} as fpr, {AVG.format(THR, 1)} as recall from s group by 1")
def window_size_study(spark, sf_dir):
    """False positives and recall of paragraphs scored through windows of several sizes, all in one scan, and, as size 0, on
    their own."""
    paras = segments.split_paragraphs(D.documents(spark, sf_dir), "\n")
    truth = segments.split_paragraphs(C.corpus(spark, sf_dir), "\n", ("label",)).select("doc_id", "text", "label")
    scanned = segments.score_paragraphs(paras, sizes=SIZES).where("p_a is not null").select("size", "doc_id", "text", F.col("p_a").alias("p"))
    alone = features.with_scores(paras.where(F.length("text") >= 200)).select(F.lit(0).alias("size"), "doc_id", "text", F.round("p_a", 6).alias("p"))
    rows = scanned.unionByName(alone)
    return metrics.fpr_recall_at(segments.attach_truth(rows, truth).withColumnRenamed("truth", "label"), THR, ("size",))


def compared(batch, stream):
    """(doc_id, p_batch, p_stream, threshold_batch, threshold_stream, differ) of two outputs of `detect`: documents that only one
    of them has differ too."""
    a = batch.select("doc_id", F.col("p").alias("p_batch"), F.col("threshold").alias("threshold_batch"))
    b = stream.select("doc_id", F.col("p").alias("p_stream"), F.col("threshold").alias("threshold_stream"))
    same = F.col("p_batch").eqNullSafe(F.col("p_stream")) & F.col("threshold_batch").eqNullSafe(F.col("threshold_stream"))
    return a.join(b, "doc_id", "full").withColumn("differ", ~same)


@query(f"with f as ({features.sql_features('documents')}), d as (select doc_id, round(p_a, 6) as p, case when n_words < 40 then 0.889::double else 0.834::double end as threshold from f) select doc_id, p as p_batch, p as p_stream, threshold as threshold_batch, threshold as threshold_stream, false as differ from d")
def entry_point_consistency(spark, sf_dir):
    """Every document's score and threshold from the registry's scorer over the table, and from a stream that reads the table's
    files and writes another."""
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    batch = models.detect(docs, "default").withColumn("p", F.round("p", 6))
    out = scratch(spark, "stream")
    source = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")  # a pattern, as the table may be one file
    jobs.stream_detect(source, f"{out}/rows", f"{out}/state").awaitTermination()
    return compared(batch, spark.read.parquet(f"{out}/rows"))


_FIVE = ", ".join(f"round({name}, 6) as {name}" for name in features.FEATURES)
_LM = ", ".join(f"case when n_tokens >= 2 then {name} else 0.0 end as {name}" for name in ("perplexity", "sentence_std", "rank_entropy"))


@query(f"with {C.K}, f as ({features.sql_features('c')}), l as ({METRIC_SQL['lm_features']}) select f.doc_id, f.label, {_FIVE}, {_LM} from f left join l using (doc_id) where label is not null and text is not null")
def feature_matrix(spark, sf_dir):
    """All eight features and the label of each labelled document."""
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    return lm.feature_matrix(C.corpus(spark, sf_dir), docs.where("doc_id % 5 <> 0"))
