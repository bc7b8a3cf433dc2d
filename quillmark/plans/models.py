"""Queries of trained models, thresholds and the scorer registry, with DuckDB equivalents where nothing is fitted.

Every labelled document is scored, by the model of two that was fitted on the other half.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..functions import features
from ..operators import metrics, models, scorers
from ..sources.folders import scratch
from . import corpus as C
from . import documents as D
from .metrics import AVG, Q, scores

QUERIES, ORACLES = {}, {}
#: Boosting rounds of the registered queries; the operators default to 100.
ROUNDS = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _crossed(rows, fit, score):
    """`rows`, which have a column fold, each half scored by what was fitted on the other."""
    half = F.col("fold") % 2
    parts = [score(rows.where(half == k), fit(rows.where(half != k))) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def _featured(spark, sf_dir):
    """Features of labelled documents, written to the checkpoint folder, as fits and scores of the halves each read them."""
    path = scratch(spark, "features")
    rows = features.with_features(C.corpus(spark, sf_dir)).withColumn("fold", models.fold("doc_id"))
    rows.select("doc_id", "label", *models.FEATURES, "fold").write.parquet(path)
    return spark.read.parquet(path)


def _score_a(rows):
    return features.with_scores(rows).withColumn("p", F.round("p_a", 6))


@query()
def gbt(spark, sf_dir):
    return _crossed(_featured(spark, sf_dir), lambda rows: models.fit_gbt(rows, rounds=ROUNDS), models.score_gbt).select("doc_id", "label", "p")


@query()
def calibrated_gbt(spark, sf_dir):
    return _crossed(_featured(spark, sf_dir), lambda rows: models.fit_calibrated_gbt(rows, rounds=ROUNDS), models.score_calibrated_gbt).select("doc_id", "label", "p")


@query()
def feature_importances(spark, sf_dir):
    rows = _featured(spark, sf_dir)
    return models.feature_importances(rows, models.fit_calibrated_gbt(rows, rounds=ROUNDS))


@query()
def isotonic(spark, sf_dir):
    rows = _score_a(C.corpus(spark, sf_dir)).withColumn("fold", models.fold("doc_id"))
    return models.calibrate(rows, models.fit_isotonic(rows.where("fold > 0"))).select("doc_id", "label", "p", "calibrated")


@query()
def text_model(spark, sf_dir):
    rows = C.corpus(spark, sf_dir).withColumn("fold", models.fold("doc_id"))
    # fits and scores of both halves read the grams of the texts, which are found once
    counted = models.gram_table(rows, ["doc_id", "label", "fold"])
    return _crossed(counted, lambda part: models.fit_text_models(part, (0.01,))[0], lambda part, model: model.score_counted(part)).select("doc_id", "label", "p")


@query()
def select_by_short_auc(spark, sf_dir):
    rows = C.corpus(spark, sf_dir).withColumn("fold", models.fold("doc_id"))
    # all fits read the hashed grams of the texts, which are found once
    path, penalties = scratch(spark, "grams"), (0.001, 0.1)
    models.gram_counts(rows).select("label", "fold", "_tf").write.parquet(path)
    halves = [models.fit_text_models(spark.read.parquet(path).where(F.col("fold") % 2 != k), penalties) for k in (0, 1)]

    def scorer(pair):
        def score(part):
            scored = [pair[k].score(part.where(F.col("fold") % 2 == k)) for k in (0, 1)]
            return scored[0].unionByName(scored[1])

        return score

    fitted = {f"penalty {c}": scorer(pair) for c, pair in zip(penalties, zip(*halves))}
    return models.short_auc({**fitted, "linear a": _score_a}, rows)


@query()
def linear_probe(spark, sf_dir):
    rows = C.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("label")).withColumn("fold", models.fold("vec_id"))
    return _crossed(rows, models.fit_linear_probe, models.score_linear_probe).select("vec_id", "label", "p")


WORD = r"[\p{L}\p{N}_]+"


@query(f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{WORD}')) as w from documents), n as (select doc_id, (unicode(w) * 7 + length(w)) % 500 as token, count(*) as n from t group by 1, 2),
v as (select vec_id as token, unnest(range(1, 65)) as dim, unnest(embedding)::double as x from embeddings)
select doc_id, dim::int as dim, round(sum(x * n) / sum(n), 5) as value, sum(n)::bigint as n_tokens from n join v using (token) group by 1, 2""")  # fmt: skip
def mean_pool(spark, sf_dir):
    """Words take the vector that their first letter and length name, as no table of word vectors is given."""
    words = D.documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w"))
    tokens = words.select("doc_id", ((F.ascii("w") * 7 + F.length("w")) % 500).cast("long").alias("token"))
    vectors = C.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    pooled = models.mean_pool(tokens, vectors).select("doc_id", "n_tokens", F.posexplode("pooled").alias("at", "x"))
    return pooled.select("doc_id", (F.col("at") + 1).alias("dim"), F.round("x", 5).alias("value"), "n_tokens")


@query(f"""with {C.K}, x as (select label, kind, case when kind = 'short' then {C._cut('text', '30')} else text end as text from c, (select unnest(['base', 'short']) as kind) where label = 0), sc as (select kind, round(p_a, 6) as p from ({features.sql_features('x')})),
g as (select round(0.05::double + 0.005::double * unnest(range(189)), 3) as t), y as (select kind, t, avg((p >= t)::int) as fpr from sc, g group by 1, 2), z as (select kind, coalesce(min(t) filter (where fpr <= 0.025), max(t)) as threshold from y group by 1)
select max(threshold) filter (where kind = 'base') as base, max(threshold) filter (where kind = 'short') as short from z""")  # fmt: skip
def derive_thresholds(spark, sf_dir):
    return models.derive_thresholds(C.corpus(spark, sf_dir), _score_a)


@query(f"""with {Q}, e as (select case when md5(doc_id::varchar) < '8' then 'validation' else 'test' end as part, label, p from s), g as (select round(0.05::double + 0.005::double * unnest(range(189)), 3) as t),
y as (select t, avg((p >= t)::int) as fpr from e, g where label = 0 and part = 'validation' group by 1), k as (select 'new' as kind, coalesce(min(t) filter (where fpr <= 0.03), max(t)) as threshold from y union all select 'old', 0.55::double)
select part, kind, threshold, count(*) as n, {AVG.format('threshold', 0)} as fpr, {AVG.format('threshold', 1)} as recall from e, k group by 1, 2, 3""")  # fmt: skip
def recalibrate(spark, sf_dir):
    part = F.when(F.md5(F.col("doc_id").cast("string")) < "8", "validation").otherwise("test").alias("part")
    return models.recalibrate(scores(spark, sf_dir).where("scorer = 'a'").select(part, "label", "p"), 0.55, 0.03)


@query(f"""with f as ({features.sql_features('documents', 'text', ('a', 'b'))}) select doc_id, 'a' as scorer, round(p_a, 6) as p, n_words, case when n_words < 40 then 0.889::double else 0.834::double end as threshold, p_a >= case when n_words < 40 then 0.889 else 0.834 end as verdict from f
union all select doc_id, 'b', round(p_b, 6), n_words, 0.86::double, p_b >= 0.86 from f""")  # fmt: skip
def detect_by_registry(spark, sf_dir):
    found = models.detect_each(D.documents(spark, sf_dir), ("default", "b"))
    return found.select("doc_id", "scorer", F.round("p", 6).alias("p"), "n_words", "threshold", "verdict")


def linear_files(spark, weights):
    """(scorer of a saved pipeline, scorer of a shipped file, its count of loads): both hold the coefficients of one linear scorer."""
    path = scratch(spark, "pipeline")
    terms = " + ".join([f"{weights['bias']}D", *(f"{f} * {weights[f]}D" for f in features.FEATURES)])
    PipelineModel([SQLTransformer(statement=f"select *, 1 / (1 + exp(-({terms}))) as p from __THIS__")]).save(path)
    saved = scorers.pipeline_scorer("pipeline", path, cutoff=40, base=0.834, short=0.889)

    file = os.path.join(tempfile.mkdtemp(prefix="quillmark-"), f"{uuid.uuid4().hex}.json")
    with open(file, "w") as out:
        json.dump(weights, out)

    def load(local):
        with open(local) as found:
            return json.load(found)

    def predict(w, frame):
        # a sentence of thousands of words drives the power beyond what a double holds; p is 0 there, as in Spark and SQL
        return [1 / (1 + math.exp(min(-(w["bias"] + sum(w[f] * x for f, x in zip(frame.columns, row))), 709.0))) for row in frame.itertuples(index=False)]

    shipped, loads = scorers.pandas_scorer(spark, "shipped", file, load, predict, cutoff=40, base=0.834, short=0.889)
    return saved, shipped, loads


_B = "select doc_id, {0} as scorer, round(p_b, 6) as p, n_words, case when n_words < 40 then 0.889::double else 0.834::double end as threshold, p_b >= case when n_words < 40 then 0.889 else 0.834 end as verdict from f"


@query(f"with f as ({features.sql_features('documents', 'text', ('b',))}) {_B.format(chr(39) + 'pipeline' + chr(39))} union all {_B.format(chr(39) + 'shipped' + chr(39))}")
def detect_by_model(spark, sf_dir):
    """Detection by scorers that are read from files, both with the coefficients of the linear scorer b."""
    saved, shipped, _ = linear_files(spark, features.SCORERS["b"])
    found = [models.detect(D.documents(spark, sf_dir), s.name).select("doc_id", F.lit(s.name).alias("scorer"), F.round("p", 6).alias("p"), "n_words", "threshold", "verdict") for s in (saved, shipped)]
    return found[0].unionByName(found[1])
