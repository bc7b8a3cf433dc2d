"""Trained models on Spark ML: boosted trees, fold-calibrated ensembles, isotonic calibration, text models, probes,
mean pooling, and a registry of scorers with their thresholds."""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import features
from ..functions import text as T
from ..sources.folders import scratch
from . import metrics
from .lm import _words as lm_words

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = (*features.FEATURES, "n_chars")


def fold(key: Column | str, folds: int = 5, seed: int = 0) -> Column:
    """Fold of a row, 0 to folds - 1, by a digest of its key: stable between runs and free of any sort."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def _assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    clean = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    vector = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_x")
    return vector.transform(rows.withColumns({f"_x_{c}": v for c, v in clean.items()})).drop(*[f"_x_{c}" for c in columns])


# ---- boosted trees and calibration ---------------------------------------------------------------------------------


def fit_gbt(rows: DataFrame, columns: Sequence[str] = FEATURES, rounds: int = 100, seed: int = 42) -> GBTClassificationModel:
    """Boosted trees of depth 3 over feature columns of labelled rows; null features count as 0."""
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed)
    return trees.fit(_assembled(rows.where("label is not null"), columns).select("_x", F.col("label").cast("double").alias("_y")))


def score_gbt(rows: DataFrame, model: GBTClassificationModel, columns: Sequence[str] = FEATURES, out: str = "p") -> DataFrame:
    """`rows` with the model's probability of label 1 as `out`."""
    done = model.transform(_assembled(rows, columns))
    return done.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fit_isotonic(scores: DataFrame, p: str = "p") -> IsotonicRegressionModel:
    """Isotonic calibration of (label, p). Rows reduce to weighted means by score to 6 places first, so that at most a
    million points are fitted however many rows there are."""
    # nulls are left out of the counts, as a filter on p would be pushed below and compute the score's columns again
    known = F.col(p).isNotNull() & F.col("label").isNotNull()
    points = scores.groupBy(F.round(p, 6).alias("_p")).agg(F.avg(F.when(known, F.col("label").cast("double"))).alias("_y"), F.count_if(known).cast("double").alias("_w")).where("_w > 0")
    return IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(points)


def calibrate(rows: DataFrame, model: IsotonicRegressionModel, p: str = "p", out: str = "calibrated") -> DataFrame:
    """`rows` with p calibrated: linear between knots, clipped outside them."""
    return model.copy().setFeaturesCol(p).setPredictionCol(out).transform(rows)


def fit_calibrated_gbt(rows: DataFrame, key: str = "doc_id", columns: Sequence[str] = FEATURES, folds: int = 5, rounds: int = 100, seed: int = 42) -> list[tuple[GBTClassificationModel, IsotonicRegressionModel]]:
    """One (trees, calibration) pair per fold: trees learn from the other folds and are calibrated on this one."""
    rows = rows.where("label is not null").withColumn("_fold", fold(key, folds, seed)).persist()
    pairs = []
    for k in range(folds):
        trees = fit_gbt(rows.where(F.col("_fold") != k), columns, rounds, seed)
        pairs.append((trees, fit_isotonic(score_gbt(rows.where(F.col("_fold") == k), trees, columns))))
    rows.unpersist()
    return pairs


def score_calibrated_gbt(rows: DataFrame, pairs: Sequence[tuple[GBTClassificationModel, IsotonicRegressionModel]], columns: Sequence[str] = FEATURES, out: str = "p") -> DataFrame:
    """`rows` with the mean of the pairs' calibrated probabilities; all pairs are applied in one pass."""
    names = [f"_c{k}" for k in range(len(pairs))]
    for name, (trees, iso) in zip(names, pairs):
        rows = calibrate(score_gbt(rows, trees, columns, "_raw"), iso, "_raw", name).drop("_raw")
    return rows.withColumn(out, sum(map(F.col, names), F.lit(0.0)) / len(pairs)).drop(*names)


def feature_importances(rows: DataFrame, pairs: Sequence[tuple[GBTClassificationModel, IsotonicRegressionModel]], columns: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance): importances averaged over folds, largest first."""
    mean = [sum(float(trees.featureImportances[i]) for trees, _ in pairs) / len(pairs) for i in range(len(columns))]
    return rows.sparkSession.createDataFrame(list(zip(columns, mean)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---- text models ---------------------------------------------------------------------------------------------------


def _grams(text: Column) -> Column:
    """Words, word pairs and character trigrams, marked by kind."""
    words = T.words(F.coalesce(text, F.lit("")))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    # one regular expression finds all overlapping trigrams in one pass; digits and marks stay in them
    chars = F.regexp_extract_all(F.concat(F.lit(" "), F.lower(T.flat(F.coalesce(text, F.lit("")))), F.lit(" ")), F.lit("(?=(.{3}))"), 1)
    return F.concat(words, pairs, F.transform(chars, lambda c: F.concat(F.lit("#"), c)))


@dataclass(frozen=True)
class TextModel:
    """A fitted text model; `score` adds a probability of label 1."""

    stages: PipelineModel

    def score(self, rows: DataFrame, out: str = "p") -> DataFrame:
        done = self.stages.transform(rows.withColumn("_grams", _grams(F.col("text"))))
        return done.withColumn(out, vector_to_array("probability")[1]).drop("_grams", "_tf", "_idf", "_x", "rawPrediction", "probability", "prediction")

    def score_counted(self, rows: DataFrame, out: str = "p") -> DataFrame:
        """`score` of rows that have `_tf` instead of a text."""
        done = PipelineModel(stages=self.stages.stages[1:]).transform(rows)
        return done.withColumn(out, vector_to_array("probability")[1]).drop("_tf", "_idf", "_x", "rawPrediction", "probability", "prediction")


def balanced(label: str, counts: DataFrame) -> Column:
    """Weight of a row so that both classes weigh the same; `counts` has one row per label."""
    found = {int(r[label]): r["count"] for r in counts.collect()}
    total, kinds = sum(found.values()), max(len(found), 1)
    weight = F.lit(1.0)
    for value, n in found.items():
        weight = F.when(F.col(label) == value, total / (kinds * n)).otherwise(weight)
    return weight


def gram_counts(rows: DataFrame, size: int = 1 << 16) -> DataFrame:
    """`rows` with `_tf`, the counts of the text's words, word pairs and character trigrams by hash, for `fit_text_models`."""
    return HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size).transform(rows.withColumn("_grams", _grams(F.col("text")))).drop("_grams")


#: Characters of texts whose grams are counted together, and characters that a regular expression takes for the end of a line.
HELD, ENDS = 1 << 20, (0x85, 0x2028, 0x2029)
BLANK = re.compile(r"[ \t\n\r\f\x0B]+")


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def _slots(blocks: np.ndarray, length: int, size: int) -> np.ndarray:
    """What `HashingTF` with `size` slots makes of strings of `length` bytes, rows of words of four bytes with zeros behind the end: their
    murmur hash with seed 42."""
    h = np.full(len(blocks), 42, np.uint32)
    for at in range(blocks.shape[1]):
        h ^= _mixed(blocks[:, at])
        if 4 * at + 4 <= length:
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(length)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % size


def _hashed(strings: list[bytes], size: int) -> np.ndarray:
    """The slot of each string."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    found, order = np.zeros(len(strings), np.int64), np.argsort(lens, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1):
        if len(at):
            length = int(lens[at[0]])
            blocks = np.zeros((len(at), -(-length // 4) * 4), np.uint8)
            blocks[:, :length] = np.frombuffer(b"".join([strings[k] for k in at]), np.uint8).reshape(len(at), length)
            found[at] = _slots(blocks.view("<u4"), length, size)
    return found


def _trigrams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each character trigram, as the regular expression of `_grams` finds them."""
    bodies = [f" {BLANK.sub(' ', text).strip(' ').lower()} " for text in texts]
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(bodies)), np.fromiter(map(len, bodies), np.int64, len(bodies)))
    ended = np.isin(points, ENDS)
    good = np.flatnonzero((owner[2:] == owner[:-2]) & ~(ended[2:] | ended[1:-1] | ended[:-2]))
    low = (points[good] | points[good + 1] | points[good + 2]) < 0x80
    at = good[low]
    slots = np.zeros(len(good), np.int64)
    slots[low] = _slots((np.uint32(ord("#")) | points[at] << np.uint32(8) | points[at + 1] << np.uint32(16) | points[at + 2] << np.uint32(24))[:, None], 4, size)
    wide = [points[good[~low] + k].astype(np.int64) for k in range(3)]
    keys, which = np.unique(wide[0] << 42 | wide[1] << 21 | wide[2], return_inverse=True)  # 21 bits a character
    slots[~low] = _hashed([f"#{chr(k >> 42)}{chr(k >> 21 & 0x1FFFFF)}{chr(k & 0x1FFFFF)}".encode("utf-8", "replace") for k in keys.tolist()], size)[which]
    # a character of two halves is found from its second half on, too, which is no character
    two = good[points[good] > 0xFFFF]
    halves = _hashed([f"#?{chr(points[k + 1])}{chr(points[k + 2])}".encode("utf-8", "replace") for k in two.tolist()], size)
    return np.concatenate([owner[good], owner[two]]), np.concatenate([slots, halves])


def _gram_vectors(texts: list[str], size: int) -> pa.StructArray:
    """The `_tf` of each text, as a sparse vector is stored."""
    found = [[word for words in lm_words(text) for word in words] for text in texts]
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, int(lens.sum()))
    owner, words = np.repeat(np.arange(len(found)), lens), list(numbers)
    of_words = _hashed(words, size)[ids] if words else ids
    next_ = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, which = np.unique(ids[next_] * max(1, len(words)) + ids[next_ + 1], return_inverse=True)
    of_pairs = _hashed([words[v] + b" " + words[w] for v, w in zip(*[x.tolist() for x in np.divmod(pairs, max(1, len(words)))])], size)[which]
    texts_of, of_chars = _trigrams(texts, size)
    each, n = np.unique(np.concatenate([owner, owner[next_], texts_of]) * size + np.concatenate([of_words, of_pairs, of_chars]), return_counts=True)
    ends = pa.array(np.searchsorted(each, np.arange(len(texts) + 1) * size), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, values) for values in (pa.array((each % size).astype(np.int32)), pa.array(n.astype(np.float64)))]
    return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), size, np.int32)), *lists], ["type", "size", "indices", "values"])


def gram_table(rows: DataFrame, keep: Sequence[str], size: int = 1 << 16) -> DataFrame:
    """Columns `keep` of `rows` with the `_tf` of `gram_counts`, found once, in Arrow batches, and written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([len(text) for text in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD)))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _gram_vectors(texts[at:end], size)], [*keep, "_tf"])
                at = end

    spark, path, kept = rows.sparkSession, scratch(rows.sparkSession, "grams"), rows.select(*keep)
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes)
    rows.select(*keep, "text").mapInArrow(run, f"{kinds}, _tf struct<type: tinyint, size: int, indices: array<int>, values: array<double>>").write.parquet(path)
    return spark.read.schema(StructType([*kept.schema.fields, StructField("_tf", VectorUDT())])).parquet(path)


def fit_text_models(counted: DataFrame, penalties: Sequence[float], size: int = 1 << 16, rounds: int = 50) -> list[TextModel]:
    """A balanced logistic regression over hashed words, word pairs and character trigrams weighted by rarity for each penalty. Rows have
    label and the `_tf` of `gram_counts`; rarity is fitted once for all."""
    rows = counted.where("label is not null").select("_tf", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("_w", balanced("label", rows.groupBy("label").count()))
    idf = IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2).fit(rows)
    unit = Normalizer(inputCol="_idf", outputCol="_x")  # long texts weigh no more than short ones
    weighed = unit.transform(idf.transform(rows)).select("_x", "label", "_w")
    hashed = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size)
    fits = [LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=penalty, maxIter=rounds).fit(weighed) for penalty in penalties]
    return [TextModel(PipelineModel(stages=[hashed, idf, unit, fit])) for fit in fits]


def fit_text_model(rows: DataFrame, size: int = 1 << 16, penalty: float = 0.01, rounds: int = 50) -> TextModel:
    """The model of `fit_text_models` for one penalty, from rows with text and label."""
    return fit_text_models(gram_table(rows.where("label is not null"), ["label"], size), (penalty,), size, rounds)[0]


def short_auc(models: dict[str, Callable[[DataFrame], DataFrame]], rows: DataFrame, lengths: Sequence[int] = (40, 30, 20)) -> DataFrame:
    """(model, mean_auc), best first: each model's mean AUC over texts cut to a few words.

    `models` maps names to functions that add `p` to rows with `text`. The cut texts are written to the checkpoint folder, so that whole
    texts are read once and not for each model.
    """
    # cut texts come out of a generator, so that no feature cuts them again
    each = F.array(*[F.struct(F.lit(n).alias("cut"), T.truncate_words(F.col("text"), n).alias("text")) for n in lengths])
    others = [c for c in rows.columns if c != "text"]
    path = scratch(rows.sparkSession, "cut")
    rows.select(*others, F.explode(each).alias("_e")).select(*others, "_e.cut", "_e.text").write.parquet(path)
    cut = rows.sparkSession.read.parquet(path)
    scored = None
    for name, score in models.items():
        part = score(cut).select(F.lit(name).alias("model"), "cut", "label", F.round("p", 6).alias("p"))
        scored = part if scored is None else scored.unionByName(part)
    found = metrics.roc_auc(scored, ("model", "cut"))
    return found.groupBy("model").agg(F.round(F.avg("auc"), 6).alias("mean_auc")).orderBy(F.desc_nulls_last("mean_auc"), "model")


# ---- embeddings ----------------------------------------------------------------------------------------------------


def fit_linear_probe(rows: DataFrame, vector: str = "embedding", c: float = 1.0) -> PipelineModel:
    """Standardised, balanced logistic regression over an array column; the penalty is 1 / (c * rows)."""
    rows = rows.where(F.col(vector).isNotNull() & F.col("label").isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"), F.col("label").cast("double").alias("label"))
    counts = rows.groupBy("label").count().persist()
    n = counts.agg(F.sum("count")).first()[0] or 1
    rows = rows.withColumn("_w", balanced("label", counts))
    counts.unpersist()
    stages = [StandardScaler(inputCol="_v", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=1 / (c * n), standardization=False)]
    return Pipeline(stages=stages).fit(rows)


def score_linear_probe(rows: DataFrame, model: PipelineModel, vector: str = "embedding", out: str = "p") -> DataFrame:
    """`rows` with a vector, and the probe's probability of label 1."""
    done = model.transform(rows.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    return done.withColumn(out, vector_to_array("probability")[1]).drop("_v", "_x", "rawPrediction", "probability", "prediction")


#: Tokens that a task counts at a time, and pairs of a document and one of its tokens that are pooled together.
COUNTED, POOLED = 1_000_000, 200_000


def _counted(doc: str, token: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, token, n) with arrays of a document's distinct tokens and of their numbers, for each stretch of `COUNTED` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(x.num_rows for x in held) >= COUNTED):
                found = pa.Table.from_batches(held).group_by([doc, token]).aggregate([([], "count_all")])
                found = found.group_by(doc).aggregate([(token, "list"), ("count_all", "list")])
                yield from found.select([doc, f"{token}_list", "count_all_list"]).rename_columns([doc, token, "n"]).to_batches(max_chunksize=1000)
                held = []

    return run


def _pooled(doc: str, token: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From rows (doc, token, n) of `_counted` and rows (token, vector): rows (doc, n_tokens, pooled)."""

    def work(bags: pa.Table, vectors: pa.Table) -> pa.Table:
        known = vectors.column(token).combine_chunks().dictionary_encode()
        flat = vectors.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(vectors.num_rows, -1)
        at = known.indices.to_numpy(zero_copy_only=False)
        # a token counts with each of its vectors
        sums, times = np.zeros((len(known.dictionary), flat.shape[1])), np.bincount(at, minlength=len(known.dictionary))
        np.add.at(sums, at, flat)
        tokens, n = bags.column(token).combine_chunks(), bags.column("n").combine_chunks().flatten().to_numpy()
        which = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known.dictionary), -1).to_numpy()
        docs = bags.column(doc).combine_chunks().dictionary_encode(null_encoding="encode")
        owner = np.repeat(docs.indices.to_numpy(), tokens.value_lengths().to_numpy())
        met = np.flatnonzero(which >= 0)
        met = met[np.argsort(owner[met], kind="stable")]
        owner, which, n = owner[met], which[met], n[met]
        total, pooled = np.bincount(owner, n * times[which], len(docs.dictionary)), np.zeros((len(docs.dictionary), flat.shape[1]))
        for begin in range(0, len(met), 20_000):
            part = slice(begin, begin + 20_000)
            own, first = np.unique(owner[part], return_index=True)
            pooled[own] += np.add.reduceat(sums[which[part]] * n[part, None], first)
        some = np.flatnonzero(total > 0)
        mean = pooled[some] / total[some, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * flat.shape[1], pa.int32()), pa.array(mean.ravel()))
        return pa.Table.from_arrays([docs.dictionary.take(pa.array(some)), pa.array(total[some].astype(np.int64)), lists], [doc, "n_tokens", "pooled"])

    def guarded(bags: pa.Table, vectors: pa.Table) -> pa.Table:
        if bags.num_rows and vectors.num_rows:
            return work(bags, vectors)
        return pa.Table.from_arrays([pa.array([], bags.schema.field(doc).type), pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], [doc, "n_tokens", "pooled"])

    return guarded


def mean_pool(tokens: DataFrame, vectors: DataFrame, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """(doc, n_tokens, pooled): mean vector of a document's tokens that have one.

    `tokens` has (doc, token), `vectors` has (token, vector). A document moves as its distinct tokens and their numbers, and each group of
    documents, of some `POOLED` distinct tokens in all, gets the vectors of its tokens once. Counts are written to the checkpoint folder.
    """
    spark, kinds = tokens.sparkSession, dict(tokens.dtypes)
    path = scratch(spark, "tokens")
    known = tokens.where(F.col(token).isNotNull()).select(doc, token)
    known.mapInArrow(_counted(doc, token), f"`{doc}` {kinds[doc]}, `{token}` array<{kinds[token]}>, n array<bigint>").write.parquet(path)
    bags = spark.read.parquet(path)
    parts = 1 + (bags.agg(F.sum(F.size("n"))).first()[0] or 0) // POOLED
    bags = bags.withColumn("_part", F.pmod(F.xxhash64(doc), F.lit(parts)))
    needed = bags.select(F.col("_part").alias("_of"), F.explode(token).alias(token)).distinct()
    own = vectors.where("vector is not null").select(token, F.col("vector").cast("array<double>").alias("vector"))
    met = needed.join(own, token).select("_of", token, "vector")
    return bags.groupBy("_part").cogroup(met.groupBy("_of")).applyInArrow(_pooled(doc, token), f"`{doc}` {kinds[doc]}, n_tokens bigint, pooled array<double>")


# ---- thresholds and the registry -----------------------------------------------------------------------------------


def derive_thresholds(validation: DataFrame, score: Callable[[DataFrame], DataFrame], target: float = 0.025, short_words: int = 30) -> DataFrame:
    """One row (base, short): thresholds at the target share of false positives, for whole texts and for the same texts
    cut to `short_words` words. `score` adds `p` to rows with `text`."""
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), text.alias("text")) for name, text in (("base", F.col("text")), ("short", T.truncate_words(F.col("text"), short_words)))])
    rows = validation.where("label = 0").select("label", F.explode(kinds).alias("_k")).select("label", "_k.kind", "_k.text")
    picked = metrics.pick_threshold(score(rows), target, keys=("kind",))
    return picked.agg(F.max(F.when(F.col("kind") == "base", F.col("threshold"))).alias("base"), F.max(F.when(F.col("kind") == "short", F.col("threshold"))).alias("short"))


def recalibrate(scores: DataFrame, old: float, target: float) -> DataFrame:
    """(part, kind, threshold, n, fpr, recall) of the old threshold and of one picked anew on part `validation` of
    (part, label, p): what the change costs on each part."""
    new = metrics.pick_threshold(scores.where("part = 'validation'"), target).select(F.lit("new").alias("kind"), "threshold")
    both = new.unionByName(scores.sparkSession.range(1).select(F.lit("old").alias("kind"), F.lit(old).alias("threshold")))
    rows = scores.select("part", "label", "p").join(F.broadcast(both))  # two thresholds
    return metrics.fpr_recall_at(rows, F.col("threshold"), ("part", "kind", "threshold"))


@dataclass(frozen=True)
class Scorer:
    """A scorer: `add` gives rows with `text` a probability `p`; texts under `cutoff` words use the `short` threshold. One that is
    linear in the built-in features names its coefficients."""

    name: str
    add: Callable[[DataFrame], DataFrame]
    base: float = 0.86
    short: float | None = None
    cutoff: int | None = None
    linear: str | None = None


def _linear(name: str) -> Callable[[DataFrame], DataFrame]:
    def add(rows: DataFrame) -> DataFrame:
        return features.with_features(rows).withColumn("p", features.linear(name)).select(*rows.columns, "p")

    return add


SCORERS: dict[str, Scorer] = {"a": Scorer("a", _linear("a"), 0.834, 0.889, 40, "a"), "b": Scorer("b", _linear("b"), linear="b")}
ALIASES: dict[str, str] = {"default": "a"}


def register_scorer(scorer: Scorer, default: bool = False) -> Scorer:
    """Make a scorer known by its name, and as the default if asked."""
    SCORERS[scorer.name] = scorer
    if default:
        ALIASES["default"] = scorer.name
    return scorer


def get_scorer(name: str = "default") -> Scorer:
    name = ALIASES.get(name, name)
    if name not in SCORERS:
        raise KeyError(f"no scorer {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def _threshold(s: Scorer) -> Column:
    return T.threshold_for(F.col("n_words"), F.lit(s.base), F.lit(s.short).cast("double"), F.lit(s.cutoff).cast("int"))


def detect(rows: DataFrame, scorer: str | Scorer = "default") -> DataFrame:
    """`rows` with p, n_words, threshold and verdict by any scorer."""
    s = get_scorer(scorer) if isinstance(scorer, str) else scorer
    n = T.word_count(F.coalesce(F.col("text"), F.lit("")))
    return s.add(rows).withColumn("n_words", n).withColumn("threshold", _threshold(s)).withColumn("verdict", T.verdict(F.col("p"), F.col("threshold")))


def detect_each(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of `detect` for each scorer, with its name as `scorer`. Linear ones share one pass that takes the features."""
    found = [get_scorer(name) for name in names]
    parts = [detect(rows, s).withColumn("scorer", F.lit(s.name)) for s in found if s.linear is None]
    if shared := [s for s in found if s.linear is not None]:
        each = F.array(*[F.struct(features.linear(s.linear).alias("p"), _threshold(s).alias("threshold"), F.lit(s.name).alias("scorer")) for s in shared])
        scored = features.with_features(rows).select(*rows.columns, "n_words", F.explode(each).alias("_s"))
        parts.append(scored.select(*rows.columns, "_s.p", "n_words", "_s.threshold", T.verdict(F.col("_s.p"), F.col("_s.threshold")).alias("verdict"), "_s.scorer"))
    return reduce(DataFrame.unionByName, parts)
