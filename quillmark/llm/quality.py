"""Quality: regularised quadratic discriminant over transformed statistics of whole texts.

Each text becomes a short vector of statistics (shares of letters, capitals, digits, symbols and separators, word
lengths, repetition of words and lines), logged so that classes are nearer to normal. Each class has a mean and a
covariance that is shrunk to the pooled one and to its diagonal; its Cholesky factor is kept with the model. A score is
the posterior of label 1 from the difference of log densities: Mahalanobis distances by one triangular product each,
log determinants and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, ship

ship(__name__)

#: Bound of the fit: labelled rows.
FIT_ROWS = 20_000
#: Shrinkage to the pooled covariance, to the diagonal, and the ridge.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
CUT = 0.3

_CLASS = np.zeros(256, np.int8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\x0b\x0c\r")] = 4
_CLASS[10] = 5
_CLASS[list(b".,;:'\"-()?")] = 6
_CLASS[list(b"!")] = 7
_CLASS[list(b"|")] = 8
_CLASS[128:] = 9
# all else, as % & * # $ @, is class 0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; those of a null text are those of an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) if n else np.zeros(10, int)
    words = raw.split()
    count = len(words)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    odd = lambda k, scale: np.log1p(scale * k / (n + 20))
    letters = kinds[1] + kinds[2] + kinds[9]
    # of capitals, the first of each sentence or line is no sign
    capitals = max(0, int(kinds[2]) - raw.count(b". ") - len(lines) - raw.count(b"!"))
    return [
        odd(kinds[0], 200), odd(capitals, 100), odd(kinds[3], 100), odd(kinds[7], 200), odd(kinds[8], 200), odd(kinds[6], 50),
        np.log((letters + 1) / (n + 2)), np.log((n + 1) / (count + 1)), np.log((distinct + 1) / (count + 1)) / np.log(count + 3),
        np.log((len(set(lines)) + 1) / (len(lines) + 1)), np.log1p(count), np.log1p(count / len(lines)),
    ]


N = 12


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(text.as_py()) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "stats"])


def fit_discriminant(x: np.ndarray, y: np.ndarray) -> dict:
    """Means, inverse Cholesky factors and log terms of both classes."""
    scale = x.std(0) + 1e-9
    z = (x - x.mean(0)) / scale
    centre = [z[y == k].mean(0) for k in (0, 1)]
    within = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    share = np.array([(y == k).mean() for k in (0, 1)])
    pooled = share[0] * within[0] + share[1] * within[1]
    model = {"shift": x.mean(0), "scale": scale, "centre": centre, "whiten": [], "offset": []}
    for k in (0, 1):
        cov = (1 - TO_POOLED) * within[k] + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        model["whiten"].append(np.linalg.inv(factor))
        model["offset"].append(np.log(share[k]) - np.log(np.diag(factor)).sum())
    return model


def posterior(x: np.ndarray, model: dict | None) -> np.ndarray:
    """P(label 1); one half without a model."""
    if model is None:
        return np.full(len(x), 0.5)
    z = (x - model["shift"]) / model["scale"]
    log = [model["offset"][k] - 0.5 * (((z - model["centre"][k]) @ model["whiten"][k].T) ** 2).sum(1) for k in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """A model learned from at most `rows` labelled rows that are not held out, those with the smallest seeded digests
    of doc_id; None if they do not hold two rows of each label."""
    known = labels.where("quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    chosen = sampled(known, "doc_id", rows, "quality:")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
    found = sorted((row.label, *row.stats) for row in texts.mapInArrow(_measure, "label int, stats array<double>").collect())
    y, x = np.array([row[0] for row in found]), np.array([row[1:] for row in found])
    return fit_discriminant(x, y) if len(y) and min((y == 0).sum(), (y == 1).sum()) > 1 else None


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = np.array([statistics(text.as_py()) for text in part.column(1)]).reshape(-1, N)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(posterior(found, model))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`; predicted is 1 from a score of 0.3.

    Null and empty texts are scored by the statistics of an empty text; without a model every score is one half. Rows
    that repeat are each returned; a null doc_id counts as not held out; only doc_id and text are read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_score(model), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_only(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of `docs` with a score of at least 0.3, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            found = np.array([statistics(text.as_py()) for text in batch.column(at)]).reshape(-1, N)
            yield batch.filter(pa.array(posterior(found, model) >= CUT))

    return docs.mapInArrow(run, docs.schema)
