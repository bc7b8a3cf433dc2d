"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

Features are the words of a whole text and the words' beginnings, present or not, kept if labelled rows tie them to the
label, and the share of a text's distinct words that are tied, in steps. Grades are 0 for rows without the label and 1
to 3 for rows with it, by how often tied words occur, at the thirds of the labelled rows that hold one. One weight per
feature is shared by all ordered thresholds: P(grade > k) = sigmoid(w x - t_k). The fit is by gradient descent on the penalised likelihood; a document's severity is the expected grade, the
sum of P(grade > k), and it is toxic if P(grade > 0) is at least `CUT`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, sampled, ship

ship(__name__)

GRADES = 3
#: Bounds of the fit: labelled rows, words and beginnings kept as features; a feature's least documents and z score.
FIT_ROWS, FEATURES, LEAST_DOCS, LEAST_Z = 12_000, 2000, 4, 4.5
#: Letters of a beginning; steps of the share of tied words.
BEGINNINGS, SHARES = (3, 4, 5, 6), (0.01, 0.02, 0.03, 0.05, 0.08, 0.12)
KNOWN_WORDS = 1_000_000
PENALTY, STEPS, RATE = 2e-4, 800, 0.3
CUT = 0.5
WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts_of(word: str) -> list[str]:
    """The word and its beginnings, which end in a mark that no word holds."""
    return [word, *(word[:size] + "*" for size in BEGINNINGS if len(word) > size)]


class Ties(dict):
    """Features that each word of a text is tied by, kept while there are few words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = tuple(self.vocabulary[x] for x in parts_of(word) if x in self.vocabulary)
        return value

    def present(self, words: list[str]) -> list[int]:
        """Sorted features of a text, the steps of the share of tied words last."""
        distinct = set(words)
        hits = [found for word in distinct if (found := self[word])]
        steps = [len(self.vocabulary) + k for k, share in enumerate(SHARES) if hits and len(hits) >= share * len(distinct)]
        return sorted({k for found in hits for k in found}) + steps


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words and beginnings of each text, with the minimum hash of its word pairs, which near copies share."""
    for batch in batches:
        labels, parts, least = [], [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            found = {part for word in set(words) for part in parts_of(word)}
            parts.extend(found)
            labels.extend([label] * len(found))
            least.extend([min((xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1 for a, b in zip(words, words[1:])), default=0)] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(least, pa.int64()), pa.array(labels, pa.int32())], ["word", "least", "label"])


def _presence(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties = Ties(vocabulary)
        for batch in batches:
            sizes, present, tied = [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                tied.append(sum(1 for word in words if ties[word]))
                present.append(ties.present(words))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(tied, pa.int64()), pa.array(present, pa.list_(pa.int32()))], ["label", "n", "hits", "present"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """A model learned from at most `rows` labelled rows that are not held out, those with the smallest seeded digests
    of doc_id: {"words", "weights", "cuts"}. All of them are learned from, exact copies once. Near copies would tie their
    common words to one label, so a feature's support counts texts with the same minimum hash of word pairs once.
    Without rows of both labels it finds nothing toxic."""
    known = labels.where("toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = sampled(known, "doc_id", rows, "toxicity:")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = cut(texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("text", "label"))
    support = texts.mapInArrow(_distinct, "word string, least long, label int").groupBy("word", "least").agg(F.max("label").alias("label"))
    counts = support.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    none = {"words": {}, "weights": np.zeros(0), "cuts": np.full(GRADES, 10.0)}
    if not 0 < size.bad < size.n:
        return none
    share = size.bad / size.n
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    tied = counts.where(F.col("n") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(FEATURES).collect()
    if not tied:
        return none
    vocabulary = {row.word: k for k, row in enumerate(tied)}
    found = texts.mapInArrow(_presence(vocabulary), "label int, n long, hits long, present array<int>").collect()
    found.sort(key=lambda row: (row.label, row.n, row.present))
    hits, label = np.array([row.hits for row in found]), np.array([row.label for row in found])
    thirds = np.quantile(hits[(label == 1) & (hits > 0)], [1 / 3, 2 / 3])
    grade = np.where(label == 1, 1 + np.searchsorted(thirds, hits, side="left"), 0)
    owner = np.repeat(np.arange(len(found)), [len(row.present) for row in found])
    feature = np.array([k for row in found for k in row.present], np.int64)
    return {"words": vocabulary} | _ordinal(owner, feature, grade, len(vocabulary) + len(SHARES))


def _ordinal(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int) -> dict:
    """Maximum penalised likelihood of the cumulative-link model. Thresholds are a first one and positive gaps."""
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(GRADES)], 1e-4, 1 - 1e-4)
    cuts = np.log(1 / share - 1)
    theta = np.concatenate([np.zeros(n_features), [cuts[0]], np.log(np.maximum(np.diff(cuts), 0.05))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(owner, weights[feature], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        upper = np.concatenate([np.ones((n, 1)), above], 1)[np.arange(n), grade]
        lower = np.concatenate([above, np.zeros((n, 1))], 1)[np.arange(n), grade]
        inverse = 1 / np.maximum(upper - lower, 1e-9)
        slope_up, slope_low = upper * (1 - upper) * inverse, lower * (1 - lower) * inverse
        d_score = -(slope_up - slope_low) / n
        d_cut = np.zeros(GRADES)
        for k in range(GRADES):
            d_cut[k] = slope_up[grade == k + 1].sum() / n - slope_low[grade == k].sum() / n
        grad = np.concatenate([np.bincount(feature, d_score[owner], n_features) + PENALTY * weights, [d_cut.sum()], [d_cut[k + 1 :].sum() * gaps[k] for k in range(GRADES - 1)]])
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        theta = theta - RATE * (1 - step / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return {"weights": theta[:n_features], "cuts": theta[n_features] + np.concatenate([[0], np.cumsum(np.exp(theta[n_features + 1 :]))])}


def _grade(model: dict, keep: list[str]):
    """Adds severity, grade and toxic; the text is the last column and goes, all others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties, weights, cuts = Ties(model["words"]), model["weights"], model["cuts"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                score = np.zeros(part.num_rows)
                for k, text in enumerate(part.column(part.num_columns - 1)):
                    score[k] = sum(weights[i] for i in ties.present(words_of(text.as_py())))
                above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
                exact = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], 1)
                columns = [pa.array(above.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= CUT)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*keep, "severity", "grade", "toxic"])

    return run


def grade_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, severity, grade, toxic) of each row of `docs`: the expected grade (0 to 3), the likeliest, and whether
    any grade above 0 is at least as likely as not.

    Null and empty texts have no words and get the grade of a text without a tied word. Rows that repeat are each
    returned; a null doc_id is passed on; only doc_id and text are read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_grade(model, ["doc_id"]), "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` that are not toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, at = _grade(model, ["kept"]), names.index("text")
        for batch in batches:
            marked = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["kept", "text"])
            for part in grade(iter([marked])):
                begin = part.column(0)[0].as_py() if part.num_rows else 0
                good = pa.array(~part.column(3).to_numpy(zero_copy_only=False))
                yield batch.slice(begin, part.num_rows).filter(good)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
