"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return the documents they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontam, mixing, near_dup, quality, toxicity
from quillmark.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal toxicity model, fitted on the labelled rows of `docs`, does not grade toxic.

    Texts that are null or hold no words are judged by the model's base rate. Rows with a null id are judged but teach nothing; rows that
    repeat are judged alike; all columns pass; without labelled rows, and for an empty table, nothing is dropped.
    """
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3; the model is fitted on the labelled rows of `docs`.

    Null texts count as empty and are scored like any other. Rows that repeat are scored alike; rows with a null id are
    scored but teach nothing; all columns pass; an empty table gives no rows.
    """
    return quality.good_only(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 of their five-word shingles.

    Rows with a null id and texts without words stay; rows that repeat an id and a text stay once; extra columns pass.
    """
    return near_dup.first_copies(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Texts that are null or shorter than five words hold none; rows with a null id stay; of rows that share an id, one that
    holds an item takes all along; all columns pass; an empty table on either side drops nothing.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with `copies`, how often the mix takes each.

    A null source is a source of its own, the last; null and empty texts have no words and stay; rows that repeat an id
    share its digest and are taken alike; a column `copies` of the input is replaced; an empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: Trained classifiers decide the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's rows are written to the checkpoint folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
