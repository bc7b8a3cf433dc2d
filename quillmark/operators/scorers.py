"""Scorers over models from files: a saved pipeline, loaded by name, and any Python model, shipped to the workers.

Both are registered like the linear ones, so detection over batches and streams takes any of them by name.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from .models import Scorer, register_scorer

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pipeline_scorer(name: str, path: str, prepare: Callable[[DataFrame], DataFrame] = features.with_features, base: float = 0.86, short: float | None = None, cutoff: int | None = None) -> Scorer:
    """Register the pipeline saved at `path`. It gets the rows that `prepare` gives (by default with the features of `text`) and adds
    a probability vector, of which the second entry is taken, or a column `p`."""
    model = PipelineModel.load(path)

    def add(rows: DataFrame) -> DataFrame:
        done = model.transform(prepare(rows))
        p = vector_to_array("probability")[1] if "probability" in done.columns else F.col("p")
        return done.select(*rows.columns, p.cast("double").alias("p"))

    return register_scorer(Scorer(name, add, base, short, cutoff))


def _held(key: str, load: Callable[[], Any]) -> Any:
    """What `load` gives, once in each Python worker."""
    models = vars(sys).setdefault("_quillmark_models", {})
    if key not in models:
        models[key] = load()
    return models[key]


def pandas_scorer(
    spark: SparkSession, name: str, path: str, load: Callable[[str], Any], predict: Callable[[Any, pd.DataFrame], Sequence[float]],
    columns: Sequence[str] = features.FEATURES, prepare: Callable[[DataFrame], DataFrame] = features.with_built_in_features, base: float = 0.86, short: float | None = None, cutoff: int | None = None,
) -> tuple[Scorer, Any]:
    """Register a Python model, and give its scorer and an accumulator that counts loads.

    The file at `path` goes to each executor once; `load` gets its local path and gives the model, once in each worker;
    `predict` gets the model and Arrow batches of `columns` as a frame and gives a probability for each row. File names must differ between
    models of one session. `load` and `predict` travel with the job.
    """
    spark.sparkContext.addFile(path)
    file = path.rstrip("/").rsplit("/", 1)[-1]
    loads = spark.sparkContext.accumulator(0)

    def loaded() -> Any:
        loads.add(1)
        return load(SparkFiles.get(file))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = _held(f"{name}:{file}", loaded)
        for frame in batches:
            yield pd.Series(predict(model, frame), dtype="float64")

    def add(rows: DataFrame) -> DataFrame:
        return prepare(rows).withColumn("p", score(F.struct(*columns))).select(*rows.columns, "p")

    return register_scorer(Scorer(name, add, base, short, cutoff)), loads
