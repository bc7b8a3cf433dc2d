"""Helpers the corpus operators share: lineage cuts, size-checked broadcasts, grouped Arrow streams, components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Megabytes of rows, as they lie in memory, that may be broadcast.
BROADCAST_MB = 16


def ship(name: str) -> None:
    """Pickle the functions of module `name` by value, so that executors need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared checkpoint folder and read back: later stages survive the loss of an
    executor, read only the columns they need, and are planned by real sizes (a checkpoint would carry along the size
    estimates of its plan, which in iterations grow to numbers that take minutes to multiply).

    The folder is that of the session's checkpoints, as `spark.checkpoint.dir` names it. Where it is unset, a temporary
    one serves a local master alone, as executors on other machines would not see it.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weight(df: DataFrame) -> int:
    """Bytes of the rows of `df`: 8 for each value, besides the bytes of strings and 8 for each item of an array."""
    each = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            each += F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            each += 8 * F.coalesce(F.size(name), F.lit(0))
    return df.agg(F.sum(each)).first()[0] or 0


def small(df: DataFrame, mb: float = BROADCAST_MB) -> DataFrame:
    """`df`, marked for broadcast if its rows take at most `mb` megabytes. Call it on tables that were cut, as it sums."""
    return F.broadcast(df) if weight(df) <= mb * 2**20 else df


def kept(key: tuple, make: Callable):
    """make(), once in each Python worker: for models and tables that tasks of one worker share."""
    held = vars(sys).setdefault("_quillmark_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def sampled(rows: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """At most `limit` rows, those with the smallest seeded digest of `key`: the same rows on every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(limit)


def in_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict | None], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Run `work` on each group of `keys`; it gets an Arrow table sorted by `order` and gives columns or None.

    Rows are dealt and sorted by Spark and streamed through one Python function per task; only one group is in memory.
    """
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames() if hasattr(StructType, "fromDDL") else [x.split()[0] for x in schema.split(",")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_grouper(keys, work, names), schema)


def _grouper(keys: list[str], work: Callable, names: list[str]) -> Callable:
    import numpy as np
    import pyarrow.compute as pc

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, bool)
            for key in keys:
                column = batch.column(batch.schema.get_field_index(key))
                differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
                null = column.is_null()  # two nulls are one key
                change |= pc.and_not(differ, pc.and_(null[1:], null[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(at, end - at)
                this = tuple(part.column(part.schema.get_field_index(key))[0].as_py() for key in keys) if at == 0 else None
                if held and not (at == 0 and this == last):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
            last = tuple(batch.column(batch.schema.get_field_index(key))[batch.num_rows - 1].as_py() for key in keys)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {name: [] for name in names}
        rows = 0
        for group in groups(batches):
            out = work(group)
            if out is not None:
                for name in names:
                    kept[name].append(pa.array(out[name]))
                rows += len(kept[names[0]][-1])
            if rows > 20_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(kept[name]) for name in names], names)
                kept, rows = {name: [] for name in names}, 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(kept[name]) for name in names], names)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (src, dst), longs: rows (node, component), component the smallest id reached.

    Each round lets every node point to its smallest neighbour, if that is smaller than itself, follows the pointers
    three at a time until none moves, and contracts the edges to the nodes pointed to. A chain of n nodes in any order
    of pointers takes log3(n) steps of a round. A node that stays has a neighbour that vanishes or else vanishes in the
    next round, so the nodes left at least halve in two rounds. All steps are joins and aggregations that combine before
    they shuffle. Nodes without an edge to another are not returned; no edges: no rows.
    """
    left = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("dst", "src"))
        point = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("to")))
        moved = True
        while moved:
            hop = small(point).select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = point.select("node", "to", F.col("to").alias("was"))
            for _ in range(2):
                step = step.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to"), "was")
            step = cut(step)
            moved = not step.where("to <> was").isEmpty()
            point = step.select("node", "to")
        hop = small(point)
        left = left.join(hop.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(hop.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        left = cut(left.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            step = hop.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = cut(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, component long")
