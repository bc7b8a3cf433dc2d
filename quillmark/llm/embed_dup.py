"""Embedding near-duplicates: a forest of random-projection trees with spill, compared within leaves and unified.

A tree splits vectors at the median of a random direction, again and again; vectors near a split go to both sides
(spill). The upper levels are fitted on a bounded sample and sent to all tasks; leaves are counted over the whole table, and one
that holds more than `LEAF` rows is split further by thresholds over some `AT_SPLIT` of its rows. Only then are rows dealt
out, a few trees at a time, and with them 16-bit codes instead of vectors: codes decide all pairs but those closer to the limit
than the error that they can have, which vectors decide in double precision.

Dense groups would fill leaves of any size, so they are collapsed first. In each of `ROUNDS` rounds the rows of a leaf,
in blocks of at most `BLOCK`, elect leaders: a leader takes the vectors within half the linking angle, measured again
to the leader itself, so all of a leader's vectors link with each other and are counted without being compared. Only
leaders go through the forest. Two leaders' groups are linked or not as a whole if their angle and radii decide it;
else their vectors are compared one by one, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, in_groups, ship, small

ship(__name__)

#: Trees; rows of a leaf; rows of a block in an election; rounds of elections; share that goes to both sides.
TREES, LEAF, BLOCK, ROUNDS, SPILL = 10, 600, 1500, 3, 0.06
#: Bound of the sample on which upper levels are fitted, and the rows of it that a leaf of a tree keeps.
SAMPLE, SAMPLE_LEAF = 20_000, 64
#: Further levels for leaves that are still too large, and rows of such a leaf that its threshold is taken over, on average.
DEEPER, AT_SPLIT = 12, 512
#: Rows times trees that are dealt out at a time, and rows of which leaves are found together.
TURN, AT_ONCE = 500_000, 50_000
#: Largest number of a code's component, and what products of codes in single precision are allowed to be off.
LARGEST, SINGLE = 32767, 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def direction(seed: int, tree: int, node: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node]).normal(size=size)


def grow(sample: np.ndarray, seed: int, tree: int, per_leaf: int) -> dict[int, tuple[float, float, float]]:
    """Splits of one tree: node -> (threshold, lower and upper end of the spill); node k has children 2k and 2k + 1."""
    splits, todo = {}, [(1, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= per_leaf:
            continue
        along = sample[rows] @ direction(seed, tree, node, sample.shape[1])
        low, mid, high = np.quantile(along, [0.5 - SPILL, 0.5, 0.5 + SPILL])
        if not along.min() < mid <= along.max():
            continue
        splits[node] = (float(mid), float(low), float(high))
        todo += [(2 * node, rows[along < mid]), (2 * node + 1, rows[along >= mid])]
    return splits


def leaves(vectors: np.ndarray, splits: dict, seed: int, tree: int, spill: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each vector in one tree; with spill a row may have several leaves."""
    rows, found, todo = [], [], [(1, np.arange(len(vectors)))]
    while todo:
        node, at = todo.pop()
        if node not in splits or not len(at):
            rows.append(at)
            found.append(np.full(len(at), node))
            continue
        mid, low, high = splits[node]
        along = vectors[at] @ direction(seed, tree, node, vectors.shape[1])
        left, right = (along < high, along >= low) if spill else (along < mid, along >= mid)
        todo += [(2 * node, at[left]), (2 * node + 1, at[right])]
    return np.concatenate(rows), np.concatenate(found)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, step) of each vector: numbers of 16 bits and what they are to be multiplied by."""
    step = np.abs(vectors).max(1) / LARGEST
    return np.rint(vectors / step[:, None]).astype("<i2"), step


def decoded(code: pa.Array | pa.ChunkedArray, step: np.ndarray) -> np.ndarray:
    """The vectors of `codes`, in single precision."""
    held = np.frombuffer(b"".join(code.to_pylist()), "<i2")
    return held.reshape(len(code), -1).astype(np.float32) * step.astype(np.float32)[:, None]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vec) with code and step."""
    for batch in batches:
        if batch.num_rows:
            code, step = codes(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in code], pa.binary()), pa.array(step)], [*batch.schema.names, "code", "step"])


def _vectors(table: pa.Table) -> np.ndarray:
    """Vectors of rows that have code and step, or vec."""
    return decoded(table.column("code"), table.column("step").to_numpy()) if "code" in table.column_names else matrix(table.column("vec"))


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of `AT_ONCE` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _deal(forest, seed: int, trees: list[int], spill: bool):
    """Rows (tree, node) with all columns of the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _many(batches):
            vectors = _vectors(table)
            for tree in trees:
                rows, found = leaves(vectors, forest.value[tree], seed, tree, spill)
                part = table.take(pa.array(rows))
                part = part.add_column(0, "node", pa.array(found, pa.int64())).add_column(0, "tree", pa.array(np.full(len(rows), tree, np.int32)))
                yield from part.to_batches(max_chunksize=10_000)

    return run


def _sizes(forest, seed: int, trees: list[int], spill: bool):
    """Rows (tree, node, n): how many rows of a table go to a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _many(batches):
            vectors = _vectors(table)
            for tree in trees:
                node, n = np.unique(leaves(vectors, forest.value[tree], seed, tree, spill)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree, np.int32)), pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["tree", "node", "n"])

    return run


def _along(forest, large, seed: int, trees: list[int], spill: bool):
    """Rows (tree, node, along) of rows in leaves that are too large, some `AT_SPLIT` of a leaf, chosen by a digest of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _many(batches):
            vectors = _vectors(table)
            # a number below 2^32 for each id
            digest = (table.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
            for tree in trees:
                rows, found = leaves(vectors, forest.value[tree], seed, tree, spill)
                order = np.argsort(found, kind="stable")
                nodes, starts = np.unique(found[order], return_index=True)
                for node, at in zip(nodes.tolist(), np.split(rows[order], starts[1:])):
                    if (tree, node) in large.value:
                        at = at[digest[at] < AT_SPLIT / large.value[tree, node] * 2**32]
                        along = vectors[at] @ direction(seed, tree, node, vectors.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(np.full(len(at), node), pa.int64()), pa.array(along, pa.float64())], ["tree", "node", "along"])

    return run


def planted(points: DataFrame, seed: int, trees: list[int], spill: bool) -> tuple[dict[int, dict], dict[tuple[int, int], int]]:
    """(forest, wide): the splits of each of `trees` over `points`, rows of vec_id and of vec, or of code and step, with leaves of at
    most `LEAF` rows if `DEEPER` more levels suffice, and how many rows those leaves have that hold more than `BLOCK`."""
    spark = points.sparkSession
    count = points.count()
    vector = [c for c in points.columns if c in ("vec", "code", "step")]
    chosen = points.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select(vector).toArrow()
    sample = _vectors(chosen) if chosen.num_rows else np.zeros((0, 1))
    per_leaf = max(SAMPLE_LEAF if count > SAMPLE else 2, int(LEAF * len(sample) / max(1, count) / 2))
    forest = {tree: grow(sample, seed, tree, per_leaf) for tree in trees}
    whole: set[tuple[int, int]] = set()
    rows = points.select("vec_id", *vector)
    for level in range(DEEPER + 1):
        sent = spark.sparkContext.broadcast(forest)
        sizes = rows.mapInArrow(_sizes(sent, seed, trees, spill), "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).where(F.col("n") > LEAF).collect()
        # a leaf whose rows all lie at one place stays as it is
        large = {(r.tree, r.node): r.n for r in sizes if (r.tree, r.node) not in whole}
        if not large or level == DEEPER:
            break
        along = rows.mapInArrow(_along(sent, spark.sparkContext.broadcast(large), seed, trees, spill), "tree int, node long, along double")
        at = [0.5 - SPILL, 0.5, 0.5 + SPILL]
        for r in along.groupBy("tree", "node").agg(F.percentile_approx("along", at, 1000).alias("q"), F.min("along").alias("lo")).collect():
            if r.q[1] > r.lo:
                forest[r.tree][r.node] = (r.q[1], r.q[0], r.q[2])
            else:
                whole.add((r.tree, r.node))
    return forest, {(r.tree, r.node): r.n for r in sizes if r.n > BLOCK}


def _elect(least: float):
    """In a block: rows (vec_id, leader, near) of those that a leader takes, with the cosine of the two."""

    def work(group: pa.Table) -> dict | None:
        if group.num_rows < 2:
            return None
        ids, vectors = group.column("vec_id").to_numpy(), matrix(group.column("vec"))
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        cosines = vectors @ vectors.T
        near = cosines >= least
        leader, free = np.full(len(ids), -1), near.sum(1) > 1
        for i in np.flatnonzero(free):
            if leader[i] < 0:
                leader[near[i] & (leader < 0) & free] = i
        own = (leader >= 0) & (leader != np.arange(len(ids)))
        if not own.any():
            return None
        return {"vec_id": ids[own], "leader": ids[leader[own]], "near": cosines[own, leader[own]]}

    return work


def _compare(cosine: float):
    """In a leaf: rows (a, b, cos, off) of leaders whose groups may link, a < b: the cosine of their codes and the most that it is off."""

    def work(group: pa.Table) -> dict | None:
        if group.num_rows < 2:
            return None
        ids, radius, step, vectors = group.column("vec_id").to_numpy(), group.column("r").to_numpy(), group.column("step").to_numpy(), decoded(group.column("code"), group.column("step").to_numpy())
        # half a step in each component; codes are as much longer than vectors
        short = step * np.sqrt(vectors.shape[1]) / 2
        angle = np.arccos(cosine)
        a, b, c, d = [], [], [], []
        for at in range(0, len(ids), 1000):
            close = np.clip(vectors[at : at + 1000] @ vectors.T, -1, 1)
            off = short[at : at + 1000, None] * (1 + short[None, :]) + short[None, :] + SINGLE
            i, j = np.nonzero(close >= np.cos(np.minimum(np.pi, angle + radius[at : at + 1000, None] + radius[None, :])) - off)
            keep = ids[i + at] < ids[j]
            i, j = i[keep], j[keep]
            a.append(ids[i + at])
            b.append(ids[j])
            c.append(close[i, j].astype(np.float64))
            d.append(off[i, j])
        a, b, c, d = np.concatenate(a), np.concatenate(b), np.concatenate(c), np.concatenate(d)
        return {"a": a, "b": b, "cos": c, "off": d} if len(a) else None

    return work


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors, in double precision; null for vectors that can link with nothing."""
    for batch in batches:
        ids, vecs = [], []
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            vector = np.array([np.nan if x is None else x for x in values or []], np.float64)
            size = np.sqrt(vector @ vector) if len(vector) else 0.0
            good = len(vector) and np.isfinite(vector).all() and np.isfinite(size) and size > 0
            ids.append(key)
            vecs.append((vector / size).tolist() if good else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64()))], ["vec_id", "vec"])


def _whole(cosine: float):
    """In a group that is a leaf of its own: rows (vec_id, class, n) of all its vectors."""

    def work(group: pa.Table) -> dict | None:
        ids, vectors = group.column("vec_id").to_numpy(), matrix(group.column("vec"))
        near = vectors @ vectors.T >= cosine
        np.fill_diagonal(near, True)
        part, before = np.arange(len(ids)), None
        while before is None or (part != before).any():
            before = part
            part = np.where(near, part[None, :], len(ids)).min(1)
            part = part[part]
        return {"vec_id": ids, "class": ids[part], "n": near.sum(1) - 1}

    return work


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors` (vec_id, embedding).

    Vectors link with cosine >= `cosine` in double precision, whatever their number of components, with those of as many
    components; those that are null, empty, zero or hold null or non-finite components link with nothing. Rows that
    repeat a vec_id and a vector are one vector, and each is returned; rows that share a vec_id but not a vector are
    linked by their own vectors. A row with a null vec_id links with nothing, has a null component_id and is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    every = cut(asked.mapInArrow(_clean, "vec_id long, vec array<double>").withColumn("row", F.monotonically_increasing_id()))
    good, key = every.where("vec is not null and vec_id is not null"), ["row"]
    if not good.groupBy("vec_id").count().where("count > 1").isEmpty():
        good, key = cut(good.groupBy("vec_id", "vec").agg(F.min("row").alias("row"))), ["vec_id", "vec"]

    # the commonest length goes through the forest, and each other that one leaf cannot hold; the rest are a leaf each
    sizes = cut(good.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("rows")))
    usual = sizes.orderBy(F.desc("rows"), "size").limit(1)
    large = [row["size"] for row in sizes.where(F.col("rows") > LEAF).union(usual).distinct().collect()]
    points = good.select(F.col("row").alias("vec_id"), "vec")
    filed = in_groups(points.where(~F.size("vec").isin(large)).withColumn("size", F.size("vec")), ["size"], _whole(cosine), "vec_id long, class long, n long")
    for size in large:
        filed = filed.unionByName(_linked(points.where(F.size("vec") == size), cosine))
    filed = good.join(filed.withColumnRenamed("vec_id", "row"), "row").select(*key, F.col("vec_id").alias("id"), "class", "n")

    # a class is named by the smallest vec_id of all its vectors
    filed = cut(filed)
    least = small(cut(filed.groupBy("class").agg(F.min("id").alias("component"), F.count("*").alias("rows")).where("rows > 1").select("class", "component")))
    named = every.join(filed.join(least, "class", "left").select(*key, "component", "n"), key, "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _cut(df: DataFrame) -> DataFrame:
    """`cut`, with the shuffles that it took removed as soon as the table is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, True)
    try:
        return cut(df.select("*"))  # planned anew, under this setting
    finally:
        conf.set(key, before)


def _blocks(dealt: DataFrame, wide: dict[tuple[int, int], int]) -> DataFrame:
    """`dealt` with the number of blocks of its leaf, 1 for leaves of at most `BLOCK` rows."""
    if not wide:
        return dealt.withColumn("blocks", F.lit(1))
    sizes = dealt.sparkSession.createDataFrame([(*leaf, -(-n // BLOCK)) for leaf, n in wide.items()], "tree int, node long, blocks int")
    return dealt.join(small(sizes), ["tree", "node"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _linked(good: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, class, n): of each of `good` (vec_id, vec), unit vectors of one length with an id each, the class that
    links reach, named by one of its ids, and the number of vectors that it links with."""
    half = float(np.cos(np.arccos(cosine) / 2 - 1e-6))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    spark = good.sparkSession
    vec = lambda key, name: good.select(F.col("vec_id").alias(key), F.col("vec").alias(name))

    # elections: of each vector its leader, whose angle to it is at most half the linking angle; vectors don't travel along
    member = cut(good.select("vec_id", F.col("vec_id").alias("leader"), F.lit(1.0).alias("near")))
    points = good.select("vec_id", "vec")
    for k in range(ROUNDS):
        forest, wide = planted(points, 100 + k, [0], False)
        dealt = points.mapInArrow(_deal(spark.sparkContext.broadcast(forest), 100 + k, [0], False), "tree int, node long, vec_id long, vec array<double>")
        blocks = _blocks(dealt, wide).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
        taken = _cut(in_groups(blocks.select("node", "block", "vec_id", "vec"), ["node", "block"], _elect(half), "vec_id long, leader long, near double"))
        if taken.isEmpty():
            continue
        step = small(taken.select(F.col("vec_id").alias("leader"), F.col("leader").alias("next"), F.col("near").alias("next_near")))
        moved = member.join(step, "leader", "left")
        # vectors that the next leader does not reach stay with theirs
        if k:
            led = _cut(moved.where("next is not null and vec_id <> leader").select("vec_id", "next"))
            led = _cut(led.join(vec("vec_id", "x"), "vec_id").join(vec("next", "y"), "next").select("vec_id", dot("x", "y").alias("led_near")))
            moved = moved.join(small(led), "vec_id", "left").withColumn("next_near", F.when(F.col("vec_id") == F.col("leader"), F.col("next_near")).otherwise(F.col("led_near")))
        reached = F.col("next").isNotNull() & (F.col("next_near") >= half)
        member = _cut(moved.select("vec_id", F.when(reached, F.col("next")).otherwise(F.col("leader")).alias("leader"), F.when(reached, F.col("next_near")).otherwise(F.col("near")).alias("near")))
        # a leader that was taken but still has vectors it must keep leads them on
        points = _cut(member.select(F.col("leader").alias("vec_id")).distinct().join(good, "vec_id").select("vec_id", "vec"))
    coded = points.mapInArrow(_coded, "vec_id long, vec array<double>, code binary, step double").select("vec_id", "code", "step")
    points = _cut(_leaders(member.join(points, "vec_id", "left")).drop("vec").join(coded, "vec_id"))

    count, pairs = points.count(), None
    turn = max(1, TURN // max(1, count))
    for at in range(0, TREES, turn):
        trees = list(range(at, min(TREES, at + turn)))
        forest, wide = planted(points, 7, trees, True)
        dealt = points.select("vec_id", "code", "step", "r").mapInArrow(_deal(spark.sparkContext.broadcast(forest), 7, trees, True), "tree int, node long, vec_id long, code binary, step double, r double")
        keys = ["tree", "node"]
        if wide:
            # a leaf that no level could split is compared in blocks, each pair of blocks in a task
            keys = ["tree", "node", "i", "j"]
            dealt = _blocks(dealt, wide).withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tree", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "vec_id", "code", "step", "r")
        found = _cut(in_groups(dealt, keys, _compare(cosine), "a long, b long, cos double, off double").dropDuplicates(["a", "b"]))
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.dropDuplicates(["a", "b"])
    about = small(points.select("vec_id", "r", "m"))
    pairs = pairs.join(about.select(F.col("vec_id").alias("a"), F.col("r").alias("ra"), F.col("m").alias("ma")), "a").join(about.select(F.col("vec_id").alias("b"), F.col("r").alias("rb"), F.col("m").alias("mb")), "b")
    angle, limit = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cos") - F.col("off"), F.lit(1.0)))), float(np.arccos(cosine))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    decided = F.when(single & (F.col("cos") - F.col("off") >= cosine), True).when(single & (F.col("cos") + F.col("off") < cosine), False)
    pairs = _cut(pairs.withColumn("whole", decided.when(~single & (angle + F.col("ra") + F.col("rb") <= limit - 1e-6), True)))
    whole = pairs.where("whole")
    # the other pairs of groups are compared vector by vector, in blocks of one group against the other
    open_ = pairs.where("whole is null").select("a", "b", F.ceil(F.col("ma") / BLOCK).cast("int").alias("na"), F.ceil(F.col("mb") / BLOCK).cast("int").alias("nb"))
    open_ = small(cut(open_))
    own, each = lambda n: F.pmod(F.xxhash64("vec_id"), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - F.lit(1).cast("long")))
    x = open_.join(member.select(F.col("leader").alias("a"), "vec_id"), "a").select("a", "b", own("na").alias("i"), each("nb").alias("j"), F.lit(0).alias("side"), "vec_id")
    y = open_.join(member.select(F.col("leader").alias("b"), "vec_id"), "b").select("a", "b", each("na").alias("i"), own("nb").alias("j"), F.lit(1).alias("side"), "vec_id")
    sides = x.unionByName(y).join(good.select("vec_id", "vec"), "vec_id")
    single_links = _cut(in_groups(sides, ["a", "b", "i", "j"], _between(cosine), "vec_id long, links long, a long, b long", ("side", "vec_id")))

    by_leader = whole.select(F.col("a").alias("leader"), F.col("mb").alias("n")).unionByName(whole.select(F.col("b").alias("leader"), F.col("ma").alias("n"))).groupBy("leader").agg(F.sum("n").alias("by_leader"))
    by_vector = single_links.groupBy("vec_id").agg(F.sum("links").alias("by_vector"))
    groups = components(whole.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(single_links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    named = cut(points.select(F.col("vec_id").alias("leader"), "m").join(small(groups), F.col("leader") == F.col("node"), "left").select("leader", "m", F.coalesce("component", "leader").alias("class")).join(small(cut(by_leader)), "leader", "left"))
    filed = member.select("vec_id", "leader").join(small(named), "leader").join(small(cut(by_vector)), "vec_id", "left")
    return filed.select("vec_id", "class", (F.col("m") - 1 + F.coalesce("by_leader", F.lit(0)) + F.coalesce("by_vector", F.lit(0))).alias("n"))


def _leaders(member: DataFrame) -> DataFrame:
    """Points of the forest: each leader with its vector, the largest angle to one of its vectors, and their number.
    Only a leader alone has radius 0: the one vector left may be another, if a later round took the leader itself."""
    sums = member.groupBy("leader").agg(F.acos(F.least(F.min("near"), F.lit(1.0))).alias("r"), F.count("*").alias("m"), (F.min("vec_id") == F.col("leader")).alias("first"))
    own = member.select(F.col("vec_id").alias("leader"), "vec")
    return sums.join(own, "leader").select(F.col("leader").alias("vec_id"), "vec", F.when((F.col("m") == 1) & F.col("first"), 0.0).otherwise(F.greatest("r", F.lit(1e-7))).alias("r"), "m")


def _between(cosine: float):
    """Links of each vector of two blocks, one of each of two groups: rows (vec_id, links, a, b) with links > 0."""

    def work(group: pa.Table) -> dict | None:
        side, ids, vectors = group.column("side").to_numpy(), group.column("vec_id").to_numpy(), matrix(group.column("vec"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(x), 500):
            met = vectors[x[at : at + 500]] @ vectors[y].T >= cosine
            links[x[at : at + 500]] += met.sum(1)
            links[y] += met.sum(0)
        got = links > 0
        if not got.any():
            return None
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        return {"vec_id": ids[got], "links": links[got], "a": np.full(got.sum(), a), "b": np.full(got.sum(), b)}

    return work
