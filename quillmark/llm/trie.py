"""Conversation prefix trie: shared beginnings of conversations as nodes, with subtree totals by time-forward processing.

A node's name is a polynomial digest (two moduli of 61 bits in effect) of the turns from the start, so a conversation's
names are a running fold of its turns. Turns are dealt and sorted by range of (conversation, order); each task folds what
lies in its range, and what a conversation holds in earlier ranges is composed in afterwards, so that no conversation has
to fit in one task. The trie is cut into shards of bounded size: a node with more than `HEAVY` members is a shard of its
own, what hangs below such nodes are shards of at most `HEAVY` conversations, cut again every `BAND` turns. Totals then go
forward in time, deepest level first: nodes are sorted by Spark in reverse level order, and each sends its total to its
parent through a priority queue that spills. That is done across shard roots first, from the shards' plain sums, and then
within shards, where what the roots of lower shards send is added to the node that they hang on.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small

ship(__name__)

#: Members from which on a node is a shard of its own; turns after which a shard is cut; shard roots that one task takes.
HEAVY, BAND, ROOTS = 64, 32, 500_000
#: Messages that a queue keeps in memory; ids that are joined to one string before they are hashed.
QUEUE, IDS = 100_000, 4096
PRIME, BASES = 2**61 - 1, (1_640_531_527_000_011, 6_364_136_223_846_793)
NAME = "a long, b long, pa long, pb long"


class Messages:
    """A priority queue of (address, leaves, saved). Beyond `limit` messages in memory, they go as a sorted run to a file
    without a name, which ends with the task, and are merged back as they fall due."""

    def __init__(self, limit: int):
        self.limit, self.near, self.runs, self.heads = limit, [], [], []

    def send(self, address: tuple, leaves: int, saved: int) -> None:
        heapq.heappush(self.near, (address, leaves, saved))
        if len(self.near) > self.limit:
            run = tempfile.TemporaryFile()
            for item in sorted(self.near):
                pickle.dump(item, run)
            run.seek(0)
            self.near = []
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    def _next(self, run: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(self.runs[run]), run))
        except EOFError:
            self.runs[run].close()

    def due(self, address: tuple) -> tuple[int, int]:
        """The sums of all messages to `address`, which leave the queue."""
        leaves = saved = 0
        while self.near and self.near[0][0] == address:
            _, more, kept = heapq.heappop(self.near)
            leaves, saved = leaves + more, saved + kept
        while self.heads and self.heads[0][0][0] == address:
            (_, more, kept), run = heapq.heappop(self.heads)
            leaves, saved = leaves + more, saved + kept
            self._next(run)
        return leaves, saved

    def __bool__(self) -> bool:
        return bool(self.near or self.heads)


def _forward(limit: int):
    """Rows (sa, sb, a, b, level, pa, pb, above, leaves, saved) in order of shard, falling level and name, with totals: `above`
    is the level of the parent, or null where a shard ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Messages(limit)
        for batch in batches:
            columns = batch.to_pydict()
            for i, (sa, sb, a, b, level, up, left, above) in enumerate(zip(*(columns[c] for c in ("sa", "sb", "a", "b", "level", "pa", "pb", "above")))):
                leaves, saved = queue.due((sa, sb, -level, a, b))
                columns["leaves"][i] += leaves
                columns["saved"][i] += saved
                if above is not None:
                    queue.send((sa, sb, -above, up, left), columns["leaves"][i], columns["saved"][i])
            yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)
        if queue:
            raise RuntimeError("a total was sent to a node that is not there")

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within this task's range and fold them."""
    from pyspark import TaskContext

    part, last, at, a, b = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        found = {name: [] for name in ("at", "a", "b", "pa", "pb")}
        for conv, x, y in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "x", "y"))):
            if conv != last:
                last, at, a, b = conv, 0, 0, 0
            found["pa"].append(a)
            found["pb"].append(b)
            at, a, b = at + 1, (a * BASES[0] + x + 1) % PRIME, (b * BASES[1] + y + 1) % PRIME
            for name, value in (("at", at), ("a", a), ("b", b)):
                found[name].append(value)
        names = ["conv_id", "x", "y", "size"]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {n: pa.array(v, pa.int64()) for n, v in found.items()} | {"part": pa.array([part] * batch.num_rows, pa.int64())})


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put what a conversation holds in earlier ranges (n0 turns, folded to a0 and b0) before its turns in this one."""
    for batch in batches:
        columns = batch.to_pydict()
        for i, (at, n, a, b) in enumerate(zip(*(columns[c] for c in ("at", "n0", "a0", "b0")))):
            for base, start, name, before in ((BASES[0], a, "a", "pa"), (BASES[1], b, "b", "pb")):
                power = pow(base, at - 1, PRIME)
                columns[before][i] = (start * power + columns[before][i]) % PRIME
                columns[name][i] = (start * power * base + columns[name][i]) % PRIME
            columns["at"][i] = at + n
        yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)


def chained(turns: DataFrame, order: list[str]) -> DataFrame:
    """Rows (conv_id, x, y, size, at, a, b, pa, pb) of turns (conv_id, `order`, x, y, size): the place of a turn in its conversation, from
    1, the name of the prefix that ends with it, and the name of the prefix before it. Ties in `order` go by x and y.

    What a conversation leaves over at the end of a range is one row for each range: those few rows alone pass the driver.
    """
    keys = ["conv_id", *order, "x", "y"]
    schema = "conv_id long, x long, y long, size long, at long, a long, b long, pa long, pb long, part long"
    rows = cut(turns.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_folded, schema))
    ends = rows.groupBy("conv_id", "part").agg(F.max(F.struct("at", "a", "b")).alias("end"))
    split = ends.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends")).where("n > 1")
    before = []
    for conv, _, parts in split.toLocalIterator():
        n = a = b = 0
        for part, (more, x, y) in parts:
            before.append((conv, part, n, a, b))
            n, a, b = n + more, (a * pow(BASES[0], more, PRIME) + x) % PRIME, (b * pow(BASES[1], more, PRIME) + y) % PRIME
    names = ["conv_id", "x", "y", "size", "at", "a", "b", "pa", "pb"]
    if not before:
        return rows.select(names)
    before = F.broadcast(turns.sparkSession.createDataFrame(before, "conv_id long, part long, n0 long, a0 long, b0 long").where("n0 > 0"))
    late = rows.join(before, ["conv_id", "part"])
    late = late.mapInArrow(_composed, late.schema).select(names)
    return cut(rows.join(before, ["conv_id", "part"], "left_anti").select(names).unionByName(late))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, y, size): digests of role and text, of which null counts as empty, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("d"), F.octet_length(text).cast("long").alias("size"))
    x, y = (F.conv(F.substring("d", k, 15), 16, 10).cast("long") for k in (1, 16))
    return rows.select("conv_id", "turn", x.alias("x"), y.alias("y"), "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, x, y, size) of conversations that take their first h turns from conversation c - c % 5 and what follows
    their own first h turns from themselves, with h the crc32 of the decimal id modulo 9; and all ids."""
    known = chained(turn_rows(conversations), ["turn"]).select("conv_id", "at", "x", "y", "size")
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    ids = cut(known.select("conv_id").distinct())
    first = known.where("conv_id % 5 = 0 and at <= 8").withColumnRenamed("conv_id", "base")
    lead = ids.withColumn("base", F.expr("conv_id - conv_id % 5")).join(first, "base").where(F.col("at") <= h)
    names = ["conv_id", F.col("at").alias("turn"), "x", "y", "size"]
    return lead.select(names).union(known.where(F.col("at") > h).select(names)), ids


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, by node, to strings of at most `IDS` of them."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id")))

    out = []
    for (a, b), group in groupby(rows(), lambda r: r[:2]):
        held = []
        for _, _, conv in group:
            held.append(conv)
            if len(held) == IDS:
                out.append((a, b, held[0], ",".join(map(str, held))))
                held = []
        if held:
            out.append((a, b, held[0], ",".join(map(str, held))))
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "first", "ids"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each node, which stream by in order."""
    last, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([digest.hexdigest()])], ["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) == last:
                digest.update(b",")
            else:
                if last is not None:
                    yield row()
                last, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
    if last is not None:
        yield row()


def _root_totals(shards: DataFrame) -> DataFrame:
    """(pa, pb, leaves, saved): what shard roots send to the nodes that they hang on, from the shards' own sums.

    Shards without lower ones send at once, in a grouping; what stays, heavy nodes and shards of long conversations, goes
    through one queue, or as long as it is too much for a task, through another grouping.
    """
    sent = []
    while True:
        inner = shards.where("psa is not null").select(F.col("psa").alias("sa"), F.col("psb").alias("sb")).distinct()
        outer = cut(shards.join(inner, ["sa", "sb"], "left_anti"))
        sent.append(outer)
        lower = outer.where("psa is not null").groupBy(F.col("psa").alias("sa"), F.col("psb").alias("sb")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("kept"))
        rest = shards.join(inner, ["sa", "sb"], "left_semi").join(lower, ["sa", "sb"], "left")
        shards = cut(rest.withColumn("leaves", F.col("leaves") + F.coalesce("more", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("kept", F.lit(0))).drop("more", "kept"))
        if shards.count() <= ROOTS:
            break
    tree = shards.select(F.lit(0).cast("long").alias("sa"), F.lit(0).cast("long").alias("sb"), F.col("sa").alias("a"), F.col("sb").alias("b"), "level", F.col("psa").alias("pa"), F.col("psb").alias("pb"), F.col("up").alias("above"), "leaves", "saved", F.col("pa").alias("to_a"), F.col("pb").alias("to_b"))
    tree = tree.repartition(1).sortWithinPartitions(F.desc("level"), "a", "b")
    sent.append(tree.mapInArrow(_forward(QUEUE), tree.schema).select(F.col("to_a").alias("pa"), F.col("to_b").alias("pb"), "leaves", "saved"))
    rows = sent[-1]
    for outer in sent[:-1]:
        rows = rows.unionByName(outer.select("pa", "pb", "leaves", "saved"))
    return rows.where("pa is not null").groupBy("pa", "pb").agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))


def prefix_trie(turns: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """The trie of conversations: a row for each distinct sequence of first turns, the root, without turns, included.

    `turns` holds (conv_id, `order`, x, y, size), with x and y digests of a turn below 2^60; `ids` every conversation, those without turns too.
    Columns: a, b (the node's name), conv_id (smallest member), depth, pa, pb, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, members beyond the first times the bytes of the last turn) and ends_sha256 (of the ids, in order and joined by
    commas, that end here). The node's last turn is turn `depth` of conversation `conv_id`. No conversations: no rows.
    """
    paths = chained(turns, order).select("conv_id", "at", "a", "b", "pa", "pb", "size")
    nodes = paths.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("at").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"), none.alias("pa"), none.alias("pb"), "n_convs", zero.alias("size"))
    nodes = cut(nodes.unionByName(root))
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))

    heavy = cut(nodes.where(f"n_convs > {HEAVY} and depth > 0").select("a", "b"))
    tops = paths.join(small(heavy), ["a", "b"]).groupBy("conv_id").agg(F.max("at").alias("top"))
    depth, top = F.col("depth"), F.col("top")
    nodes = nodes.join(tops, "conv_id", "left").withColumn("top", F.coalesce("top", zero))
    # a shard begins below the last heavy node, and again every BAND turns
    begins = lambda d: F.when(d <= top, d).otherwise(F.greatest(top + 1, d - d % BAND))
    nodes = nodes.withColumn("level", begins(depth)).withColumn("up", F.when(F.col("level") > 0, begins(F.col("level") - 1)))
    named = lambda at, a, b: paths.select("conv_id", F.col("at").alias(at), F.col("a").alias(a), F.col("b").alias(b))
    placed = cut(nodes.join(named("level", "sa", "sb"), ["conv_id", "level"], "left").withColumn("sa", F.coalesce("sa", zero)).withColumn("sb", F.coalesce("sb", zero)))

    roots = placed.where("level = depth").join(named("up", "psa", "psb"), ["conv_id", "up"], "left")
    above = lambda c: F.when(F.col("up").isNotNull(), F.coalesce(c, zero)).alias(c)
    roots = roots.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "level", "up", above("psa"), above("psb"), "pa", "pb")
    shards = cut(placed.groupBy("sa", "sb").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(roots, ["sa", "sb"]))
    sent = _root_totals(shards).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "in_leaves", "in_saved")

    rows = placed.join(sent, ["a", "b"], "left").select(
        "sa", "sb", "a", "b", F.col("depth").alias("level"), "pa", "pb", F.when(F.col("level") < depth, depth - 1).alias("above"), (F.col("leaves") + F.coalesce("in_leaves", zero)).alias("leaves"),
        (F.col("saved") + F.coalesce("in_saved", zero)).alias("saved"), "conv_id", "n_convs", "n_children",
    )
    rows = rows.repartition("sa", "sb").sortWithinPartitions("sa", "sb", F.desc("level"), "a", "b")
    totals = rows.mapInArrow(_forward(QUEUE), rows.schema)

    ends = ids.join(paths.groupBy("conv_id").agg(F.max(F.struct("at", "a", "b")).alias("end")), "conv_id", "left")
    ends = ends.select("conv_id", F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b"))
    ends = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_joined, "a long, b long, first long, ids string")
    ends = ends.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a long, b long, ends_sha256 string")
    owners = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return totals.join(ends, ["a", "b"], "left").join(owners, ["pa", "pb"], "left").select(
        "a", "b", "conv_id", F.col("level").alias("depth"), "pa", "pb", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, in the columns of the contract.

    Rows with a null conv_id are left out. Turns go by `turn`, null first; turns that tie, repeated rows among them, all
    stay, in the order of their digests. Null roles and texts count as empty. Other columns are ignored; an empty table
    gives no rows.
    """
    turns, ids = rebuilt(conversations)
    return prefix_trie(turns, ids, ["turn"]).drop("a", "b", "pa", "pb")
