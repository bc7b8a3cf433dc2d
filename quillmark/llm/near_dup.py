"""MinHash near-duplicates through an LSH forest of sorted signature orders.

Every text becomes a set of hashed word shingles with a pool of 64 minimum hashes. Texts with equal sets fall together
first, so that copies cost one row, a node. A tree is one sorted order of the signatures (tree t reads the pool from hash
4 t on). Rows that share `MIN_DEPTH` hashes in a tree are a region of neighbours in its order. In a region, rows meet
their neighbours of the longest common prefix first and then, prefix by prefix, all others of the region that are not
yet connected to them: depth adapts to each region's density. Regions whose rows earlier trees connected are not visited. Rows whose signatures agree in a share of the pool that
hardly a linked pair falls below, and whose sizes allow a link, are joined to coarse groups; a region of more than
`REGION_ROWS` rows is a coarse group as it stands. A coarse group's full sets are then compared exactly.

A coarse group within `UNIT_ROWS` and `UNIT_SHINGLES` is compared in one task, each pair at most once and never two texts
already connected. A larger one is compared in three steps. First those rows leave it of whose shingles so many occur in no
other text of the group that they can link with nothing. Then its rows are cut into bounded blocks along several of the
sorted orders, so that blocks hold neighbours of long common prefixes, and compared within blocks: what is dense falls
together. At last blocks of rows that are still apart meet all other blocks of the group, each pair of blocks in a task of
its own; only pairs of rows inside the group's largest part, which are connected already, are left out. No pair is lost
and no task holds more than two blocks, each within twice the bounds. The last step grows with the rows outside the largest part times all rows of
that group.

A pair at the threshold of 0.85 shares no region in 16 trees with chance (1 - 0.85^3)^16 = 2e-7, at 0.8 with 1e-5, and
its signatures fall below the agreement asked for with chance 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, in_groups, ship, small

ship(__name__)

POOL, TREES, STRIDE, MIN_DEPTH, MAX_DEPTH = 64, 16, 4, 3, 8
#: Rows of a region that meet in one task; rows and shingles of a block or of a group compared in one task.
REGION_ROWS, UNIT_ROWS, UNIT_SHINGLES = 1024, 1024, 4_000_000
#: Trees that are searched before the others.
FIRST_TREES = 4
#: Trees along whose orders the blocks of a larger group are cut.
SORTED = (0, 5, 10)
KNOWN_WORDS = 1_000_000


def least_agreement(percent: int) -> float:
    """Share of the pool below which the signatures of a linked pair agree with a chance of at most 1e-6."""
    p, below, k = percent / 100, 0.0, -1
    while below <= 1e-6:
        k += 1
        below += math.comb(POOL, k) * p**k * (1 - p) ** (POOL - k)
    return k / POOL


class WordHashes(dict):
    """64-bit digests of words, kept while there are few of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct digests of a text's shingles; a text of fewer words is one shingle; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower and bytes.split know ASCII alone
    if not found:
        return np.empty(0, np.uint64)
    digests = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(digests))
    total = np.zeros(len(digests) - width + 1, np.uint64)
    for k in range(width):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + digests[k : len(digests) - width + 1 + k]
    return np.unique((total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum of each of the pool's hash functions over the set."""
    rng = np.random.default_rng(20)
    odd, add = rng.integers(1, 2**32, POOL, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, POOL, dtype=np.uint32)
    low = (found ^ (found >> np.uint64(31))).astype(np.uint32)
    least = np.full(POOL, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        mixed = low[at : at + 512, None] * odd + add
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        np.minimum(least, mixed.min(0), out=least)
    return least


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts, keys, signs = [], [], []
                for text in part.column(1):
                    found = shingle_set(text.as_py(), size, words)
                    counts.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    signs.append(signature(found).astype(">u4").tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n", "key", "sign"])

    return run


def _stars(ids: np.ndarray, comp: np.ndarray) -> dict | None:
    """Rows (src, dst): the smallest id of each part and each other member."""
    order = np.lexsort((ids, comp))
    ids, comp = ids[order], comp[order]
    first = np.concatenate([[True], comp[1:] != comp[:-1]])
    least = ids[first][np.cumsum(first) - 1]
    own = ids != least
    return {"src": least[own], "dst": ids[own]} if own.any() else None


def _fits(n: np.ndarray, signs: np.ndarray, at: int, others: np.ndarray, percent: int, agreement: float) -> np.ndarray:
    """Those of `others` that may link with row `at`, by sizes and signatures."""
    others = others[100 * np.minimum(n[others], n[at]) >= percent * np.maximum(n[others], n[at])]
    return others[(signs[others] == signs[at]).mean(1) >= agreement] if len(others) else others


def _forest_links(percent: int):
    """Joins a region's rows, sorted by the tree's order, whose signatures agree: rows (src, dst) that span them."""
    agreement = least_agreement(percent)

    def work(group: pa.Table) -> dict | None:
        if group.num_rows < 2:
            return None
        ids, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        signs = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint32).reshape(len(ids), POOL)
        order = np.frombuffer(b"".join(group.column("order").to_pylist()), np.uint32).reshape(len(ids), MAX_DEPTH)
        common = np.cumprod(order[1:] == order[:-1], 1).sum(1)
        comp = np.unique(group.column("label").to_numpy(), return_inverse=True)[1].ravel()
        for depth in sorted(set(common.tolist()), reverse=True):
            for run in np.split(np.arange(len(ids)), np.flatnonzero(common < depth) + 1):
                for at in run if len(run) > 1 else ():
                    others = run[comp[run] != comp[at]]
                    if not len(others):
                        break
                    for part in np.unique(comp[_fits(n, signs, at, others, percent, agreement)]):
                        comp[comp == part] = comp[at]
        return _stars(ids, comp)

    return work


def _exact_links(percent: int, cross: bool = False):
    """Compares full sets: rows (src, dst) that span the connected texts of a group.

    With `cross`, a group is two blocks, by `side`, or one against itself; rows of one `label` are known to be connected
    and only pairs of two labels, across the blocks, are compared.
    """
    agreement = least_agreement(percent)

    def work(group: pa.Table) -> dict | None:
        ids = group.column("node").to_numpy()
        side = group.column("side").to_numpy() if cross else np.zeros(len(ids), np.int64)
        # rows that repeat have the same set
        _, rows = np.unique(np.stack([side, ids]), axis=1, return_index=True)
        ids, side = ids[rows], side[rows]
        if len(ids) < 2:
            return None
        signs = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint32).reshape(-1, POOL)[rows]
        every = group.column("shingles").to_pylist()
        sets = [np.frombuffer(every[k], np.uint64) for k in rows]
        n = np.array([len(x) for x in sets])
        known, local = np.unique(np.concatenate(sets), return_inverse=True)
        local, start = local.ravel().astype(np.int32), np.concatenate([[0], np.cumsum(n)])
        comp = np.unique(group.column("label").to_numpy()[rows], return_inverse=True)[1].ravel() if cross else np.arange(len(ids))
        two, mask, src, dst = side.any(), np.zeros(len(known), bool), [], []
        for i in range(len(ids)):
            if side[i]:
                break
            others = _fits(n, signs, i, np.flatnonzero((comp != comp[i]) & (side == 1 if two else True)), percent, agreement)
            if not len(others):
                continue
            mine = local[start[i] : start[i + 1]]
            mask[mine] = True
            if len(others) > 16:
                upto = np.concatenate([[0], np.cumsum(mask[local])])
                shared = upto[start[others + 1]] - upto[start[others]]
            else:
                shared = np.array([np.count_nonzero(mask[local[start[j] : start[j + 1]]]) for j in others])
            mask[mine] = False
            for j in others[100 * shared >= percent * (n[others] + n[i] - shared)]:
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    src.append(ids[i])
                    dst.append(ids[j])
        return ({"src": src, "dst": dst} if src else None) if cross else _stars(ids, comp)

    return work


def _order(tree: Column) -> Column:
    """The start of a tree's order of the signature."""
    return F.substring(F.concat("sign", "sign"), tree * 4 * STRIDE + 1, F.lit(4 * MAX_DEPTH))


def _blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with a column `block`: bounded runs of neighbours in the order of `keys` and `order`, within equal `keys`.

    Spark sorts by ranges, so a group of any size is spread over partitions; `order` ends in `node`, which ties cannot share.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, held, weight = TaskContext.get().partitionId() << 33, None, 0, 0
        for batch in batches:
            found = []
            for *key, n in zip(*(batch.column(names.index(c)).to_pylist() for c in (*keys, "n"))):
                if key != last or held >= UNIT_ROWS or weight + n > UNIT_SHINGLES:
                    block, last, held, weight = block + 1, key, 0, 0
                held, weight = held + 1, weight + n
                found.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*names, "block"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    found = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(run, schema + ", block long"))
    # ends of partitions leave short blocks: neighbours are put together, up to twice the bounds
    share = F.greatest(F.count("*") / UNIT_ROWS, F.sum("n") / UNIT_SHINGLES)
    sizes = found.groupBy(*keys, "block").agg(share.alias("_share"))
    sizes = sizes.withColumn("_bin", F.ceil(F.sum("_share").over(Window.partitionBy(*keys).orderBy("block"))))
    ends = cut(sizes.select("block", F.min("block").over(Window.partitionBy(*keys, "_bin")).alias("_into")))
    return found.join(small(ends), "block").drop("block").withColumnRenamed("_into", "block")


def _met(slim: DataFrame, trees: range, percent: int) -> DataFrame:
    """Links (src, dst) of rows of `slim` (node, n, sign, label) that meet in a region of one of `trees` with a row of
    another label; rows of one label are connected already."""
    tree = F.explode(F.array(*[F.lit(k) for k in trees])).alias("tree")
    orders = slim.select("node", "label", "sign", tree).select("node", "label", "tree", _order(F.col("tree")).alias("order"))
    orders = orders.withColumn("region", F.substring("order", 1, 4 * MIN_DEPTH))
    about = orders.groupBy("tree", "region").agg(F.count("*").alias("rows"), F.min("node").alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = cut(about.where("low <> high").select("tree", "region", "rows", "first"))
    orders = cut(orders.join(small(met), ["tree", "region"]))
    within = orders.where(F.col("rows") <= REGION_ROWS).select("tree", "region", "order", "label", "node").join(slim.select("node", "n", "sign"), "node")
    links = in_groups(within.select("tree", "region", "order", "label", "node", "n", "sign"), ["tree", "region"], _forest_links(percent), "src long, dst long", ("order",))
    return cut(links.unionByName(orders.where(F.col("rows") > REGION_ROWS).select(F.col("first").alias("src"), F.col("node").alias("dst"))))


def _coarse(slim: DataFrame, percent: int) -> DataFrame:
    """Coarse groups of `slim` (node, n, sign): rows (node, component), for nodes that meet another. The first trees join
    what is dense, so that the others only visit regions in which two groups meet."""
    first = _met(slim.withColumn("label", F.col("node")), range(FIRST_TREES), percent)
    labels = small(cut(components(first)))
    named = slim.join(labels, "node", "left").select("node", "n", "sign", F.coalesce("component", "node").alias("label"))
    return components(first.unionByName(_met(named, range(FIRST_TREES, TREES), percent)))


def _counted(bits: int):
    """Packed parts of a count of shingles by unit: keys, and the node of those that occur once among a task's rows (-1
    for others), a row for each of 2^bits ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            node = np.where(count == 1, np.concatenate(nodes)[first], -1)
            ranges = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
            cuts = list(zip(starts, [*starts[1:], len(found)]))
            yield pa.RecordBatch.from_arrays([pa.array(ranges[starts]), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (found, node))], ["range", "keys", "nodes"])

        for batch in batches:
            for unit, node, shingles in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = np.frombuffer(shingles, np.uint64)
                keys.append(found ^ np.uint64(xxhash.xxh3_64_intdigest(str(unit))))
                nodes.append(np.full(len(found), node))
                held += len(found)
                if held > UNIT_SHINGLES:
                    yield from flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield from flush()

    return run


def _alone(group: pa.Table) -> dict | None:
    """Of a range, rows (node, alone): how many keys occur in that node's text and no other."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()])
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("nodes").to_pylist()])
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    found, alone = np.unique(nodes[first[(count == 1) & (nodes[first] >= 0)]], return_counts=True)
    return {"node": found, "alone": alone} if len(found) else None


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `members` without those that can link with nothing: too many of their shingles occur in no other text
    of their unit. An exact bound; a meeting of digests only keeps a row too many."""
    size = members.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, 4 * size / UNIT_SHINGLES))))
    parts = sets.join(members.select("unit", "node"), "node").select("unit", "node", "shingles").mapInArrow(_counted(bits), "range long, keys binary, nodes binary")
    alone = in_groups(parts, ["range"], _alone, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))
    rows = members.join(small(cut(alone)), "node", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    return rows.select("unit", "node", "n", "sign")


def _large_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links of groups of any size: rows (src, dst) that span the connected nodes of each unit of `members`
    (unit, node, n, sign); `sets` has (node, shingles)."""
    members = cut(_linkable(members, sets, percent))
    full = sets.join(members.select("node", "sign"), "node")
    trees = F.explode(F.array(*[F.lit(k) for k in SORTED])).alias("tree")
    rows = members.select("unit", "node", "n", "sign", trees).select("unit", "tree", _order(F.col("tree")).alias("order"), "node", "n")
    near = cut(_blocks(rows, ["unit", "tree"], ["order", "node"]).select("block", "node"))
    links = cut(in_groups(near.join(full, "node"), ["block"], _exact_links(percent), "src long, dst long"))

    named = members.select("unit", "node", "n").join(small(components(links)), "node", "left").select("unit", "node", "n", F.coalesce("component", "node").alias("label"))
    sizes = cut(named.groupBy("unit", "label").agg(F.count("*").alias("rows")))
    core = sizes.groupBy("unit").agg(F.max(F.struct("rows", "label"))["label"].alias("core"), F.count("*").alias("labels")).where("labels > 1")
    sizes = cut(sizes.join(core, "unit").select("unit", "label", F.when(F.col("rows") >= UNIT_ROWS, F.col("label")).otherwise(-1).alias("part"), (F.col("label") == F.col("core")).alias("core")))
    apart = named.join(small(sizes), ["unit", "label"]).select("unit", "part", "label", "node", "n", "core")
    apart = cut(_blocks(apart, ["unit", "part"], ["label", "node"]))
    # a block whose rows all lie in the largest part meets the others, but none of its like
    blocks = cut(apart.groupBy("unit", "block", "part").agg((F.first("core") & (F.first("part") >= 0)).alias("core")))
    left = blocks.where("not core").select("unit", F.col("block").alias("a"), F.col("part").alias("pa"))
    right = blocks.select("unit", F.col("block").alias("b"), F.col("part").alias("pb"), "core")
    pairs = cut(left.join(right, "unit").where("(core or a <= b) and (pa < 0 or pa <> pb)").select("a", "b"))
    rows = apart.select("block", "label", "node")
    sides = pairs.join(rows.withColumnRenamed("block", "a"), "a").withColumn("side", F.lit(0)).unionByName(pairs.where("a <> b").join(rows.withColumnRenamed("block", "b"), "b").withColumn("side", F.lit(1)))
    return links.unionByName(in_groups(sides.join(full, "node"), ["a", "b"], _exact_links(percent, True), "src long, dst long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Links texts whose shingle sets have 100 * intersection >= percent * union, and returns per row of `docs`
    (doc_id, n_shingles, component_id, kept).

    Words are ASCII-lower-cased runs of anything but ASCII white space. A text with fewer than `size` words is one
    shingle; null, empty and blank texts have none, link with nothing and are kept. Rows that repeat are each returned,
    with the same values; rows that share a doc_id but not a text are linked by their texts alone, and each is kept if
    its own component's smallest doc_id is its own. A row with a null doc_id links with nothing, has a null component_id
    and is kept. Other columns are ignored. An empty table gives no rows.
    """
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(asked.mapInArrow(_sign(size), "doc_id long, n long, key binary, sign binary"))
    reps = signed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    slim = reps.select("node", "n", "sign")

    members = cut(_coarse(slim, percent).join(slim, "node").select(F.col("component").alias("unit"), "node", "n", "sign"))
    sizes = cut(members.groupBy("unit").agg(((F.count("*") > UNIT_ROWS) | (F.sum("n") > UNIT_SHINGLES)).alias("full")))
    members = members.join(small(sizes), "unit")
    wanted = cut(members.select("node", "full").join(reps.select("node", "rep", "key"), "node"))
    texts = asked.join(small(wanted.select(F.col("rep").alias("doc_id"), "node", "key", "full")), "doc_id").select("node", "key", "full", "text")
    sets = texts.mapInArrow(_sets(size), "node long, full boolean, shingles binary")
    units = sets.where("not full").join(members.where("not full").select("unit", "node", "sign"), "node")
    links = in_groups(units.select("unit", "node", "sign", "shingles"), ["unit"], _exact_links(percent), "src long, dst long")
    if not sizes.where("full").isEmpty():
        large = cut(members.where("full").select("unit", "node", "n", "sign"))
        links = links.unionByName(_large_links(large, cut(sets.where("full").select("node", "shingles")), percent))

    # a component is named by the smallest doc_id of its texts
    linked = cut(components(links).join(reps.select("node", "rep"), "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = cut(linked.join(least, "component").select("node", "least"))
    classes = reps.join(small(linked), "node", "left").select("key", F.coalesce("least", "rep").alias("class"))
    named = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(classes, "key", "left")
    component = F.coalesce("class", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def first_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near copies: of each component the rows of its smallest doc_id, with all columns.

    Rows that repeat a doc_id and a text stay once, any one of them; rows that share a doc_id but not a text go only if
    none of their texts leads its component. Rows with a null doc_id and, unless they repeat, those without words stay.
    """
    found = near_duplicates(docs, size, percent).where("doc_id is not null")
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    ids = cut(ids.where("not _kept or _rows > 1"))
    rest = docs.join(small(ids.select("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    again = docs.join(small(ids.where("_kept").select("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    return rest.unionByName(again.dropDuplicates(["doc_id", "text"]))


def _sets(size: int):
    """Full sets of the texts that have the digest `key`; others share their doc_id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(text.as_py(), size, words).tobytes() for text in part.column(3)]
                right = pa.array([xxhash.xxh3_128_digest(x) == key for x, key in zip(sets, part.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.binary())], ["node", "full", "shingles"]).filter(right)

    return run


#: The same rows in DuckDB SQL by comparing all pairs that share a shingle (3 words, 85 %).
SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as sh from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (sh) where a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 85 * (x.n + y.n - p.k)),
r as (select doc_id as a, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.a),
g as (select a, min(c) as c from r group by 1)
select documents.doc_id, coalesce(n.n, 0)::bigint as n_shingles, g.c as component_id, g.c = documents.doc_id as kept
from documents join g on g.a = documents.doc_id left join n on n.doc_id = documents.doc_id
"""
