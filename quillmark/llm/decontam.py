"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A test item is the set of hashed shingles of its words; items are partitioned by the power of two of that set's size. A
partition sets the parameters of its search: the number of hits, one and an eighth of its least size, that make a document a
candidate. An item's sketch is its smallest hashes, so many that a document with the asked share of the item must hold as
many of them as its partition asks for (n - need + hits of n, by pigeonhole), so larger items need several common shingles
before anything is verified. Documents are not sketched: all their shingles probe the sketches, for documents are long and
items short. Candidates are then verified by exact containment over the whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SEPARATOR = r"[^\p{L}\p{N}]+"
#: Parts of a key where sketches are joined by a shuffle.
SALTS = 16


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SEPARATOR), "")


def _shingle(size: int, at: Column) -> Column:
    """Digest of the `size` words from 0-based position `at`."""
    return F.xxhash64(*[F.col("words")[at + k] for k in range(size)])


def _starts(size: int) -> Column:
    last = F.size("words") - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _probed(probes: DataFrame, sketch: DataFrame) -> DataFrame:
    """`probes` joined to the keys of `sketch` by h. Sketches too large to broadcast are copied to `SALTS` parts of each
    key, so that the documents that share a common passage are dealt over as many tasks."""
    keys = small(sketch)
    if keys is not sketch:
        return probes.join(keys, "h")
    salted = sketch.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return probes.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["h", "salt"]).drop("salt")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with 100 * n_shared >= percent * n_item.

    Words are runs of letters and digits in lower case, shingles `size` words. Items with fewer words, null and empty
    texts have no shingle and match nothing. Rows of `docs` that repeat a doc_id give one pair, of the largest share;
    rows of `items` that repeat an item_id count as one item with all their shingles. Rows with a null id are left out.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    shingles = items.where("item_id is not null").select(F.col("item_id"), _words("text").alias("words"))
    shingles = shingles.select("item_id", "words", F.explode(_starts(size)).alias("at")).select("item_id", _shingle(size, F.col("at")).alias("h")).distinct()
    known = cut(shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hashes")))
    known = known.withColumn("n", F.size("hashes")).withColumn("need", F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int"))
    known = known.withColumn("part", F.floor(F.log2("n")).cast("int"))
    hits = F.greatest(F.least(F.floor(F.pow(F.lit(2.0), "part") / 8).cast("int") + 1, F.col("need")), F.lit(1))
    known = known.withColumn("hits", hits)
    # the sketch order is a second hash, so that it is not the order in which equal prefixes of words cluster
    order = F.sort_array(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(7)).alias("rank"), h.alias("h"))))
    sketch = known.select("item_id", "need", "hits", F.explode(F.slice(order, 1, F.col("n") - F.col("need") + F.col("hits"))).alias("key"))
    sketch = cut(sketch.select("item_id", "need", "hits", F.col("key.h").alias("h")))

    rows = docs.where("doc_id is not null").select("doc_id", _words("text").alias("words"))
    probes = rows.select("doc_id", F.size("words").alias("n_words"), "words", F.explode(_starts(size)).alias("at")).select("doc_id", "n_words", _shingle(size, F.col("at")).alias("h"))
    met = _probed(probes, sketch).where(F.col("n_words") - size + 1 >= F.col("need"))
    counts = met.select("doc_id", "item_id", "h", "hits").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("met"), F.first("hits").alias("hits"))
    pairs = cut(counts.where("met >= hits").select("doc_id", "item_id"))

    texts = rows.join(small(pairs), "doc_id").join(small(known.select("item_id", "hashes", "n", "need")), "item_id")
    found = F.transform(_starts(size), lambda at: F.xxhash64(*[F.col("words")[at + k] for k in range(size)]))
    shared = texts.select("doc_id", "item_id", "n", "need", F.size(F.array_intersect("hashes", found)).alias("n_shared")).where("n_shared >= need")
    best = shared.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_item"), F.max("n_shared").cast("long").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows whose doc_id holds a test item; all other rows stay, those with a null id too."""
    held = cut(contaminated(docs, items, size, percent).select(F.col("doc_id").alias("_held")).distinct())
    return docs.join(small(held), F.col("doc_id") == F.col("_held"), "left_anti")


#: The pairs in DuckDB SQL, by comparing all shingles.
SQL = r"""
with d as (select doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from d where len(w) >= 5),
bs as (select distinct id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from b where len(w) >= 5),
n as (select id, count(*) as n from bs group by 1)
select ds.id as doc_id, bs.id as item_id, n.n as n_item, count(*) as n_shared, count(*)::double / n.n as containment
from ds join bs using (s) join n on n.id = bs.id group by 1, 2, 3 having 100 * count(*) >= 80 * n.n
"""
