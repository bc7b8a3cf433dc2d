"""Mixes sources to target weights with hash-threshold histograms, in DataFrame functions alone.

Each document has a fixed 36-bit digest of its id. A source whose target is q whole passes and a rest takes every
document q times, and once more each document whose digest lies under the source's threshold. The threshold comes from
sums of sizes by source and by the digest's first 12 bits; only the bucket in which the rest ends is refined, by the
next 12 bits and then by the last. Nothing is sorted by digest, and thresholds for smaller rests are nested in larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = (24, 12, 0)
SEED = "mix:"


def _digest() -> Column:
    key = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 9), 16, 10).cast("long")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _digest().alias("digest"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source of `sized` (doc_id, source, size, digest): source, source_size, target, passes, threshold.

    Sources in code point order, null last, have `weights` in turn and share all sizes by weight; a target stops at
    `most` times its source's size, and what is over is shared again by weight until no target is above. The table has
    a row per source, and one weight is given to each, so it is small; only it is ordered as a whole.
    """
    total = F.sum("size").alias("size")
    first = cut(sized.groupBy("source", F.shiftright("digest", LEVELS[0]).alias("bucket")).agg(total))
    everything = Window.orderBy(F.asc_nulls_last("source"))
    sources = first.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    sources = sources.withColumn("weight", weight).withColumn("reach", most * F.col("source_size") / F.col("weight"))
    # sources stop in the order of reach: those before a row are full, it and those after share the rest by weight
    order = Window.orderBy("reach", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sources = sources.withColumn("level", rest / F.sum("weight").over(after))
    level = F.min(F.when(F.col("reach") > F.col("level"), F.struct("reach", "place", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.least(F.col("weight") * F.coalesce(level, F.col("level")), (most * F.col("source_size")).cast("double"))
    sources = sources.withColumn("target", target).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = cut(sources.select("source", "source_size", "target", "passes", "rest"))

    found, sums = plan.select("source", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix")), first
    for depth, shift in enumerate(LEVELS):
        found = small(cut(found))
        if depth:
            inside = sized.join(found.withColumnRenamed("source", "s").drop("base", "rest"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("digest", LEVELS[depth - 1]) == F.col("prefix")))
            sums = inside.groupBy("source", F.shiftright("digest", shift).alias("bucket")).agg(total)
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", running).withColumnRenamed("source", "s")
        sums = sums.join(found, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("upto") + F.col("base"))
        # the bucket in which the running sum passes the rest
        met = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
        near = F.when(F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")), 1).otherwise(0) if shift == 0 else F.lit(0)
        found = met.select("source", "rest", (F.col("upto") - F.col("size")).alias("base"), (F.col("bucket") + near).alias("prefix"))
    ends = found.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"))
    ended = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(ended.select("source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of `docs`: taken is the words the mix takes, repeats counted.

    Size is the number of runs of anything but ASCII white space; null, empty and blank texts have size 0 and take
    nothing. A null source is a source of its own, the last. Rows with the same or a null doc_id share a digest and so
    a decision. An empty table gives no rows. A source's taken words miss its target by less than the size of the rows
    that share one 36-bit digest, half a document as a rule.
    """
    sized = cut(_sized(docs))
    plan = small(mix_plan(sized, weights, most).withColumnRenamed("source", "s"))
    copies = F.col("passes") + F.when(F.col("digest") < F.col("threshold"), 1).otherwise(0)
    chosen = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of `docs` that the mix takes, with `copies`, how often it takes each; rows taken 0 times are left out.
    Documents without words cost nothing and stay with at least one copy."""
    plan = small(mix_plan(cut(_sized(docs)), weights, most).select(F.col("source").alias("_source"), "passes", "threshold"))
    keep = [c for c in docs.columns if c != "copies"]
    rows = docs.select(F.struct(*keep).alias("row"), F.col("source").cast("string").alias("_s"), _digest().alias("digest"), _size().alias("size"))
    copies = F.col("passes") + F.when(F.col("digest") < F.col("threshold"), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, F.greatest(copies, F.lit(1))).otherwise(copies)
    taken = rows.join(plan, F.col("_s").eqNullSafe(F.col("_source"))).withColumn("copies", copies)
    return taken.where("copies > 0").select("row.*", "copies")


#: The same rows in DuckDB SQL, which orders every document of a source by its digest.
SQL = r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 9))::bigint as h from documents),
o as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from s group by 1),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(place % 3 + 1)::int] as weight, sum(source_size) over ()::bigint as total from o),
z as (select *, 3 * source_size / weight as reach from w),
l as (select *, (total - 3 * coalesce(sum(source_size) over (order by reach, place rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by reach, place rows between current row and unbounded following) as level from z),
m as (select min(struct_pack(reach := reach, place := place, level := level)) filter (where reach > level) as first_open from l),
t as (select source, source_size, least(weight * coalesce(first_open.level, level), (3 * source_size)::double) as target from l, m),
q as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as passes from t),
b as (select s.source, s.h, sum(s.size)::bigint as size from s group by 1, 2),
c as (select b.source, b.h, b.size, sum(b.size) over (partition by b.source order by b.h)::bigint as upto from b),
x as (select c.source, c.h, c.upto, c.size, q.target - q.passes * q.source_size as rest from c join q on c.source is not distinct from q.source),
k as (select source, h, (upto <= rest) or (upto - size <= rest and upto - rest < rest - (upto - size)) as more from x)
select s.doc_id, s.size, q.source_size, q.target, (s.size * (q.passes + case when k.more then 1 else 0 end))::bigint as taken
from s join q on s.source is not distinct from q.source join k on k.source is not distinct from s.source and k.h = s.h
"""
