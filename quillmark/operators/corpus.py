"""Corpus preparation: loaders over tables, exact deduplication, caps, balance, splits and augmentation.

Random choices follow from md5(seed:text), so they are the same on every run. Ranks in a group are counted per digest
bucket first, so no group is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def normalise(df: DataFrame, text: str, label: Column, source: Column, generator: Column) -> DataFrame:
    """Rows of any table in the columns of a corpus."""
    return df.select(F.col(text).alias("text"), label.cast("int").alias("label"), source.alias("source"), generator.alias("generator"))


def load_paired(df: DataFrame) -> DataFrame:
    """Trimmed, not empty texts; the generator is the authorship or a default by label."""
    default = F.when(F.col("label") == 0, "human").otherwise("unknown")
    rows = df.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    return rows.withColumn("generator", F.coalesce(F.when(F.col("authorship") != "", F.col("authorship")), default)).drop("authorship")


def label_from_source(source: Column) -> Column:
    return F.when(F.contains(F.lower(source), F.lit("human")), 0).otherwise(1)


def unpivot_text_columns(df: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each *_text column that is not null: its name gives the generator, human or another, and the label."""
    columns = [c for c in df.columns if c.endswith("text") and c not in ids]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("text")) for c in columns])).alias("r")
    rows = df.select(*ids, each).select(*ids, "r.key", "r.text").where("text is not null")
    name = F.regexp_replace("key", "_?text$", "")
    return rows.select(*ids, "text", F.when(name == "human", 0).otherwise(1).alias("label"), name.alias("generator"))


def load_instruct(df: DataFrame) -> DataFrame:
    """The output, or the instruction if it is blank; always label 1."""
    clean = lambda c: F.when(T.strip(F.col(c)) != "", T.strip(F.col(c)))
    return df.withColumn("text", F.coalesce(clean("output"), clean("instruction"))).where("text is not null").withColumn("label", F.lit(1)).drop("output", "instruction")


def load_generated(df: DataFrame, name: str, source: str) -> DataFrame:
    """Machine texts (text, generator): blank ones go, a missing generator is `name`; label 1."""
    rows = df.where(T.strip(F.col("text")) != "")
    return rows.select("text", F.coalesce("generator", F.lit(name)).alias("generator"), F.lit(source).alias("source"), F.lit(1).alias("label"))


def load_chat_replies(df: DataFrame, role: str, low: int, high: int, limit: int | None = None) -> DataFrame:
    """Trimmed replies (conv_id, turn, text) of one role within a length range; of equal texts the first; at most
    `limit` in the order of (conv_id, turn) if it is given."""
    rows = df.where(F.col("role") == role).select("conv_id", "turn", T.strip(F.col("text")).alias("text")).where(F.length("text").between(low, high))
    first = rows.groupBy(F.md5("text").alias("m")).agg(F.min(F.struct("conv_id", "turn", "text")).alias("r")).select("r.*")
    return first.orderBy("conv_id", "turn").limit(limit) if limit else first


def load_sources(builders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Union of the sources that can be built, and the error of each that cannot."""
    built, failed = [], {}
    for name, build in builders.items():
        try:
            built.append(build().withColumn("origin", F.lit(name)))
        except AnalysisException as error:  # a missing source must not stop the rest
            failed[name] = str(error).splitlines()[0]
    if not built:
        raise ValueError(f"no source could be read: {failed}")
    return reduce(lambda a, b: a.unionByName(b), built), failed


def dedup_exact(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Of rows with equal text that of the smallest `order`."""
    least = df.groupBy(F.md5("text").alias("_m")).agg(F.min(F.struct(order, *[c for c in df.columns if c != order])).alias("_r"))
    return least.select(*[F.col("_r")[c].alias(c) for c in df.columns])


def filter_len(df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Rows whose text has from `low` to `high` characters."""
    n = F.length("text")
    return df.where(n >= low if high is None else n.between(low, high))


#: Rows of a digest bucket that one task is meant to rank.
BUCKET_ROWS = 20_000


def hash_rank(df: DataFrame, groups: list[str], seed: str, name: str = "rank", digest: str | None = None) -> DataFrame:
    """Adds the row's 1-based place in its group by md5(seed:text), doc_id; `digest` names a column that has this digest already.

    Rows are ranked in buckets of the digest, of a depth that follows from the size of their group, so that a bucket holds some
    `BUCKET_ROWS` rows however large the group; what lies in lower buckets comes from a table of counts. Rows of one
    group with one text share a bucket. Null is a group of its own.
    """
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    rows = df.withColumns({"_h": F.col(digest) if digest else F.md5(F.concat(F.lit(f"{seed}:"), "text")), "_g": group})
    depth = F.greatest(F.lit(1), F.ceil(F.log(F.count("*") / F.lit(float(BUCKET_ROWS))) / F.log(F.lit(16.0)))).cast("int")
    rows = rows.join(rows.groupBy("_g").agg(depth.alias("_d")), "_g").withColumn("_b", F.substring(F.col("_h"), F.lit(1), F.col("_d")))
    counts = rows.groupBy("_g", "_b").count()
    below = F.sum("count").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_g", "_b", F.coalesce(below, F.lit(0)).alias("_below"))
    inside = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", "doc_id"))
    ranked = rows.withColumn("_in", inside).join(counts, ["_g", "_b"])
    return ranked.select(*df.columns, (F.col("_below") + F.col("_in")).alias(name))


def cap_per_source(df: DataFrame, cap: int, seed: str = "cap") -> DataFrame:
    """At most `cap` rows of label 1 from each source; rows of label 0 stay."""
    return hash_rank(df, ["source", "label"], seed).where((F.col("label") == 0) | (F.col("rank") <= cap)).drop("rank")


def balance(df: DataFrame, most: int | None = None, seed: str = "balance") -> DataFrame:
    """As many rows of each class as the smaller has, at most `most`."""
    counts = {row.label: row["count"] for row in df.groupBy("label").count().collect()}  # two rows
    k = min(counts.get(0, 0), counts.get(1, 0), most or 1 << 62)
    if k == 0:
        raise ValueError("a class is empty")
    return hash_rank(df, ["label"], seed).where(F.col("rank") <= k).drop("rank")


def split(df: DataFrame, val: float = 0.1, test: float = 0.1, seed: str = "split") -> DataFrame:
    """Adds part: test and val of floor(share * n) rows, the rest train."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    rows = hash_rank(df, [], seed).crossJoin(n)
    tests, vals = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    part = F.when(F.col("rank") <= tests, "test").when(F.col("rank") <= tests + vals, "val").otherwise("train")
    return rows.withColumn("part", part).drop("rank", "_n")


def split_by(df: DataFrame, group: str, share: float, seed: str, parts: tuple[str, str] = ("train", "holdout")) -> DataFrame:
    """Adds part: the first round(share * n) rows of each group, and the rest."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    rows = hash_rank(df, [group], seed).join(n, group)
    return rows.withColumn("part", F.when(F.col("rank") <= F.round(F.col("_n") * share), parts[0]).otherwise(parts[1])).select(*df.columns, "part")


def thin_proportional(df: DataFrame, group: str, target: int, seed: str = "thin") -> DataFrame:
    """About `target` rows, each group by its share; at most `target` in all."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    total = F.broadcast(df.agg(F.count("*").alias("_all")))
    quota = F.greatest(F.round(target * F.col("_n") / F.col("_all")), F.lit(1))
    kept = hash_rank(df, [group], seed).join(n, group).crossJoin(total).where(F.col("rank") <= quota).select(*df.columns)
    return hash_rank(kept, [], seed).where(F.col("rank") <= target).drop("rank")


def slice_parts(df: DataFrame, sizes: dict[str, int], seed: str = "slice") -> DataFrame:
    """Consecutive slices of each class by rank, with column part; rows beyond them are left out."""
    part, at = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        part, at = F.when((F.col("rank") > at) & (F.col("rank") <= at + n), name).otherwise(part), at + n
    return hash_rank(df, ["label"], seed).withColumn("part", part).where("part is not null").drop("rank")


def exclude_texts(df: DataFrame, *seen: DataFrame) -> DataFrame:
    """Rows whose text is in none of `seen`."""
    for other in seen:
        df = df.join(other.select(F.md5("text").alias("_m")).distinct(), F.md5(df["text"]) == F.col("_m"), "left_anti")
    return df


def augment_with_deficit(base: DataFrame, addition: DataFrame, fresh: DataFrame, seed: str = "deficit") -> DataFrame:
    """base and addition, and rows of `fresh` not yet in them that make the smaller class as large as the other."""
    both = base.unionByName(addition)
    counts = F.broadcast(both.agg(F.count_if(F.col("label") == 0).alias("_n0"), F.count_if(F.col("label") == 1).alias("_n1")))
    ranked = hash_rank(exclude_texts(fresh, both), ["label"], seed).crossJoin(counts)
    lack = F.when(F.col("label") == 0, F.col("_n1") - F.col("_n0")).otherwise(F.col("_n0") - F.col("_n1"))
    return both.unionByName(ranked.where(F.col("rank") <= lack).select(*both.columns))


def parts_overlap(df: DataFrame) -> DataFrame:
    """(left, right, n) for each two parts of a split: the distinct texts that both hold, which must be none."""
    texts = df.select("part", F.md5("text").alias("m")).distinct()
    both = texts.groupBy("m").agg(F.sort_array(F.collect_set("part")).alias("parts"))  # a few parts
    pairs = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    met = both.select(F.explode(pairs).alias("_p")).groupBy("_p.left", "_p.right").agg(F.count("*").alias("_n"))
    names = df.select("part").distinct()
    every = names.select(F.col("part").alias("left")).join(names.select(F.col("part").alias("right")), F.col("left") < F.col("right"))
    return every.join(met, ["left", "right"], "left").select("left", "right", F.coalesce("_n", F.lit(0)).alias("n"))


def overlap_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, the number of distinct texts in both."""
    return a.select(F.md5("text").alias("m")).intersect(b.select(F.md5("text").alias("m"))).agg(F.count("*").alias("n"))


def first_n(df: DataFrame, group: str, n: int, order: str = "doc_id") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def augment_truncations(df: DataFrame, lengths: Iterable[int] = (75, 50, 40, 30, 20)) -> DataFrame:
    """Each text whole and cut after each number of words it exceeds; equal (text, label) once, of the smallest id."""
    lengths = list(lengths)
    n = T.word_count(F.col("text"))
    cuts = F.array_append(F.filter(F.array(*map(F.lit, lengths)), lambda k: k < n), F.lit(1_000_000))
    rows = df.withColumn("_k", F.explode(cuts)).withColumn("text", T.truncate_words(F.col("text"), F.col("_k"))).drop("_k")
    least = rows.groupBy("text", "label").agg(F.min(F.struct(*[c for c in df.columns if c not in ("text", "label")])).alias("_r"))
    return least.select(*[F.col("_r")[c].alias(c) if c not in ("text", "label") else F.col(c) for c in df.columns])


def assemble_documents(corpus: DataFrame, pattern: str, n_docs: int, head: list[str], tail: list[str], seed: str = "mix") -> DataFrame:
    """(doc_no, text, truth): documents of paragraphs by rank in their class, H for label 0 and A for 1, between head
    and tail. Documents for which a class has no rows left are not built; no paragraph is used twice."""
    per = {0: pattern.count("H"), 1: pattern.count("A")}
    slot = F.posexplode(F.split(F.lit(pattern), "")).alias("slot", "kind")
    slots = corpus.sparkSession.range(n_docs).select(F.col("id").alias("doc_no"), slot).where("kind <> ''").withColumn("label", (F.col("kind") == "A").cast("int"))
    place = F.row_number().over(Window.partitionBy("doc_no", "label").orderBy("slot"))
    size = F.when(F.col("label") == 0, per[0]).otherwise(per[1])
    slots = slots.withColumn("rank", F.col("doc_no") * size + place)
    # ranks are taken of digests; only the texts of rows that have a slot are joined to them, and copies of a row have one text
    keyed = corpus.select("doc_id", "label", F.md5(F.concat(F.lit(f"{seed}:"), "text")).alias("_key"))
    picked = slots.join(hash_rank(keyed, ["label"], seed, digest="_key"), ["label", "rank"])
    texts = corpus.select("doc_id", "text", F.md5(F.concat(F.lit(f"{seed}:"), "text")).alias("_key"))
    texts = texts.join(picked.select("doc_id", "_key").distinct(), ["doc_id", "_key"]).groupBy("doc_id", "_key").agg(F.first("text").alias("text"))
    rows = picked.join(texts, ["doc_id", "_key"])
    docs = rows.groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("slot", "text", "label"))).alias("m")).where(F.size("m") == len(pattern))
    body = F.array_join(F.transform("m", lambda r: r["text"]), "\n\n")
    return docs.select("doc_no", F.concat(F.lit("".join(h + "\n\n" for h in head)), body, F.lit("".join("\n\n" + t for t in tail))).alias("text"), F.transform("m", lambda r: r["label"]).alias("truth"))


def seed_pool(df: DataFrame, offset: int, n: int, temps: tuple[float, ...] = (0.7, 0.9, 1.1), seed: str = "pool") -> DataFrame:
    """Human texts of 200 characters at ranks offset + 1 to offset + n, a temperature in rotation, and a prompt."""
    pool = hash_rank(df.where((F.col("label") == 0) & (F.length("text") >= 200)), [], seed).where(F.col("rank").between(offset + 1, offset + n))
    temp = F.element_at(F.array(*map(F.lit, temps)), (F.col("rank") % len(temps)).cast("int") + 1)
    return pool.withColumn("temp", temp).withColumn("prompt", F.concat(F.lit("Continue: "), T.flat(F.substring("text", 1, 300))))


def cache_split(df: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with p, distinct missing texts) of `df` against a cache (text_md5, p)."""
    keyed = df.withColumn("text_md5", F.md5("text"))
    hits = keyed.join(cache.select("text_md5", "p"), "text_md5")
    misses = keyed.join(cache, "text_md5", "left_anti").groupBy("text_md5").agg(F.min("text").alias("text"))
    return hits, misses


def score_incremental(df: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows of `df` with p, the new cache); a text is scored once and never if it is cached."""
    _, misses = cache_split(df, cache)
    grown = cache.select("text_md5", "p").unionByName(score(misses).select("text_md5", "p"))
    return df.withColumn("text_md5", F.md5("text")).join(grown, "text_md5"), grown


def _both_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(m, text, pa, pb, gap) of paragraphs by flat text; a version without the text has null."""
    key = lambda df, p: df.select(T.flat(F.col("text")).alias("text"), "p").groupBy(F.md5("text").alias("m")).agg(F.min("text").alias(f"_{p}"), F.max("p").alias(p))
    both = key(a, "pa").join(key(b, "pb"), "m", "full")
    return both.select("m", F.coalesce("_pa", "_pb").alias("text"), "pa", "pb", F.round(F.abs(F.col("pa") - F.col("pb")), 6).alias("gap"))


def compare_versions(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """One row: paragraphs (text, p) in both versions by flat text, median and largest difference of p, and how many
    are flagged in one alone."""
    both = _both_versions(a, b)
    gap = F.abs(F.col("pa") - F.col("pb"))
    only = lambda p, q: F.count_if((F.col(p) >= threshold) & ~F.coalesce(F.col(q) >= threshold, F.lit(False)))
    return both.agg(F.count(gap).alias("n"), F.round(F.percentile(gap, F.lit(0.5)), 6).alias("median_gap"), F.round(F.max(gap), 6).alias("max_gap"), only("pa", "pb").alias("only_a"), only("pb", "pa").alias("only_b"))


def version_gaps(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """(m, text, pa, pb, gap): the n paragraphs in both versions whose p differ most; ties by digest."""
    return _both_versions(a, b).where("gap is not null").orderBy(F.desc("gap"), "m").limit(n)


def flagged_in_one(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(side, m, text, p, other): paragraphs that one version alone flags, with the other's p, null if it lacks the text."""
    both, hit = _both_versions(a, b), lambda p: F.coalesce(F.col(p) >= threshold, F.lit(False))
    side = F.when(hit("pa") & ~hit("pb"), "a").when(hit("pb") & ~hit("pa"), "b")
    rows = both.withColumn("side", side).where("side is not null")
    pick = lambda x, y: F.when(F.col("side") == "a", F.col(x)).otherwise(F.col(y))
    return rows.select("side", "m", "text", pick("pa", "pb").alias("p"), pick("pb", "pa").alias("other"))


def match_prefix(paras: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Paragraphs that start with one of `prefixes` (prefix, truth), with its truth; the longest counts.

    Paragraphs and prefixes meet by the digest of as many characters, one for each length that occurs among the prefixes.
    """
    lengths = [row.n for row in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]
    keys = prefixes.select(F.md5("prefix").alias("_key"), F.length("prefix").alias("_n"), "truth").dropDuplicates(["_key"])
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.md5(F.substring("text", 1, n)).alias("key")) for n in lengths]) if lengths else F.array().cast("array<struct<n:int,key:string>>")
    met = paras.select("doc_id", "idx", F.explode(starts).alias("_s")).select("doc_id", "idx", F.col("_s.key").alias("_key")).join(keys, "_key")
    best = met.groupBy("doc_id", "idx").agg(F.max(F.struct("_n", "truth"))["truth"].alias("truth"))
    return paras.join(best, ["doc_id", "idx"])
