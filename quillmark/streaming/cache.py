"""A cache of scores that many micro-batches grow: generations of rows, each with a Bloom filter, listed by a manifest.

Version n of the cache is what batch n left: a generation of the texts it scored, and a manifest, written last, of the
generations that make up the version. A batch reads the manifest of the version before, whose name follows from its own number,
so nothing is listed and a batch that is run again replaces its own work. Its digests meet the Bloom filters first; only
generations that may hold some are read, and of these only the buckets of digests asked for. Once there are `fan`
generations of one level, the batch merges them into one of the next, so a version has a logarithmic number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "gen string, level int, n long, bits array<long>"
#: Bits of a filter for each row, and at most; hashes of a digest; hexadecimal digits that name a bucket.
ROW_BITS, MOST_BITS, HASHES, BUCKET_DIGITS = 10, 1 << 22, 4, 1


def _places(size: Column) -> Column:
    """Places of a digest in a filter of `size` bits: as many as HASHES, from parts of the digest."""
    return F.array(*[F.conv(F.substring("text_md5", 8 * k + 1, 8), 16, 10).cast("long") % size for k in range(HASHES)])


class ScoreCache:
    """The cache at `path`; versions are numbers, -1 what `seed` left."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        self.spark, self.path, self.fan = spark, path, fan

    def _manifest(self, version: int) -> DataFrame:
        if version < -1:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version}")

    def _read(self, gens: list[str]) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], "text_md5 string, p double, bucket string")
        parts = [self.spark.read.schema("text_md5 string, p double, bucket string").parquet(f"{self.path}/{gen}") for gen in gens]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _write(self, rows: DataFrame, gen: str, level: int) -> DataFrame:
        """Write a generation; its row of the manifest."""
        keyed = rows.select("text_md5", "p", F.substring("text_md5", 1, BUCKET_DIGITS).alias("bucket"))
        keyed.repartition("bucket").sortWithinPartitions("bucket", "text_md5").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{gen}")
        found = self._read([gen])
        n = found.count()
        size = max(64, min(MOST_BITS, 1 << (ROW_BITS * max(n, 1) - 1).bit_length()))
        words = found.select(F.explode(_places(F.lit(size))).alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        filled = self.spark.range(size // 64).withColumnRenamed("id", "word").join(words, "word", "left")
        bits = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda w: w["bits"]).alias("bits"))
        return bits.select(F.lit(gen).alias("gen"), F.lit(level).alias("level"), F.lit(n).cast("long").alias("n"), "bits")

    def seed(self, rows: DataFrame) -> None:
        """Start from rows (text_md5, p), one for each text."""
        self._write(rows, "gen-seed", 0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/-1")

    def generations(self, version: int) -> list[str]:
        return [r.gen for r in self._manifest(version).select("gen").orderBy("gen").collect()]

    def table(self, version: int) -> DataFrame:
        """All rows (text_md5, p) of a version."""
        return self._read(self.generations(version)).select("text_md5", "p")

    def may_hold(self, version: int, digests: DataFrame) -> list[str]:
        """The generations whose filter lets one of `digests` (text_md5) through."""
        filters = F.broadcast(self._manifest(version).where("n > 0"))  # a logarithmic number, each of at most MOST_BITS
        places = _places(F.size("bits").cast("long") * 64)
        one = lambda at: F.getbit(F.element_at("bits", F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1
        met = digests.select("text_md5").distinct().crossJoin(filters).where(F.forall(places, one))
        return sorted(r.gen for r in met.select("gen").distinct().collect())

    def lookup(self, version: int, digests: DataFrame) -> DataFrame:
        """(text_md5, p) of the `digests` that a version holds."""
        asked = digests.select("text_md5", F.substring("text_md5", 1, BUCKET_DIGITS).alias("bucket")).distinct()
        return self._read(self.may_hold(version, digests)).join(asked, ["bucket", "text_md5"]).select("text_md5", "p")

    def commit(self, version: int, rows: DataFrame) -> DataFrame:
        """Make `version` of the one before and of new `rows` (text_md5, p); the rows as they were written."""
        gen = f"gen-{version}"
        made = self._write(rows, gen, 0)
        before = self._manifest(version - 1)
        known = [(r.gen, r.level) for r in before.select("gen", "level").collect()] + [(gen, 0)]
        manifest, level = before.unionByName(made), 0
        while len(same := sorted(g for g, at in known if at == level)) >= self.fan:
            merged = f"gen-{version}-{level + 1}"
            row = self._write(self._read(same), merged, level + 1)
            manifest = manifest.where(~F.col("gen").isin(same)).unionByName(row)
            known = [(g, at) for g, at in known if g not in same] + [(merged, level + 1)]
            level += 1
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        return self._read([gen]).select("text_md5", "p")
