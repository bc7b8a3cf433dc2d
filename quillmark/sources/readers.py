"""Readers of labelled corpora from files, blocks from raw pages, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS = "text string, label int, source string, generator string, temp double, bucket string"


def _lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Column]:
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw, F.col("_bad").isNotNull()


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """JSON lines; blank lines, and lines that are no JSON object of the schema, are left out."""
    raw, bad = _lines(spark, path, schema)
    return raw.where(~bad).drop("_bad")


def read_corpus_counted(spark: SparkSession, path: str, schema: str = CORPUS) -> tuple[DataFrame, Observation]:
    """(rows of `read_corpus`, observation): once the rows were read, it has `lines` and `bad`, counted in the same pass.

    A session that has observed cannot serialise itself, which fitted models of Spark ML ask for: use a session of its own
    (`spark.newSession()`) where both are wanted.
    """
    raw, bad = _lines(spark, path, schema)
    seen = Observation()
    return raw.observe(seen, F.count("*").alias("lines"), F.count_if(bad).alias("bad")).where(~bad).drop("_bad"), seen


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.url_decode(name).alias("file"), T.strip(F.col("value")).alias("text")).where("text <> ''")


def read_labelled_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, label) of *.txt in a folder and its labels.json, a map from file to label; label null if missing."""
    raw = spark.read.text(f"{path}/labels.json", wholetext=True)
    labels = raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("file", "label"))
    return _files(spark, path).join(labels, "file", "left")


def read_human_dir(spark: SparkSession, path: str) -> DataFrame:
    """Human texts: a row per *.txt file and per line of *.jsonl files; source is local:<file>."""
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    lines = spark.read.schema("text string").option("pathGlobFilter", "*.jsonl").json(path).select(name.alias("file"), T.strip(F.col("text")).alias("text")).where("text <> ''")
    rows = _files(spark, path).unionByName(lines)
    return rows.select("text", F.lit(0).alias("label"), F.concat(F.lit("local:"), "file").alias("source"), F.lit("human").alias("generator"))


def write_corpus(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


BLOCK_TAGS = "h[1-6]|p|li|div|article|section|nav|header|footer|main|ul|ol|tr|td|th|blockquote|pre|caption|figcaption|body|html|head|title|br"


def _unescaped(text: Column) -> Column:
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, idx, text, style, is_heading, is_caption, has_math, is_table) of raw pages, in order.

    Scripts, styles and comments go; a table is one block, a marker that counts its cells; a block is what lies between block
    tags, its style the tag that opens it; inline tags are dropped and entities resolved; empty blocks are left out.
    """
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    parts = F.split(F.regexp_replace(html, r"(?is)<table[^>]*>(.*?)</table>", "\u0003$1\u0003"), "\u0003")
    html = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("\u0001table\u0002"), table_marker(x), F.lit("\u0001"))).otherwise(x)), "")
    marked = F.regexp_replace(html, f"(?i)<({BLOCK_TAGS})( [^>]*)?/?>", "\u0001$1\u0002")
    marked = F.regexp_replace(marked, f"(?i)</({BLOCK_TAGS})>", "\u0001")
    rows = pages.select("page_id", F.posexplode(F.split(marked, "\u0001")).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", "^([A-Za-z0-9]+)\u0002", 1))
    body = T.strip(F.regexp_replace(_unescaped(F.regexp_replace(F.regexp_replace("raw", "^[A-Za-z0-9]+\u0002", ""), r"(?s)<[^>]*>", "")), f"{T.SPACE}+", " "))
    rows = rows.select("page_id", "pos", tag.alias("style"), body.alias("text"), F.contains(F.lower("raw"), F.lit("<math")).alias("has_math")).where("text <> ''")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    return rows.select("page_id", "idx", "text", "style", F.rlike("style", F.lit("^h[1-6]$")).alias("is_heading"), F.col("style").isin("caption", "figcaption").alias("is_caption"), "has_math", (F.col("style") == "table").alias("is_table"))


def table_marker(html: Column) -> Column:
    """The marker of a table: how many of its cells are not empty."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<t[dh](?: [^>]*)?>(.*?)</t[dh]>"), 1)
    full = F.filter(cells, lambda c: T.strip(F.regexp_replace(c, "<[^>]*>", "")) != "")
    return F.concat(F.lit("⟦таблица: "), F.size(full).cast("string"), F.lit(" ячеек⟧"))


def scan_warnings(pages: DataFrame) -> DataFrame:
    """(page_id, chars, n_img, warning): looks like a scan below 100 characters with images, no text without any."""
    sums = extract_blocks(pages).groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"))
    images = pages.select("page_id", F.regexp_count(F.lower(F.coalesce("html", F.lit(""))), F.lit("<img")).alias("n_img"))
    rows = images.join(sums, "page_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return rows.withColumn("warning", F.when((F.col("chars") < 100) & (F.col("n_img") > 0), "scan").when(F.col("chars") == 0, "no text"))


def order_blocks(df: DataFrame) -> DataFrame:
    """Text blocks (doc, page, type, x, y) in reading order: rows of y to one decimal, then x."""
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.round("y", 1), "x"))
    return df.where("type = 'text'").withColumn("place", place)
