"""Documents cut into paragraphs, sections and overlapping word windows, and window scores laid back on paragraphs.

Every step is a projection, a grouping or a window partitioned by doc_id, so a document is shuffled once. A scan carries
a document's paragraphs beside the first of its windows, scores the windows row by row, and lays the scores back inside one
row a document, where a paragraph finds its windows by number.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions import text as T
from . import metrics

WINDOW_WORDS, STEP, MIN_CHARS, HEADING_WORDS, GLUE_TARGET = 150, 75, 200, 9, 300
#: Markers that headings start with; fixed values.
TOC = ("оглавление", "содержание", "contents")
BACKMATTER = (
    "список литературы", "список использованных источников", "использованная литература", "библиографический список",
    "библиография", "литература", "источники", "приложение", "приложения", "references", "bibliography",
)
START = ("введение",)
CHAPTER = ("глава", "раздел", "заключение")
TOC_LINE = r"(\t|\.{2,})[ \t]*[0-9]{1,4}[ \t]*\z"
NUMBERED = r"^[ \t]*[0-9]+(\.[0-9]+)*\.?[ \t]+[^ \t]"
_INK = r"[^ \t\n\r\f\x0B]"


def _doc():
    return Window.partitionBy("doc_id")


def _order():
    return _doc().orderBy("idx")


def _starts(text: Column, markers: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("^(" + "|".join(markers) + ")"))


def split_paragraphs(docs: DataFrame, sep: str = r"\n[ \t]*\n+", keep: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """(doc_id, *keep, idx, text, start, end): stripped, not empty parts of a text between matches of `sep`, numbered from 0,
    with code point positions in the text, unless no `spans` are asked for."""
    body = F.coalesce(F.col("text"), F.lit(""))
    parts, order = F.split(body, sep, -1), Window.partitionBy("doc_id").orderBy("pos")
    number = F.row_number().over(order) - 1

    def stripped(part: Column) -> Column:  # few parts have blanks at an end, and those are found at once
        return F.when(reduce(or_, [end(part, F.lit(c)) for c in T.BLANKS for end in (F.startswith, F.endswith)]), T.strip(part)).otherwise(part)

    if not spans:
        rows = docs.select("doc_id", *keep, F.posexplode(parts).alias("pos", "part")).select("doc_id", *keep, "pos", stripped(F.col("part")).alias("text"))
        return rows.where("text <> ''").select("doc_id", *keep, number.alias("idx"), "text")
    seps = F.concat(F.regexp_extract_all(body, F.lit(sep), 0), F.array(F.lit("")))
    rows = docs.select("doc_id", *keep, F.posexplode(F.arrays_zip(parts.alias("part"), seps.alias("sep"))).alias("pos", "row"))
    # lengths are taken here, so that the shuffle carries a part once
    lead = F.length("row.part") - F.length(F.ltrim(F.col("row.part"), F.lit(T.BLANKS)))
    rows = rows.select("doc_id", *keep, "pos", stripped(F.col("row.part")).alias("text"), lead.alias("_lead"), (F.length("row.part") + F.length("row.sep")).alias("_len"))
    before = F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("doc_id", *keep, "pos", "text", (F.coalesce(before, F.lit(0)) + F.col("_lead")).alias("start"))
    rows = rows.where("text <> ''").withColumn("idx", number)
    return rows.select("doc_id", *keep, "idx", "text", "start", (F.col("start") + F.length("text")).alias("end"))


def attach_block_meta(paras: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds style, is_heading, is_caption, has_math by (doc_id, idx) if a document's counts match, else defaults."""
    n_paras = paras.withColumn("_n", F.count("*").over(_doc()))
    flags = blocks.select("doc_id", "idx", "style", "is_heading", "is_caption", "has_math", F.count("*").over(_doc()).alias("_m"))
    joined = n_paras.join(flags, ["doc_id", "idx"], "left")
    same = F.col("_n") == F.col("_m")
    return joined.select(*paras.columns, F.when(same, F.col("style")).otherwise("").alias("style"), *[F.coalesce(same & F.col(c), F.lit(False)).alias(c) for c in ("is_heading", "is_caption", "has_math")])


def norm_heading(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(T.strip(text)), r"^[ \t]*[0-9]+(\.[0-9]+)*\.?[ \t]*", ""), f"{T.SPACE}+", " ")


def _heads(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether `norm_heading` of the text starts with a marker, by one match of its beginning."""
    spaced = "|".join(markers).replace(" ", f"{T.SPACE}++")
    return F.rlike(F.lower(T.strip(text)), F.lit(rf"\A(?:[ \t]*+[0-9]++(?:\.[0-9]++)*+\.?+[ \t]*+)?+(?:{spaced})"))


def looks_like_heading(text: Column) -> Column:
    # no more of the text is read than decides it
    most = F.rlike(text, F.lit(rf"\A{T.SPACE}*+{_INK}++(?:{T.SPACE}++{_INK}++){{0,{HEADING_WORDS - 1}}}{T.SPACE}*+\z"))
    return most & ~F.contains(T.strip(text), F.lit("\n"))


def is_table(text: Column) -> Column:
    return F.startswith(text, F.lit(T.TABLE_MARK))


def is_body_prose(text: Column) -> Column:
    return (F.length(text) >= MIN_CHARS) & ~F.contains(text, F.lit("....")) & ~is_table(text)


def is_chapter(text: Column) -> Column:
    return _starts(norm_heading(text), START + CHAPTER)


def heading_kind(text: Column, looks: Column | None = None, norm: Column | None = None) -> Column:
    """toc, backmatter, content_start, content, or null for what is no known heading. `looks` and `norm` are `looks_like_heading` and
    `norm_heading` of the text where a row has them."""
    n = norm_heading(text) if norm is None else norm
    kind = F.when(F.rlike(text, F.lit(TOC_LINE)) | _starts(n, TOC), "toc").when(_starts(n, BACKMATTER), "backmatter")
    kind = kind.when(_starts(n, START), "content_start").when(_starts(n, CHAPTER) | F.rlike(text, F.lit(NUMBERED)), "content")
    return F.when(looks_like_heading(text) if looks is None else looks, kind)


def classify_sections(paras: DataFrame) -> DataFrame:
    """Adds hk, kind (content or service) and drop_reason (toc, title, table, backmatter; null for content).

    Content opens at the heading right before the first prose after a table of contents, else at that prose, else at
    the first content heading, else with the document; it ends at the first back-matter heading after which no chapter
    heading is followed by prose.
    """
    text = F.col("text")
    # each asked several times, so a row has its answers once
    rows = paras.withColumn("_looks", looks_like_heading(text)).withColumn("_norm", F.when(F.col("_looks"), norm_heading(text)))
    chapter = F.col("_looks") & _starts(F.col("_norm"), START + CHAPTER)
    rows = rows.withColumns({"hk": heading_kind(text, F.col("_looks"), F.col("_norm")), "_prose": is_body_prose(text), "_chapter": chapter}).drop("_looks", "_norm")
    rows = rows.withColumns({"_next": F.lead("_prose").over(_order()), "_prev": F.lag("hk").over(_order())})
    low = lambda cond: F.min(F.when(cond, F.col("idx"))).over(_doc())
    rows = rows.withColumns({"_toc": low(F.col("hk") == "toc"), "_last": F.max(F.when(F.col("_chapter") & F.col("_next"), F.col("idx"))).over(_doc()), "_first": low(F.col("_prose")), "_head": low(F.col("hk").isin("content_start", "content"))})
    rows = rows.withColumn("_body", F.coalesce(low(F.col("_prose") & (F.col("idx") > F.coalesce("_toc", F.lit(-1)))), F.col("_first")))
    opened = F.max(F.when((F.col("idx") == F.col("_body")) & F.col("_prev").isin("content_start", "content"), F.col("idx") - 1)).over(_doc())
    rows = rows.withColumn("_open", F.coalesce(opened, F.col("_body"), F.col("_head")))
    ends = low((F.col("hk") == "backmatter") & (F.col("idx") > F.col("_open")) & ~(F.coalesce("_last", F.lit(-1)) > F.col("idx")))
    rows = rows.withColumn("_end", ends)
    idx, open_ = F.col("idx"), F.col("_open")
    reason = F.when(open_.isNull(), None).when(idx < open_, F.when(idx >= F.col("_toc"), "toc").otherwise("title"))
    reason = reason.when(idx >= F.col("_end"), "backmatter").when(is_table(text), "table")
    rows = rows.withColumn("drop_reason", reason)
    return rows.withColumn("kind", F.when(F.col("drop_reason").isNull(), "content").otherwise("service")).select(*paras.columns, "hk", "kind", "drop_reason")


def _placed(content: DataFrame, among: Column) -> DataFrame:
    """Adds ps, pe: positions in the stream of a document's paragraphs joined by two characters. Paragraphs that are not `among`
    those of the stream take no place in it."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    rows = content.withColumn("ps", F.coalesce(F.sum(F.when(among, F.length("text") + 2).otherwise(0)).over(before), F.lit(0)).cast("int"))
    return rows.withColumn("pe", F.col("ps") + F.length("text"))


def content_spans(content: DataFrame) -> DataFrame:
    """Adds ps, pe: positions in the stream of a document's paragraphs joined by two characters; and word ranges
    w0, w1 (first and last word number; those of the previous word without words, at least 0)."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    rows = _placed(content.withColumn("_n", T.word_count(F.col("text"))), F.lit(True))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    first = F.when(F.col("_n") > 0, F.col("_before")).otherwise(F.greatest(F.col("_before") - 1, F.lit(0)))
    last = F.greatest(F.col("_before") + F.col("_n") - 1, F.lit(0))
    return rows.withColumns({"w0": first, "w1": last}).drop("_n", "_before")


def _blocks(stream: Column, step: int) -> Column:
    """The stream in parts of `step` words, each from the end of the one before to the end of its last word; null alone
    for a stream without words. One pass; `step` is bounded by the depth of an expression."""
    if step > T.MATCHED_WORDS:
        raise ValueError(f"windows advance by at most {T.MATCHED_WORDS} words")
    found = F.regexp_extract_all(stream, F.lit(rf"(?>[^\p{{L}}]*+{T.WORD_END}){{1,{step}}}"), 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))


def _windows(blocks: DataFrame, sizes: tuple[tuple[int, int], ...], *carried: str) -> DataFrame:
    """Windows of rows (doc_id, size, b, block, *carried): running sums of block lengths give offsets, and the blocks that
    follow the text. A document without words has one row with a null `text`."""
    per = Window.partitionBy("doc_id", "size")
    order = per.orderBy("b")
    length = F.length("block")
    many = {m: [size for size, step in sizes if size // step == m] for m in {size // step for size, step in sizes}}

    def by_size(make):
        value = None
        for m, found in many.items():
            hit = F.col("size").isin(found)
            value = F.when(hit, make(m)) if value is None else value.when(hit, make(m))
        return value

    ahead = lambda m: order.rowsBetween(0, m - 1)
    rows = blocks.select(
        "doc_id", "size", "b", *carried, length.alias("_len"), F.length(F.regexp_extract("block", rf"(?s)\A(.*?){T.WHOLE_WORD}", 1)).alias("_gap"),
        F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        by_size(lambda m: F.sum(length).over(ahead(m))).alias("_span"), by_size(lambda m: F.array_join(F.collect_list("block").over(ahead(m)), "")).alias("_text"),
        by_size(lambda m: F.lead("block", m).over(order)).alias("_more"), F.greatest(F.lit(1), F.count("block").over(per) - by_size(lambda m: F.lit(m - 1))).alias("_k"),
    )
    # a last window of few characters joins the one before
    rows = rows.withColumn("_short", (F.col("_k") > 1) & F.coalesce(F.max(F.when(F.col("b") == F.col("_k") - 1, F.col("_span") - F.col("_gap"))).over(per) < MIN_CHARS, F.lit(False)))
    rows = rows.withColumn("n_wins", (F.col("_k") - F.col("_short").cast("int")).cast("int")).where("b < n_wins")
    more = F.when(F.col("_short") & (F.col("b") == F.col("n_wins") - 1), F.col("_more"))
    text = F.when(F.col("_len").isNotNull(), F.substring(F.concat("_text", F.coalesce(more, F.lit(""))), F.col("_gap") + 1, F.lit(2**31 - 1)))
    return rows.select("doc_id", "size", F.col("b").alias("win_no"), "n_wins", (F.col("_before") + F.col("_gap")).cast("int").alias("cstart"), (F.col("_before") + F.col("_span") + F.coalesce(F.length(more), F.lit(0))).cast("int").alias("cend"), text.alias("text"), *carried)


def build_windows(content: DataFrame, size: int = WINDOW_WORDS, step: int = STEP) -> DataFrame:
    """(doc_id, win_no, n_wins, cstart, cend, text): windows of `size` words every `step` over a document's stream; a
    last one of under 200 characters joins the one before. `size` is a multiple of `step`. The stream is cut into blocks of `step`
    words in one pass, and offsets are running sums over blocks, so the work is linear in the text."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    docs = content.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("stream"))
    blocks = docs.select("doc_id", F.lit(size).alias("size"), F.posexplode(_blocks(F.col("stream"), step)).alias("b", "block"))
    return _windows(blocks, ((size, step),)).where("text is not null").drop("size")


def score_paragraphs(paras: DataFrame, scorers: tuple[str, ...] = ("a",), sizes: tuple[tuple[int, int], ...] = ((WINDOW_WORDS, STEP),)) -> DataFrame:
    """`paras` with ps, pe and, for each of `sizes` (words, step), a row with size, covered_chars and p_<name> of each scorer:
    the mean of window scores weighted by overlap, null below 200 covered characters.

    Rows have doc_id, idx and text; where they have `kind`, only content lies in windows. One shuffle of the text, by doc_id.
    """
    own = [c for c in paras.columns if c not in ("doc_id", "idx")]
    content = F.col("kind") == "content" if "kind" in own else F.lit(True)
    rows = _placed(paras, content)
    own += ["ps", "pe"]
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", *own, content.alias("_in")))).alias("paras"))
    stream = F.array_join(F.transform(F.filter("paras", lambda r: r["_in"]), lambda r: r["text"]), "\n\n")
    docs = docs.select("doc_id", "paras", stream.alias("stream"))
    none = F.lit(None).cast(docs.schema["paras"].dataType)
    # the paragraphs ride beside the first block alone, so nothing is copied for each window
    def part(k: int, size: int):
        beside = lambda i: F.when(i == 0, F.col("paras")).otherwise(none) if k == 0 else none
        return lambda x, i: F.struct(F.lit(size).alias("size"), i.alias("b"), x.alias("block"), beside(i).alias("paras"))

    parts = F.concat(*[F.transform(_blocks(F.col("stream"), step), part(k, size)) for k, (size, step) in enumerate(sizes)])
    blocks = docs.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.size", "x.b", "x.block", "x.paras")
    wins = _windows(blocks, sizes, "paras")
    win = F.when(F.col("text").isNotNull(), F.struct("size", "win_no", "cstart", "cend", "text"))
    met = wins.groupBy("doc_id").agg(F.collect_list("paras").alias("paras"), F.array_sort(F.collect_list(win)).alias("wins"))
    # a document's windows are scored and laid back side by side, as rows that come back from Python would have to be shuffled again
    met = met.select("doc_id", F.col("paras")[0].alias("paras"), "wins")
    laid = features.laid_back(*[F.col(f"wins.{c}") for c in ("size", "cstart", "cend", "text")], *[F.col(f"paras.{c}") for c in ("ps", "pe", "_in")], tuple(size for size, _ in sizes), scorers)
    # no array is empty; without `outer` Spark would infer a filter of their sizes and call Python once more for it
    rows = met.withColumn("_laid", laid).select("doc_id", "paras", F.posexplode_outer("_laid").alias("at", "x"))
    r = F.col("paras")[F.col("at") % F.size("paras")]
    scores = [F.when(F.col("x.covered") >= MIN_CHARS, F.round(F.col(f"x.s_{name}") / F.col("x.chars"), 6)).alias(f"p_{name}") for name in scorers]
    return rows.select("doc_id", r["idx"].alias("idx"), *[r[c].alias(c) for c in own], F.col("x.size").alias("size"), F.col("x.covered").alias("covered_chars"), *scores)


def interval_join(spans: DataFrame, wins: DataFrame, size: int = WINDOW_WORDS, step: int = STEP) -> DataFrame:
    """Paragraph spans (doc_id, idx, ps, pe, w0, w1) with each window that overlaps them, as (doc_id, idx, win_no, os,
    oe, ...). The windows over a paragraph follow from its word numbers, so the join is on (doc_id, win_no)."""
    n = wins.groupBy("doc_id").agg(F.max("n_wins").alias("_k"))
    top = F.col("_k") - 1
    low = F.greatest(F.lit(0), F.least(top, F.floor((F.col("w0") - size) / step).cast("int") + 1) - 1)
    high = F.greatest(F.least(top, F.floor(F.col("w1") / step).cast("int") + 1), low)
    rows = spans.join(n, "doc_id").withColumn("win_no", F.explode(F.sequence(low, high))).drop("_k")
    rows = rows.join(wins.drop("text", "n_wins"), ["doc_id", "win_no"])
    rows = rows.withColumns({"os": F.greatest("ps", "cstart"), "oe": F.least("pe", "cend")})
    return rows.where("oe > os")


def project_to_paragraphs(spans: DataFrame, wins: DataFrame, threshold: float, p: str = "p_a", size: int = WINDOW_WORDS, step: int = STEP) -> DataFrame:
    """Adds p (mean of window scores weighted by overlap; null below 200 covered characters), covered_chars, label."""
    pairs = interval_join(spans.select("doc_id", "idx", "ps", "pe", "w0", "w1"), wins.select("doc_id", "win_no", "n_wins", "cstart", "cend", F.col(p).alias("_p")), size, step)
    before = Window.partitionBy("doc_id", "idx").orderBy("os", "oe", "win_no").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("oe") - F.greatest("os", F.coalesce(F.max("oe").over(before), F.col("os"))))
    over = F.col("oe") - F.col("os")
    met = pairs.withColumn("_new", new).groupBy("doc_id", "idx").agg((F.sum(F.col("_p") * over) / F.sum(over)).alias("p"), F.sum("_new").alias("covered_chars"))
    rows = spans.join(met, ["doc_id", "idx"], "left").withColumn("covered_chars", F.coalesce("covered_chars", F.lit(0)))
    rows = rows.withColumn("p", F.when(F.col("covered_chars") >= MIN_CHARS, F.round("p", 6)))
    return rows.withColumn("label", T.label_for(F.col("p"), threshold))


#: Patterns of short paragraphs; fixed values.
CAPTION = r"^[ \t]*(рис(унок)?\.?|табл(ица)?\.?|схема|диаграмма|листинг|график)[ \t]*№?[ \t]*[0-9]"
SUBHEAD = r"^[ \t]*[0-9]+(\.[0-9]+)+\.?[ \t]+[^ \t]"
BULLET = r"^[ \t]*([–—•·●*]|[a-zа-яё]\)|\(?[0-9]+[.)])[ \t]"
SYMBOL = r"[=∑×÷≤≥≈∫√±]"
CODE = r"(^|[^\p{L}\p{N}_])(def|return|self|import|class|elif|sum|append|print)($|[^\p{L}\p{N}_])|[\p{L}\p{N}_]\([\p{L}\p{N}_]*\)"


def classify_short(text: Column, heading: Column | None = None, caption: Column | None = None, math: Column | None = None) -> Column:
    """What a short paragraph is: heading, caption, formula, list_item, table_cell or short_prose."""
    no = F.lit(False)
    n = T.word_count(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    kind = F.when(heading if heading is not None else no, "heading").when(caption if caption is not None else no, "caption").when(math if math is not None else no, "formula")
    kind = kind.when(F.rlike(F.lower(text), F.lit(CAPTION)), "caption").when((F.length(text) < 175) & F.rlike(text, F.lit(SYMBOL)), "formula")
    kind = kind.when(F.rlike(text, F.lit(CODE)) & F.rlike(text, F.lit(r"[(=.]")), "formula").when(F.rtrim(F.lower(text), F.lit(":")).isin("где", "примечание"), "formula")
    kind = kind.when(_heads(text, START + CHAPTER + TOC + BACKMATTER) | F.rlike(text, F.lit(SUBHEAD)), "heading")
    kind = kind.when((F.length(text) < 70) & (letters > 0) & (F.try_divide(capitals, letters) > 0.6), "heading").when(F.rlike(text, F.lit(BULLET)), "list_item")
    return kind.when(F.rlike(text, F.lit(r"[.!?]\z")) | (n >= 8), "short_prose").when(n <= 5, "table_cell").otherwise("short_prose")


def category_short(text: Column) -> Column:
    """The plainer categories of the listing of flagged paragraphs."""
    low = F.lower(T.strip(text))
    word = lambda names: F.rlike(low, F.lit(f"^({names})($|[^\\p{{L}}\\p{{N}}_])"))
    kind = F.when(word("глава|раздел|выводы|заключение|введение") | F.rlike(low, F.lit(NUMBERED)), "heading")
    kind = kind.when(word(r"рис\.?|рисунок|табл\.?|таблица|схема|диаграмма|листинг|формула"), "caption")
    kind = kind.when(F.rlike(low, F.lit(r"^[–—•·*-][ \t]|^[a-zа-я]\)[ \t]|^[0-9]+[.)][ \t]")), "list_item")
    return kind.when(F.rlike(text, F.lit("[=∑×]")) & (F.length(text) < 130), "formula").otherwise("short_prose")


def glue_short_prose(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, anchor_idx, member_idxs, text, n_chars): runs of two or more short prose paragraphs (p null, subcat
    short_prose) with consecutive idx whose join has 200 characters; and columns `keep`, which are the same all over a document."""
    short = results.where("p is null and subcat = 'short_prose'")
    runs = short.withColumn("_run", F.col("idx") - F.row_number().over(_order()))
    members = F.array_sort(F.collect_list(F.struct("idx", "text")))
    frags = runs.groupBy("doc_id", "_run").agg(members.alias("m"), *[F.first(c).alias(c) for c in keep]).where(F.size("m") > 1)
    frags = frags.select("doc_id", F.col("m")[0]["idx"].alias("anchor_idx"), F.transform("m", lambda r: r["idx"]).alias("member_idxs"), F.array_join(F.transform("m", lambda r: r["text"]), " ").alias("text"), *keep)
    return frags.withColumn("n_chars", F.length("text")).where(F.col("n_chars") >= MIN_CHARS)


def show_glued(results: DataFrame, threshold: float, scorer: str = "a") -> DataFrame:
    """(doc_id, idx, n_chars, label, is_glued): content paragraphs, with the fragments of `glue_short_prose`, scored, in place of their
    members and at their first one. One pass: members find their fragment by windows over the document."""
    short = F.coalesce(F.col("p").isNull() & (F.col("subcat") == "short_prose"), F.lit(False))
    rows = results.select("doc_id", "idx", "text", "label", short.alias("_short"))
    rows = rows.withColumn("_run", F.when(F.col("_short"), F.col("idx") - F.sum(F.col("_short").cast("int")).over(_order())))
    run = Window.partitionBy("doc_id", "_run")
    joined = F.sum(F.length("text")).over(run) + F.count("*").over(run) - 1
    rows = rows.withColumn("_glued", F.col("_short") & (F.count("*").over(run) > 1) & (joined >= MIN_CHARS))
    # a paragraph that is in no fragment is a group of its own
    anchor = F.when(F.col("_glued"), F.min("idx").over(run)).otherwise(F.col("idx"))
    member = F.when(F.col("_glued"), F.struct("idx", "text"))
    found = rows.withColumn("_at", anchor).groupBy("doc_id", "_at").agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("label").alias("_label"), F.first(F.length("text")).alias("_n"))
    glued = F.size("m") > 0
    found = found.select("doc_id", F.col("_at").alias("idx"), "_label", "_n", glued.alias("is_glued"), F.when(glued, F.array_join(F.transform("m", lambda r: r["text"]), " ")).alias("text"))
    scored = features.with_scores(found, "text", (scorer,))
    pick = lambda a, b: F.when(F.col("is_glued"), a).otherwise(b)
    return scored.select("doc_id", "idx", pick(F.col("n_chars"), F.col("_n")).alias("n_chars"), pick(T.label_for(F.col(f"p_{scorer}"), threshold), F.col("_label")).alias("label"), "is_glued")


def glue_aggressive(results: DataFrame, tables: DataFrame) -> DataFrame:
    """Fragments as above, but over anything except tables (doc_id, idx): short prose adds up in order and a fragment
    closes at 300 characters."""
    short = results.where("p is null and subcat = 'short_prose'").select("doc_id", "idx", "text", F.lit(True).alias("is_short"), F.lit(False).alias("is_table"))
    return glue_between_tables(short.unionByName(tables.select("doc_id", "idx", F.lit("").alias("text"), F.lit(False).alias("is_short"), F.lit(True).alias("is_table"))))


def glue_between_tables(marks: DataFrame) -> DataFrame:
    """Fragments of `glue_aggressive` from one set of rows (doc_id, idx, text, is_short, is_table). A fold over a document's short prose
    gives each of its paragraphs its fragment's number, and the texts ride along."""
    # out of a generator, so that what tells short prose is computed for the filter alone
    rows = metrics.apart(marks).where("is_short or is_table").withColumn("epoch", F.sum(F.col("is_table").cast("int")).over(_order())).where("is_short")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "text", F.length("text").alias("len"), "epoch"))).alias("m"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("sum"), F.lit(-1).cast("long").alias("epoch"), F.array().cast("array<int>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        fresh = (s["sum"] >= GLUE_TARGET) | (s["epoch"] != x["epoch"])
        g, total = F.when(fresh, s["g"] + 1).otherwise(s["g"]), F.when(fresh, x["len"]).otherwise(s["sum"] + x["len"])
        return F.struct(g.alias("g"), total.alias("sum"), x["epoch"].alias("epoch"), F.concat(s["out"], F.array(g)).alias("out"))

    numbers = F.aggregate("m", start, add, lambda s: s["out"])
    each = docs.select("doc_id", F.explode(F.arrays_zip(numbers.alias("g"), F.col("m").alias("r"))).alias("x")).select("doc_id", "x.g", "x.r.idx", "x.r.text")
    frags = each.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("m")).where(F.size("m") > 1)
    frags = frags.select("doc_id", F.col("m")[0]["idx"].alias("anchor_idx"), F.transform("m", lambda r: r["idx"]).alias("member_idxs"), F.array_join(F.transform("m", lambda r: r["text"]), " ").alias("text"))
    return frags.withColumn("n_chars", F.length("text")).where(F.col("n_chars") >= MIN_CHARS)


def score_fragments(frags: DataFrame, threshold: float, scorer: str = "a", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds p and label of fragments."""
    scored = features.with_scores(frags, "text", (scorer,))
    return scored.select("doc_id", "anchor_idx", "member_idxs", "n_chars", F.round(f"p_{scorer}", 6).alias("p"), T.label_for(F.col(f"p_{scorer}"), threshold).alias("label"), *keep)


def _scanned(paras: DataFrame, threshold: float, scorers: tuple[str, ...], size: int, step: int) -> DataFrame:
    rows = score_paragraphs(paras, scorers, ((size, step),)).drop("size").withColumnRenamed(f"p_{scorers[0]}", "p")
    return rows.withColumn("label", T.label_for(F.col("p"), threshold))


def scan_all(docs: DataFrame, threshold: float = 0.72, sep: str = r"\n[ \t]*\n+", scorers: tuple[str, ...] = ("a",), size: int = WINDOW_WORDS, step: int = STEP, blocks: DataFrame | None = None, spans: bool = True) -> DataFrame:
    """Every paragraph of every document with kind and drop_reason; content also has p, covered_chars, label and subcat (null if
    scored), for the first of `scorers`; with two, also p_<name> for each further one. `blocks` are flags of `attach_block_meta`, by
    which short paragraphs are told apart first. Without `spans`, rows have no start and end."""
    paras = split_paragraphs(docs, sep, spans=spans)
    flags = (None, None, None)
    if blocks is not None:
        paras, flags = attach_block_meta(paras, blocks), (F.col("is_heading"), F.col("is_caption"), F.col("has_math"))
    rows = _scanned(classify_sections(paras), threshold, scorers, size, step)
    content = F.col("kind") == "content"
    return rows.withColumns({"label": F.when(content, F.col("label")), "subcat": F.when(content & F.col("p").isNull(), classify_short(F.col("text"), *flags))})


def scan_documents(docs: DataFrame, threshold: float = 0.72, sep: str = r"\n[ \t]*\n+", scorers: tuple[str, ...] = ("a",), size: int = WINDOW_WORDS, step: int = STEP, blocks: DataFrame | None = None, spans: bool = True) -> DataFrame:
    """The content paragraphs of `scan_all`."""
    return scan_all(docs, threshold, sep, scorers, size, step, blocks, spans).where("kind = 'content'")


def document_map(docs: DataFrame, threshold: float = 0.72, sep: str = r"\n[ \t]*\n+") -> DataFrame:
    """Every paragraph of every document, content and dropped, with kind and drop_reason; content also has p and label."""
    return scan_all(docs, threshold, sep, spans=False).select("doc_id", "idx", "text", "kind", "drop_reason", "p", "label")


def attach_truth(paras: DataFrame, truth: DataFrame) -> DataFrame:
    """Scanned paragraphs with the label of `truth` (doc_id, text, label) that has their text; unknown ones go. Texts meet
    by digest, and a text that a document repeats has its largest label."""
    known = truth.groupBy("doc_id", F.sha2("text", 256).alias("_key")).agg(F.max("label").alias("truth"))
    return paras.withColumn("_key", F.sha2("text", 256)).join(known, ["doc_id", "_key"]).drop("_key")


def summarize(results: DataFrame) -> DataFrame:
    """(doc_id, label, chars, share): characters of each label in a document, absent labels with 0."""
    labels = F.array(*map(F.lit, ("human", "insufficient", "suspicious", "uncertain")))
    sums = results.groupBy("doc_id").pivot("label", ["human", "insufficient", "suspicious", "uncertain"]).agg(F.sum(F.length("text")))
    chars = F.map_from_arrays(labels, F.array(*[F.coalesce(F.col(c), F.lit(0)) for c in ("human", "insufficient", "suspicious", "uncertain")]))
    rows = sums.select("doc_id", F.explode(chars).alias("label", "chars"))
    total = F.sum("chars").over(_doc())
    return rows.withColumn("share", F.round(F.col("chars") / F.greatest(total, F.lit(1)), 6))
