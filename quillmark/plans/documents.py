"""Queries over documents cut into paragraphs, sections and windows, with their DuckDB equivalents.

The fixture texts have one paragraph a line; where sections matter they are wrapped into a title, a table of contents,
one chapter and back matter, built by the same expressions here and in SQL. Where short paragraphs matter, each third
line is broken into paragraphs of at most 120 characters; no text is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions import text as T
from ..operators import reports, segments
from ..sources.folders import scratch

THRESHOLD = 0.72
TABLE = "⟦таблица: 4 ячеек⟧"
#: Where a line is broken: the last space within 120 characters.
BREAK = r"([^\n]{60,119}) "
HEAD = ("Заголовок работы", "Содержание", "Введение\t3", "Список литературы\t9", "Введение")
TAIL = ("Список литературы", "1. Иванов И. И. Книга. — 2020.")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def wrapped(docs: DataFrame, tables: bool = False, shorten: bool = False) -> DataFrame:
    lines = F.split("text", "\n")
    if shorten:
        lines = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.regexp_replace(x, BREAK, "$1\n\n")).otherwise(x))
    if tables:
        lines = F.transform(lines, lambda x, i: F.when((i + 1) % 3 == 0, F.concat(x, F.lit("\n\n" + TABLE))).otherwise(x))
    return docs.withColumn("text", F.concat(F.lit("\n\n".join(HEAD) + "\n\n"), F.array_join(lines, "\n\n"), F.lit("\n\n" + "\n\n".join(TAIL))))


def _paras(spark, sf_dir, **how):
    return segments.split_paragraphs(wrapped(documents(spark, sf_dir), **how))


def _results(spark, sf_dir, scorers=("a",)):
    """A scan of documents with tables in which short paragraphs lie between long ones."""
    return segments.scan_documents(wrapped(documents(spark, sf_dir), True, True), THRESHOLD, scorers=scorers, spans=False)


def paragraphs(spark, sf_dir):
    return segments.split_paragraphs(documents(spark, sf_dir), "\n")


def block_flags(spark, sf_dir):
    paras = segments.split_paragraphs(documents(spark, sf_dir), "\n")
    blocks = paras.where("not (doc_id % 5 = 0 and idx = 0)").select("doc_id", "idx", F.concat(F.lit("style "), F.col("idx") % 3).alias("style"), (F.col("idx") == 0).alias("is_heading"), (F.col("idx") % 4 == 1).alias("is_caption"), (F.col("idx") % 7 == 2).alias("has_math"))
    return segments.attach_block_meta(paras, blocks).drop("text", "start", "end")


def section_map(spark, sf_dir):
    return segments.classify_sections(_paras(spark, sf_dir, tables=True)).select("doc_id", "idx", "hk", "kind", "drop_reason")


def dropped_counts(spark, sf_dir):
    return segments.classify_sections(_paras(spark, sf_dir, tables=True)).where("kind = 'service'").groupBy("doc_id", "drop_reason").agg(F.count("*").alias("n"))


def _content(spark, sf_dir):
    return segments.split_paragraphs(documents(spark, sf_dir), "\n")


def content_stream(spark, sf_dir):
    return segments.content_spans(_content(spark, sf_dir)).select("doc_id", "idx", "ps", "pe")


def word_windows(spark, sf_dir):
    return segments.build_windows(_content(spark, sf_dir)).select("doc_id", "win_no", "n_wins", "cstart", "cend", F.md5("text").alias("text_md5"))


def paragraph_scores(spark, sf_dir):
    found = segments.score_paragraphs(_content(spark, sf_dir))
    return found.select("doc_id", "idx", F.col("p_a").alias("p"), "covered_chars", T.label_for(F.col("p_a"), THRESHOLD).alias("label"))


def document_scan(spark, sf_dir):
    """The flagship: paragraphs of all documents scored through windows, characters by language and label."""
    found = segments.score_paragraphs(segments.split_paragraphs(documents(spark, sf_dir), "\n", ("lang",)))
    rows = found.select("lang", T.label_for(F.col("p_a"), THRESHOLD).alias("label"), F.length("text").alias("n"))
    return rows.groupBy("lang", "label").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("chars"))


def label_shares(spark, sf_dir):
    return segments.summarize(_results(spark, sf_dir))


def short_kinds(spark, sf_dir):
    paras = _paras(spark, sf_dir, tables=True, shorten=True)
    return paras.select("doc_id", "idx", segments.classify_short(F.col("text")).alias("subcat"), segments.category_short(F.col("text")).alias("category"))


def insufficient_breakdown(spark, sf_dir):
    counts = _results(spark, sf_dir).where("p is null").groupBy("doc_id", "subcat").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("subcat") == "short_prose", 0).otherwise(1), F.desc("n"), "subcat")
    return counts.withColumn("place", F.row_number().over(order))


def glued(spark, sf_dir):
    return segments.glue_short_prose(_results(spark, sf_dir)).select("doc_id", "anchor_idx", "member_idxs", "n_chars", F.md5("text").alias("text_md5"))


def glued_aggressive(spark, sf_dir):
    # tables are in the same scan as short prose, so the texts are read once
    rows = segments.scan_all(wrapped(documents(spark, sf_dir), True, True), THRESHOLD, spans=False)
    short = F.coalesce((F.col("kind") == "content") & F.col("p").isNull() & (F.col("subcat") == "short_prose"), F.lit(False))
    marks = rows.select("doc_id", "idx", "text", short.alias("is_short"), segments.is_table(F.col("text")).alias("is_table"))
    return segments.score_fragments(segments.glue_between_tables(marks), THRESHOLD)


def glue_stats(spark, sf_dir):
    """Fragments by label, the characters of their members, and the share of short prose that glue makes scorable."""
    # all characters of a document ride along, so the scan is read once
    results = _results(spark, sf_dir).withColumn("all_chars", F.sum(F.length("text")).over(Window.partitionBy("doc_id")))
    frags = segments.glue_short_prose(results, keep=("all_chars",))
    # the members' characters are the fragment's without the spaces that join them
    frags = segments.score_fragments(frags.withColumn("chars", (F.col("n_chars") - F.size("member_idxs") + 1).cast("long")), THRESHOLD, keep=("chars", "all_chars"))
    rows = frags.groupBy("doc_id", "label").agg(F.count("*").alias("fragments"), F.sum("chars").alias("member_chars"), F.first("all_chars").alias("all_chars"))
    return rows.select("doc_id", "label", "fragments", "member_chars", F.round(F.col("member_chars") / F.col("all_chars"), 6).alias("share"))


def document_map(spark, sf_dir):
    """Content and dropped paragraphs in one table, by idx: the label of content, the reason of what was dropped."""
    return segments.document_map(wrapped(documents(spark, sf_dir), True, True), THRESHOLD).select("doc_id", "idx", F.length("text").alias("n_chars"), "kind", "drop_reason", "p", "label")


def map_glued(spark, sf_dir):
    """The document map with a fragment's members shown at its anchor alone."""
    return segments.show_glued(_results(spark, sf_dir), THRESHOLD)


def direct_scores(spark, sf_dir):
    """Paragraphs of 120 characters scored on their own: share flagged and median score of each document."""
    long = segments.split_paragraphs(documents(spark, sf_dir), "\n").where(F.length("text") >= 120)
    scored = features.with_scores(long)
    return scored.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_a") >= THRESHOLD).cast("int")), 6).alias("share"), F.round(F.percentile("p_a", F.lit(0.5)), 6).alias("median_p"))


def flagged_listing(spark, sf_dir):
    """For each document: all suspicious and uncertain paragraphs by falling score, the five likeliest of the human
    ones, and the first eight of each short category."""
    rows = _results(spark, sf_dir).withColumn("section", F.when(F.col("p").isNull(), F.concat(F.lit("short:"), segments.category_short(F.col("text")))).otherwise(F.col("label")))
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy(F.desc("p"), "idx"))
    keep = F.when(F.col("section") == "human", 5).when(F.startswith("section", F.lit("short:")), 8).otherwise(1_000_000)
    return rows.withColumn("place", place).where(F.col("place") <= keep).select("doc_id", "section", "place", "idx", "p", T.preview(F.col("text"), 60).alias("preview"))


def agreement(spark, sf_dir):
    """Two scorers' paragraph labels: both_ai, both_human, disagree or insufficient, at 0.60 and 0.72."""
    a, b = F.col("p_a") >= 0.60, F.col("p_b") >= 0.72
    found = _two(spark, sf_dir)
    label = F.when(F.col("p_a").isNull() | F.col("p_b").isNull(), "insufficient").when(a & b, "both_ai").when(~a & ~b, "both_human").otherwise("disagree")
    gap = F.round(F.abs(F.col("p_a") - F.col("p_b")), 6)
    return found.select("doc_id", "idx", "p_a", "p_b", label.alias("agreement"), gap.alias("gap"), F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last(gap), "idx")).alias("place"))


def _two(spark, sf_dir):
    return segments.score_paragraphs(_content(spark, sf_dir), ("a", "b")).select("doc_id", "idx", "p_a", "p_b")


def quick_agreement(spark, sf_dir):
    """Share of strong divergence over at most 30 evenly spaced windows of documents with three or more."""
    wins = segments.build_windows(_content(spark, sf_dir)).where("n_wins >= 3")
    n = F.least("n_wins", F.lit(30))
    # the i-th of n samples is window floor(i * n_wins / n); only this i can give win_no
    i = F.ceil(F.col("win_no") * n / F.col("n_wins"))
    chosen = features.with_scores(wins.where((i < n) & (F.floor(i * F.col("n_wins") / n) == F.col("win_no"))), "text", ("a", "b"))
    return chosen.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p_b") >= THRESHOLD) & (F.col("p_a") < 0.45)).cast("int")), 6).alias("divergence"))


def text_features(spark, sf_dir):
    cols = ["burst", "mean_len", "mattr", "phrase", "punct"]
    return features.with_features(documents(spark, sf_dir)).select("doc_id", "n_chars", "n_words", *[F.round(c, 6).alias(c) for c in cols])


def reported(spark, sf_dir):
    """(content, dropped paragraphs, scored fragments with their text) of one scan, for reports. The scan is written to the checkpoint
    folder, as a report takes parts of it in several ways."""
    path = scratch(spark, "scan")
    segments.scan_all(wrapped(documents(spark, sf_dir), True, True), THRESHOLD, spans=False).select("doc_id", "idx", "text", "kind", "drop_reason", "p", "label", "subcat").write.parquet(path)
    rows = spark.read.parquet(path)
    results = rows.where("kind = 'content'")
    return results, rows.where("kind = 'service'"), segments.score_fragments(segments.glue_short_prose(results), THRESHOLD, keep=("text",))


def report_markdown(spark, sf_dir):
    return reports.report_markdown(*reported(spark, sf_dir), THRESHOLD).select("doc_id", F.md5("md").alias("md5"), F.length("md").alias("n"))


def report_html(spark, sf_dir):
    return reports.report_html(*reported(spark, sf_dir), THRESHOLD).select("doc_id", F.md5("html").alias("md5"), F.length("html").alias("n"))


def block_scan(spark, sf_dir):
    """Kinds of short paragraphs where the extraction of blocks said what some of them are."""
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", BREAK, "$1\n"))
    blocks = segments.split_paragraphs(docs, "\n").select("doc_id", "idx", F.lit("").alias("style"), (F.col("idx") % 5 == 0).alias("is_heading"), (F.col("idx") % 5 == 1).alias("is_caption"), (F.col("idx") % 5 == 2).alias("has_math"))
    rows = segments.scan_documents(docs, THRESHOLD, "\n", blocks=blocks)
    return rows.groupBy("doc_id", "subcat").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def agreement_counts(spark, sf_dir):
    """Each document's paragraphs by agreement, and the share that scorers disagree on of those that both scored."""
    rows = agreement(spark, sf_dir)
    count = lambda label: F.count_if(F.col("agreement") == label)
    both = F.count("*") - count("insufficient")
    return rows.groupBy("doc_id").agg(*[count(label).alias(label) for label in ("both_ai", "both_human", "disagree", "insufficient")], F.round(count("disagree") / F.nullif(both, F.lit(0)), 6).alias("disagreement"))


QUERIES = {f.__name__: f for f in (
    document_scan, paragraphs, block_flags, section_map, dropped_counts, content_stream, word_windows, paragraph_scores, label_shares, short_kinds,
    insufficient_breakdown, document_map, glued, glued_aggressive, glue_stats, map_glued, direct_scores, flagged_listing, agreement, quick_agreement, text_features,
    report_markdown, report_html, block_scan, agreement_counts,
)}


# ---- DuckDB ------------------------------------------------------------------------------------------------------

S = r"[ \t\n\r\f\x0B]"
W = features.SQL_WORD


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _any(text: str, markers: tuple[str, ...]) -> str:
    return _m(text, "^(" + "|".join(markers) + ")")


def sql_norm(text: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({text}), '^[ \t]*[0-9]+(\.[0-9]+)*\.?[ \t]*', ''), '{S}+', ' ', 'g')"


def sql_chapter(text: str) -> str:
    return _any(sql_norm(text), segments.START + segments.CHAPTER)


def sql_heading(text: str) -> str:
    return f"(len(list_filter(string_split_regex({text}, '{S}+'), lambda w: w <> '')) between 1 and 9 and not contains({text}, chr(10)))"


def sql_hk(text: str) -> str:
    n = sql_norm(text)
    return f"""case when not {sql_heading(text)} then null when {_m(text, segments.TOC_LINE)} or {_any(n, segments.TOC)} then 'toc' when {_any(n, segments.BACKMATTER)} then 'backmatter'
when {_any(n, segments.START)} then 'content_start' when {_any(n, segments.CHAPTER)} or {_m(text, segments.NUMBERED)} then 'content' end"""


def sql_short(text: str) -> str:
    letters, capitals = rf"length(regexp_replace({text}, '[^\p{{L}}]', '', 'g'))", rf"length(regexp_replace({text}, '[^\p{{Lu}}]', '', 'g'))"
    n = f"len(regexp_extract_all({text}, '{W}'))"
    return f"""case when {_m(f'lower({text})', segments.CAPTION)} then 'caption' when {_m(text, segments.SYMBOL)} and length({text}) < 175 then 'formula'
when {_m(text, segments.CODE)} and {_m(text, '[(=.]')} then 'formula' when rtrim(lower({text}), ':') in ('где', 'примечание') then 'formula'
when {sql_chapter(text)} or {_m(text, segments.SUBHEAD)} or {_any(sql_norm(text), segments.TOC + segments.BACKMATTER)} then 'heading'
when {letters} > 0 and {capitals} / {letters} > 0.6 and length({text}) < 70 then 'heading' when {_m(text, segments.BULLET)} then 'list_item'
when {_m(text, r'[.!?]\z')} or {n} >= 8 then 'short_prose' when {n} <= 5 then 'table_cell' else 'short_prose' end"""


def sql_category(text: str) -> str:
    low = f"lower({text})"
    word = lambda names: _m(low, rf"^({names})($|[^\p{{L}}\p{{N}}_])")
    return f"""case when {word('глава|раздел|выводы|заключение|введение')} or {_m(low, segments.NUMBERED)} then 'heading' when {word(r'рис\.?|рисунок|табл\.?|таблица|схема|диаграмма|листинг|формула')} then 'caption'
when {_m(low, r'^[–—•·*-][ \t]|^[a-zа-я]\)[ \t]|^[0-9]+[.)][ \t]')} then 'list_item' when {_m(text, '[=∑×]')} and length({text}) < 130 then 'formula' else 'short_prose' end"""


def sql_wrapped(tables: bool, shorten: bool) -> str:
    """CTE `docs`."""
    lines = "string_split(text, chr(10))"
    if shorten:
        lines = f"list_transform({lines}, lambda x, i: case when i % 3 = 1 then regexp_replace(x, '{BREAK}', '\\1' || chr(10) || chr(10), 'g') else x end)"
    if tables:
        lines = f"list_transform({lines}, lambda x, i: case when i % 3 = 0 then x || chr(10) || chr(10) || '{TABLE}' else x end)"
    join = lambda parts: " || chr(10) || chr(10) || ".join("'" + p.replace("\t", "' || chr(9) || '") + "'" for p in parts)
    return f"docs as (select doc_id, {join(HEAD)} || chr(10) || chr(10) || array_to_string({lines}, chr(10) || chr(10)) || chr(10) || chr(10) || {join(TAIL)} as text from documents)"


def sql_paras(source: str, sep: str) -> str:
    """CTE `paras`: parts between `sep`, one or two line ends."""
    n = sep.count("chr")
    return f"""parts as (select doc_id, unnest(string_split(text, {sep})) as part, unnest(range(len(string_split(text, {sep})))) as pos from {source}),
places as (select *, coalesce(sum(length(part) + {n}) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before_ from parts),
stripped as (select doc_id, pos, regexp_replace(part, '^{S}+|{S}+\\z', '', 'g') as text, before_ + length(part) - length(regexp_replace(part, '^{S}+', '')) as start from places),
paras as (select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as idx, text, start::bigint as start, (start + length(text))::bigint as "end" from stripped where text <> '')"""


SECTIONS = f"""s0 as (select *, {sql_hk("text")} as hk, length(text) >= 200 and not regexp_matches(text, '\\.{{4,}}') and not starts_with(text, '⟦таблица') as prose, {sql_heading("text")} and {sql_chapter("text")} as chapter from paras),
s1 as (select *, lead(prose) over (partition by doc_id order by idx) as nextp, lag(hk) over (partition by doc_id order by idx) as prevk from s0),
s2 as (select doc_id, min(idx) filter (where hk = 'toc') as toc, max(idx) filter (where chapter and nextp) as lastc, min(idx) filter (where prose) as firstp, min(idx) filter (where hk in ('content_start', 'content')) as head from s1 group by 1),
s3 as (select s1.*, s2.* exclude (doc_id) from s1 join s2 using (doc_id)),
s4 as (select doc_id, coalesce(min(idx) filter (where prose and idx > coalesce(toc, -1)), min(firstp)) as body from s3 group by 1),
s5 as (select s3.doc_id, coalesce(max(idx - 1) filter (where idx = body and prevk in ('content_start', 'content')), min(body), min(head)) as opened from s3 join s4 using (doc_id) group by 1),
s6 as (select s3.doc_id, min(idx) filter (where hk = 'backmatter' and idx > opened and not coalesce(lastc, -1) > idx) as ended from s3 join s5 using (doc_id) group by 1),
sections as (select *, case when drop_reason is null then 'content' else 'service' end as kind from (select s3.doc_id, idx, text, hk, case when opened is null then null when idx < opened then case when idx >= toc then 'toc' else 'title' end when idx >= ended then 'backmatter' when starts_with(text, '⟦таблица') then 'table' end as drop_reason from s3 join s5 using (doc_id) join s6 using (doc_id)))"""

SPANS = "spans as (select doc_id, idx, text, ps::bigint as ps, (ps + length(text))::bigint as pe from (select *, coalesce(sum(length(text) + 2) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as ps from content))"
WINS = rf"""streams as (select doc_id, string_agg(text, chr(10) || chr(10) order by idx) as stream from content group by 1),
w0 as (select doc_id, stream, list_transform(string_split_regex(stream, '{W}'), lambda x: length(x)) as g, list_transform(regexp_extract_all(stream, '{W}'), lambda x: length(x)) as w from streams),
w1 as (select *, len(w) as n from w0 where len(w) > 0),
w2 as (select *, case when n <= 150 then 1 else 1 + ceil((n - 150) / 75.0)::int end as k from w1),
w3 as (select doc_id, stream, k, j, coalesce(list_sum(g[1:j*75]), 0) + coalesce(list_sum(w[1:j*75]), 0) + g[j*75+1] as cstart, list_sum(g[1:least(j*75+150, n)]) + list_sum(w[1:least(j*75+150, n)]) as cend from (select *, unnest(range(k)) as j from w2)),
w4 as (select *, k > 1 and max(case when j = k - 1 then cend - cstart end) over (partition by doc_id) < 200 as merge, max(cend) over (partition by doc_id) as whole from w3),
w5 as (select doc_id, stream, j::int as win_no, (k - merge::int)::int as n_wins, cstart::bigint as cstart, (case when merge and j = k - 2 then whole else cend end)::bigint as cend from w4 where not (merge and j = k - 1)),
wins as (select doc_id, win_no, n_wins, cstart, cend, substr(stream, cstart + 1, cend - cstart) as text from w5)"""


def sql_scored(scorers: tuple[str, ...] = ("a",)) -> str:
    return f"scored as ({features.sql_features('wins', 'text', scorers)})"


def sql_projected(p: str = "p_a", name: str = "results") -> str:
    label = f"case when p is null then 'insufficient' when p >= {THRESHOLD} then 'suspicious' when p >= 0.5 then 'uncertain' else 'human' end"
    return f"""o_{name} as (select s.doc_id, s.idx, win_no, greatest(ps, cstart) as os, least(pe, cend) as oe, {p} as wp from spans s join scored w on w.doc_id = s.doc_id and w.cstart < s.pe and w.cend > s.ps),
c_{name} as (select *, greatest(0, oe - greatest(os, coalesce(max(oe) over (partition by doc_id, idx order by os, oe, win_no rows between unbounded preceding and 1 preceding), os))) as fresh from o_{name}),
g_{name} as (select doc_id, idx, sum(wp * (oe - os)) / sum(oe - os) as p, sum(fresh)::bigint as covered_chars from c_{name} group by 1, 2),
{name} as (select *, {label} as label from (select s.doc_id, s.idx, s.text, s.ps, s.pe, case when coalesce(covered_chars, 0) >= 200 then round(p, 6) end as p, coalesce(covered_chars, 0) as covered_chars from spans s left join g_{name} using (doc_id, idx)))"""


LINED = sql_paras("documents", "chr(10)")
CONTENT_ALL = "content as (select doc_id, idx, text from paras)"
CONTENT_KEPT = "content as (select doc_id, idx, text from sections where kind = 'content')"
DIRECT = f"{LINED}, {CONTENT_ALL}, {SPANS}, {WINS}, {sql_scored()}, {sql_projected()}"
TWO = "chr(10) || chr(10)"
WRAPPED = f"{sql_wrapped(True, False)}, {sql_paras('docs', TWO)}, {SECTIONS}"
SHORT = f"{sql_wrapped(True, True)}, {sql_paras('docs', TWO)}, {SECTIONS}, {CONTENT_KEPT}, {SPANS}, {WINS}, {sql_scored()}, {sql_projected('p_a', 'r0')}, results as (select *, case when p is null then {sql_short('text')} end as subcat from r0)"
FRAGS = "runs as (select *, idx - row_number() over (partition by doc_id order by idx) as run from results where p is null and subcat = 'short_prose'), frags as (select doc_id, min(idx) as anchor_idx, list(idx order by idx) as member_idxs, string_agg(text, ' ' order by idx) as text from runs group by doc_id, run having count(*) > 1 and length(string_agg(text, ' ' order by idx)) >= 200)"
LABEL_A = f"case when p_a >= {THRESHOLD} then 'suspicious' when p_a >= 0.5 then 'uncertain' else 'human' end"
SCORED_FRAGS = f"sf as (select doc_id, anchor_idx, member_idxs, n_chars, round(p_a, 6) as p, {LABEL_A} as label from ({features.sql_features('frags')}))"
AGGR = f"""marks as (select doc_id, idx, text, 0 as t from results where p is null and subcat = 'short_prose' union all select doc_id, idx, '', 1 from paras where starts_with(text, '⟦таблица')),
ep as (select *, sum(t) over (partition by doc_id order by idx) as epoch from marks),
m as (select doc_id, idx, text, epoch, row_number() over (partition by doc_id order by idx) as rn from ep where t = 0),
fold as (select doc_id, idx, text, epoch, rn, 1 as g, length(text) as total from m where rn = 1 union all
select m.doc_id, m.idx, m.text, m.epoch, m.rn, case when f.total >= 300 or f.epoch <> m.epoch then f.g + 1 else f.g end, case when f.total >= 300 or f.epoch <> m.epoch then length(m.text) else f.total + length(m.text) end from fold f join m on m.doc_id = f.doc_id and m.rn = f.rn + 1),
frags as (select doc_id, min(idx) as anchor_idx, list(idx order by idx) as member_idxs, string_agg(text, ' ' order by idx) as text from fold group by doc_id, g having count(*) > 1 and length(string_agg(text, ' ' order by idx)) >= 200)"""
TWO_SCORES = f"{LINED}, {CONTENT_ALL}, {SPANS}, {WINS}, {sql_scored(('a', 'b'))}, {sql_projected('p_a', 'ra')}, {sql_projected('p_b', 'rb')}"
PREVIEW = rf"(case when length(trim(regexp_replace(text, '{S}+', ' ', 'g'))) > 60 then substr(trim(regexp_replace(text, '{S}+', ' ', 'g')), 1, 60) || '…' else trim(regexp_replace(text, '{S}+', ' ', 'g')) end)"

REPORTED = "dr as (select * from sections where kind = 'service'), gl as (select sf.*, frags.text from sf join frags using (doc_id, anchor_idx))"

ORACLES = {
    "document_scan": f"with {DIRECT} select lang, label, count(*) as paragraphs, sum(length(results.text))::bigint as chars from results join documents using (doc_id) group by 1, 2",
    "paragraphs": f"with {LINED} select * from paras",
    "block_flags": f"""with {LINED}, b as (select * from paras where not (doc_id % 5 = 0 and idx = 0)), n as (select doc_id, count(*) as n from paras group by 1), k as (select doc_id, count(*) as k from b group by 1)
select p.doc_id, p.idx, case when n = k then 'style ' || (p.idx % 3) else '' end as style, coalesce(n = k and p.idx = 0, false) as is_heading, coalesce(n = k and p.idx % 4 = 1, false) as is_caption, coalesce(n = k and p.idx % 7 = 2, false) as has_math from paras p join n using (doc_id) left join k using (doc_id)""",
    "section_map": f"with {WRAPPED} select doc_id, idx, hk, kind, drop_reason from sections",
    "dropped_counts": f"with {WRAPPED} select doc_id, drop_reason, count(*) as n from sections where kind = 'service' group by 1, 2",
    "content_stream": f"with {LINED}, {CONTENT_ALL}, {SPANS} select doc_id, idx, ps, pe from spans",
    "word_windows": f"with {LINED}, {CONTENT_ALL}, {WINS} select doc_id, win_no, n_wins, cstart, cend, md5(text) as text_md5 from wins",
    "paragraph_scores": f"with {DIRECT} select doc_id, idx, p, covered_chars, label from results",
    "label_shares": f"""with {SHORT}, l as (select unnest(['human', 'insufficient', 'suspicious', 'uncertain']) as label), d as (select doc_id, sum(length(text)) as total from results group by 1)
select d.doc_id, l.label, coalesce(sum(length(r.text)), 0)::bigint as chars, round(coalesce(sum(length(r.text)), 0) / greatest(any_value(d.total), 1), 6) as share from d cross join l left join results r on r.doc_id = d.doc_id and r.label = l.label group by 1, 2""",
    "short_kinds": f"with {sql_wrapped(True, True)}, {sql_paras('docs', TWO)} select doc_id, idx, {sql_short('text')} as subcat, {sql_category('text')} as category from paras",
    "insufficient_breakdown": f"with {SHORT} select *, row_number() over (partition by doc_id order by case when subcat = 'short_prose' then 0 else 1 end, n desc, subcat) as place from (select doc_id, subcat, count(*) as n from results where p is null group by 1, 2)",
    "glued": f"with {SHORT}, {FRAGS} select doc_id, anchor_idx, member_idxs, length(text) as n_chars, md5(text) as text_md5 from frags",
    "glued_aggressive": f"with recursive {SHORT}, {AGGR}, {SCORED_FRAGS} select * from sf",
    "glue_stats": f"""with {SHORT}, {FRAGS}, {SCORED_FRAGS}, mem as (select doc_id, label, unnest(member_idxs) as idx from sf), ch as (select m.doc_id, m.label, sum(length(r.text)) as c from mem m join results r on r.doc_id = m.doc_id and r.idx = m.idx group by 1, 2), tot as (select doc_id, sum(length(text)) as t from results group by 1), cnt as (select doc_id, label, count(*) as n from sf group by 1, 2)
select doc_id, label, n as fragments, c::bigint as member_chars, round(c / t, 6) as share from cnt join ch using (doc_id, label) join tot using (doc_id)""",
    "document_map": f"with {SHORT} select s.doc_id, s.idx, length(s.text) as n_chars, s.kind, s.drop_reason, r.p, coalesce(r.label, case when s.kind = 'content' then 'insufficient' end) as label from sections s left join results r using (doc_id, idx)",
    "map_glued": f"""with {SHORT}, {FRAGS}, {SCORED_FRAGS}, hid as (select doc_id, unnest(member_idxs) as idx from frags)
select doc_id, idx, length(text) as n_chars, label, false as is_glued from results where not exists (select 1 from hid where hid.doc_id = results.doc_id and hid.idx = results.idx) union all select doc_id, anchor_idx, n_chars, label, true from sf""",
    "direct_scores": f"with {LINED}, long as (select * from paras where length(text) >= 120), sc as ({features.sql_features('long')}) select doc_id, count(*) as n, round(avg((p_a >= {THRESHOLD})::int), 6) as share, round(quantile_cont(p_a, 0.5), 6) as median_p from sc group by 1",
    "flagged_listing": f"""with {SHORT}, sec as (select *, case when p is null then 'short:' || {sql_category('text')} else label end as section from results), pl as (select *, row_number() over (partition by doc_id, section order by p desc nulls last, idx) as place from sec)
select doc_id, section, place, idx, p, {PREVIEW} as preview from pl where place <= case when section = 'human' then 5 when starts_with(section, 'short:') then 8 else 1000000 end""",
    "agreement": f"""with {TWO_SCORES}, j as (select ra.doc_id, ra.idx, ra.p as p_a, rb.p as p_b from ra left join rb using (doc_id, idx)), k as (select *, round(abs(p_a - p_b), 6) as gap from j)
select doc_id, idx, p_a, p_b, case when p_a is null or p_b is null then 'insufficient' when p_a >= 0.6 and p_b >= 0.72 then 'both_ai' when p_a < 0.6 and p_b < 0.72 then 'both_human' else 'disagree' end as agreement, gap, row_number() over (partition by doc_id order by gap desc nulls last, idx) as place from k""",
    "quick_agreement": f"with {LINED}, {CONTENT_ALL}, {WINS}, {sql_scored(('a', 'b'))}, t as (select * from scored where n_wins >= 3 and exists (select 1 from (select unnest(range(least(n_wins, 30))) as i) where (i * n_wins) // least(n_wins, 30) = win_no)) select doc_id, count(*) as n, round(avg((p_b >= {THRESHOLD} and p_a < 0.45)::int), 6) as divergence from t group by 1",
    "text_features": f"select doc_id, n_chars, n_words, round(burst, 6) as burst, round(mean_len, 6) as mean_len, round(mattr, 6) as mattr, round(phrase, 6) as phrase, round(punct, 6) as punct from ({features.sql_features('documents')})",
    "report_markdown": f"with {SHORT}, {FRAGS}, {SCORED_FRAGS}, {REPORTED}, {reports.SQL_MARKDOWN}",
    "report_html": f"with {SHORT}, {FRAGS}, {SCORED_FRAGS}, {REPORTED}, {reports.SQL_HTML}",
    "block_scan": f"with docs as (select doc_id, regexp_replace(text, '{BREAK}', '\\1' || chr(10), 'g') as text from documents), {sql_paras('docs', 'chr(10)')}, {SECTIONS}, {CONTENT_KEPT}, {SPANS}, {WINS}, {sql_scored()}, {sql_projected('p_a', 'r0')}, rs as (select *, case when p is null then case idx % 5 when 0 then 'heading' when 1 then 'caption' when 2 then 'formula' else {sql_short('text')} end end as subcat from r0) select doc_id, subcat, count(*) as n, sum(length(text))::bigint as chars from rs group by 1, 2",
}
ORACLES["agreement_counts"] = f"""select doc_id, count(*) filter (where agreement = 'both_ai') as both_ai, count(*) filter (where agreement = 'both_human') as both_human, count(*) filter (where agreement = 'disagree') as disagree, count(*) filter (where agreement = 'insufficient') as insufficient,
round(count(*) filter (where agreement = 'disagree') / nullif(count(*) filter (where agreement <> 'insufficient'), 0), 6) as disagreement from ({ORACLES['agreement']}) group by 1"""
