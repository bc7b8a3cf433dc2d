"""Queries that prepare a corpus, with their DuckDB equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..sources import readers
from ..sources.folders import scratch

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir):
    """Labelled documents: label 1 - quality, the source as generator."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", (1 - F.col("quality")).cast("int").alias("label"), "source", F.col("source").alias("generator"))


K = "c as (select doc_id, text, (1 - quality)::int as label, source, source as generator from documents join labels using (doc_id))"
OUT = "doc_id, label, source"


def slim(df, *more):
    return df.select("doc_id", "label", "source", *more)


def rank(seed: str, by: str = "", source: str = "c") -> str:
    part = f"partition by {by} " if by else ""
    return f"(select *, row_number() over ({part}order by md5('{seed}:' || text), doc_id) as rank from {source})"


SQ = r"regexp_replace({}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z', '', 'g')"
FLAT = r"trim(regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
W = r"[\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_]*"


@query(f"select doc_id, {SQ.format('text')} as text_, label, case when source <> 'src1' then source when label = 0 then 'human' else 'unknown' end as generator from (with {K} select * from c) where {SQ.format('text')} <> ''".replace("text_", "text"))
def load_paired(spark, sf_dir):
    df = corpus(spark, sf_dir).select("doc_id", "text", "label", F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("authorship"))
    return C.load_paired(df)


@query("select doc_id, case when contains(lower(source || case when doc_id % 3 = 0 then '-Human' else '' end), 'human') then 0 else 1 end as label from documents")
def label_from_source(spark, sf_dir):
    source = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "-Human").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", C.label_from_source(source).alias("label"))


@query("""with w as (select a.doc_id, a.text as human_text, b.text as a_text, c.text as b_text from documents a left join documents b on b.doc_id = a.doc_id + 1 left join documents c on c.doc_id = a.doc_id + 2)
select doc_id, md5(human_text) as m, 0 as label, 'human' as generator from w where human_text is not null union all select doc_id, md5(a_text), 1, 'a' from w where a_text is not null union all select doc_id, md5(b_text), 1, 'b' from w where b_text is not null""")
def unpivot_text_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    shifted = lambda k, name: docs.select((F.col("doc_id") - k).alias("doc_id"), F.col("text").alias(name))
    wide = docs.select("doc_id", F.col("text").alias("human_text")).join(shifted(1, "a_text"), "doc_id", "left").join(shifted(2, "b_text"), "doc_id", "left")
    return C.unpivot_text_columns(wide, ["doc_id"]).select("doc_id", F.md5("text").alias("m"), "label", "generator")


@query(f"select doc_id, coalesce(nullif({SQ.format('o')}, ''), nullif({SQ.format('i')}, '')) as text, 1 as label from (select doc_id, case when doc_id % 4 = 0 then '  ' else text end as o, 'about ' || source as i from documents)")
def load_instruct(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return C.load_instruct(docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text")).alias("output"), F.concat(F.lit("about "), "source").alias("instruction")))


@query(f"with r as (select conv_id, turn, {SQ.format('text')} as text from conversations where role = 'assistant') select conv_id, turn, text from r where length(text) between 200 and 3000 qualify row_number() over (partition by text order by conv_id, turn) = 1")
def load_chat_replies(spark, sf_dir):
    return C.load_chat_replies(read(spark, sf_dir, "conversations"), "assistant", 200, 3000)


@query("select 'documents' as origin, count(*) as n from documents union all select 'benchmark', count(*) from benchmark")
def source_counts(spark, sf_dir):
    union, failed = C.load_sources({"documents": lambda: read(spark, sf_dir, "documents").select("text"), "benchmark": lambda: read(spark, sf_dir, "benchmark").select("text"), "missing": lambda: read(spark, sf_dir, "no_such_table").select("text")})
    assert list(failed) == ["missing"]
    return union.groupBy("origin").agg(F.count("*").alias("n"))


B = readers.BLOCK_TAGS


def _blocks() -> str:
    h = r"regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    h = rf"string_split(regexp_replace({h}, '(?is)<table[^>]*>(.*?)</table>', chr(3) || '\1' || chr(3), 'g'), chr(3))"
    cells = r"len(list_filter(regexp_extract_all(x, '(?is)<t[dh](?: [^>]*)?>(.*?)</t[dh]>', 1), lambda c: " + SQ.format("regexp_replace(c, '<[^>]*>', '', 'g')") + " <> ''))"
    h = f"array_to_string(list_transform({h}, lambda x, i: case when i % 2 = 0 then chr(1) || 'table' || chr(2) || '⟦таблица: ' || {cells} || ' ячеек⟧' || chr(1) else x end), '')"
    h = rf"regexp_replace({h}, '(?i)<({B})( [^>]*)?/?>', chr(1) || '\1' || chr(2), 'g')"
    h = f"string_split(regexp_replace({h}, '(?i)</({B})>', chr(1), 'g'), chr(1))"
    body = r"regexp_replace(regexp_replace(raw, '^[A-Za-z0-9]+\x02', ''), '(?s)<[^>]*>', '', 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        body = f"replace({body}, '{name}', '{mark}')"
    body = SQ.format(rf"regexp_replace({body}, '[ \t\n\r\f\x0B]+', ' ', 'g')")
    return rf"""p as (select page_id, unnest({h}) as raw, unnest(range(len({h}))) as pos from pages),
q as (select page_id, pos, lower(regexp_extract(raw, '^([A-Za-z0-9]+)\x02', 1)) as style, {body} as text, contains(lower(raw), '<math') as has_math from p),
blocks as (select page_id, (row_number() over (partition by page_id order by pos) - 1)::int as idx, text, style, regexp_matches(style, '^h[1-6]$') as is_heading, style in ('caption', 'figcaption') as is_caption, has_math, style = 'table' as is_table from q where text <> '')"""


#: Each second page with a table after its own blocks: a row of four cells, one of them empty.
ROWS = ("<table class=x><thead><tr><th>n</th><td>", "</td><td> </td><td><b>y</b></td></tr></thead></table><p>after</p>")
TABLED = f"tabled as (select page_id, case when page_id % 2 = 0 then html || '{ROWS[0]}' || page_id || '{ROWS[1]}' else html end as html from pages)"


@query(f"with {TABLED}, {_blocks().replace('from pages', 'from tabled')} select * from blocks")
def extract_blocks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return readers.extract_blocks(pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit(ROWS[0]), F.col("page_id").cast("string"), F.lit(ROWS[1]))).otherwise(F.col("html"))))


@query("select text, coalesce(nullif(source, 'src1'), 'model') as generator, 'file' as source, 1 as label from documents where trim(text) <> ''")
def load_generated(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return C.load_generated(docs.select("text", F.when(F.col("source") != "src1", F.col("source")).alias("generator")), "model", "file")


@query(f"with {_blocks()}, s as (select page_id, sum(length(text))::bigint as chars from blocks group by 1), i as (select page_id, len(regexp_extract_all(lower(html), '<img'))::int as n_img from pages) select page_id, n_img, coalesce(chars, 0) as chars, case when coalesce(chars, 0) < 100 and n_img > 0 then 'scan' when coalesce(chars, 0) = 0 then 'no text' end as warning from i left join s using (page_id)")
def scan_warnings(spark, sf_dir):
    return readers.scan_warnings(read(spark, sf_dir, "pages"))


@query("select page_id as doc, page_id % 3 as page, row_number() over (partition by page_id, page_id % 3 order by round(y, 1), x) as place, x from (select page_id, unnest([3.0, 1.0, 2.0]) as x, unnest([length(html) % 7 / 4.0, 0.5, 0.52])::double as y from pages)")
def order_blocks(spark, sf_dir):
    spots = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), y.cast("double").alias("y")) for x, y in ((3.0, F.length("html") % 7 / 4.0), (1.0, F.lit(0.5)), (2.0, F.lit(0.52)))])).alias("s")
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), (F.col("page_id") % 3).alias("page"), F.lit("text").alias("type"), spots).select("doc", "page", "type", "s.x", "s.y")
    return readers.order_blocks(rows).select("doc", "page", "place", "x")


@query(rf"""select doc_id, len(regexp_extract_all(text, '{W}')) as n_words, {FLAT.format('text')} = text as is_flat, md5({SQ.format(r"regexp_replace(text, '[ \t]*\n[ \t]*', ' ', 'g')")}) as para_md5,
case when length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 then round(length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 6) else 0.0 end as latin,
length(text) between 30 and 199 as is_short, case when length({FLAT.format('text')}) > 40 then substr({FLAT.format('text')}, 1, 40) || '…' else {FLAT.format('text')} end as preview from documents""")
def text_scalars(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("n_words"), (T.flat(t) == t).alias("is_flat"), F.md5(T.clean_para(t)).alias("para_md5"), F.round(T.script_ratio(t, r"\p{IsLatin}"), 6).alias("latin"), F.length(t).between(30, 199).alias("is_short"), T.preview(t, 40).alias("preview"))


def _cut(text: str, n: str) -> str:
    return f"(case when len(regexp_extract_all({text}, '{W}')) <= {n} then {text} else substr({text}, 1, (list_sum(list_transform(string_split_regex({text}, '{W}')[1:{n}], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all({text}, '{W}')[1:{n}], lambda x: length(x))))::bigint) end)"


@query(f"select doc_id, n, md5({_cut('text', 'n')}) as m from documents, (select unnest([20, 40, 75]) as n)")
def truncate_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("n", F.explode(F.array(F.lit(20), F.lit(40), F.lit(75)))).select("doc_id", "n", F.md5(T.truncate_words(F.col("text"), F.col("n"))).alias("m"))


def _clean_sql() -> str:
    raw = "'<think>plan' || chr(10) || '</Think></think>Sure, here it is: > _**' || text || '**_'"
    t = SQ.format(f"regexp_replace(regexp_replace(regexp_replace({raw}, '(?is)<think>.*?</think>', '', 'g'), '{T.THINK}', '', 'g'), '{T.MARKUP}', '', 'g')")
    for _ in range(2):
        t = SQ.format(f"regexp_replace({t}, '{T.PREAMBLE.replace(chr(39), chr(39) * 2)}', '', 'g')")
    return f"trim({FLAT.format(t)}, '\"«»“” ')"


@query(rf"""with t as (select doc_id, {_clean_sql()} as text from documents) select doc_id, md5(text) as m, length(text) >= 200 and len(regexp_extract_all(text, '{W}')) >= 30 and not regexp_matches(text, '{T.THINK}') and not regexp_matches(text, '{T.REFUSAL.replace(chr(39), chr(39) * 2)}')
and (case when length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 then length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) else 0 end) >= 0.5 as valid from t""")
def clean_generated(spark, sf_dir):
    raw = F.concat(F.lit("<think>plan\n</Think></think>Sure, here it is: > _**"), "text", F.lit("**_"))
    rows = read(spark, sf_dir, "documents").select("doc_id", T.clean_generated(raw).alias("text"))
    return rows.select("doc_id", F.md5("text").alias("m"), T.is_valid_generated(F.col("text"), 200, 30, r"\p{IsLatin}").alias("valid"))


@query(f"with {K} select {OUT} from c qualify row_number() over (partition by text order by doc_id) = 1")
def dedup_exact(spark, sf_dir):
    return slim(C.dedup_exact(corpus(spark, sf_dir)))


@query(f"with {K} select {OUT} from {rank('cap', 'source, label')} where label = 0 or rank <= 3")
def cap_per_source(spark, sf_dir):
    return slim(C.cap_per_source(corpus(spark, sf_dir), 3))


@query(f"with {K} select {OUT} from {rank('balance', 'label')} where rank <= (select least(count(*) filter (where label = 0), count(*) filter (where label = 1)) from c)")
def balance(spark, sf_dir):
    return slim(C.balance(corpus(spark, sf_dir)))


@query(f"with {K} select {OUT}, case when rank <= floor(n * 0.1::double) then 'test' when rank <= floor(n * 0.1::double) + floor(n * 0.1::double) then 'val' else 'train' end as part from {rank('split')}, (select count(*) as n from c)")
def split_parts(spark, sf_dir):
    return slim(C.split(corpus(spark, sf_dir)), "part")


@query(f"with {K}, n as (select label, count(*) as n from c group by 1) select {OUT}, case when rank <= round(n * 0.8::double) then 'train' else 'test' end as part from {rank('strat', 'label')} join n using (label)")
def split_stratified(spark, sf_dir):
    return slim(C.split_by(corpus(spark, sf_dir), "label", 0.8, "strat", ("train", "test")), "part")


@query(f"with {K}, n as (select generator, count(*) as n from c group by 1) select {OUT}, case when rank <= round(n * 0.7::double) then 'train' else 'holdout' end as part from {rank('gen', 'generator')} join n using (generator)")
def split_per_generator(spark, sf_dir):
    return slim(C.split_by(corpus(spark, sf_dir), "generator", 0.7, "gen"), "part")


@query(f"with {K}, n as (select generator, count(*) as n from c group by 1), k as (select * from {rank('thin', 'generator')} join n using (generator) where rank <= greatest(round(100 * n / (select count(*) from c)), 1)) select {OUT} from {rank('thin', '', '(select * exclude (rank) from k)')} where rank <= 100")
def thin_proportional(spark, sf_dir):
    return slim(C.thin_proportional(corpus(spark, sf_dir), "generator", 100))


@query(f"with {K} select {OUT}, case when rank <= 20 then 'train' when rank <= 30 then 'val' else 'test' end as part from {rank('slice', 'label')} where rank <= 45")
def slice_parts(spark, sf_dir):
    return slim(C.slice_parts(corpus(spark, sf_dir), {"train": 20, "val": 10, "test": 15}), "part")


@query(f"""with {K}, base as (select * from c where doc_id % 3 = 0), addition as (select * from c where doc_id % 3 = 1), both_ as (select * from base union all select * from addition), fresh as (select * from c where doc_id % 3 = 2 and text not in (select text from both_)),
n as (select count(*) filter (where label = 0) as n0, count(*) filter (where label = 1) as n1 from both_) select {OUT} from both_ union all select {OUT} from {rank('deficit', 'label', 'fresh')}, n where rank <= case when label = 0 then n1 - n0 else n0 - n1 end""")
def augment_with_deficit(spark, sf_dir):
    c = corpus(spark, sf_dir)
    part = lambda k: c.where(F.col("doc_id") % 3 == k)
    return slim(C.augment_with_deficit(part(0), part(1), part(2)))


@query("select doc_id from documents where text not in (select text from documents where doc_id % 10 = 0) and text not in (select text from benchmark)")
def exclude_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return C.exclude_texts(docs, docs.where("doc_id % 10 = 0"), read(spark, sf_dir, "benchmark")).select("doc_id")


@query("select count(*) as n from (select text from documents where doc_id % 2 = 0 intersect select text from documents where doc_id % 2 = 1)")
def overlap_count(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return C.overlap_count(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


@query("select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 7")
def first_n(spark, sf_dir):
    return C.first_n(read(spark, sf_dir, "documents"), "source", 7).select("doc_id", "source")


@query(f"with {K}, x as (select doc_id, label, {_cut('text', 'k')} as text from c, (select unnest([75, 50, 40, 30, 20, 1000000]) as k) where k = 1000000 or k < len(regexp_extract_all(text, '{W}'))) select min(doc_id) as doc_id, label, md5(text) as m from x group by label, text")
def augment_truncations(spark, sf_dir):
    return C.augment_truncations(corpus(spark, sf_dir)).select("doc_id", "label", F.md5("text").alias("m"))


@query(f"""with {K}, p as (select doc_no, slot, case when substr('HAHAAHAA', slot + 1, 1) = 'A' then 1 else 0 end as label from (select unnest(range(12)) as doc_no), (select unnest(range(8)) as slot)),
s as (select *, doc_no * case when label = 0 then 3 else 5 end + row_number() over (partition by doc_no, label order by slot) as rank from p),
r as (select s.doc_no, s.slot, s.label, k.text from s join {rank('mix', 'label')} k on k.label = s.label and k.rank = s.rank)
select doc_no, md5('Title' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by slot) || chr(10) || chr(10) || 'References') as m, list(label order by slot) as truth from r group by 1 having count(*) = 8""")
def assemble_documents(spark, sf_dir):
    return C.assemble_documents(corpus(spark, sf_dir), "HAHAAHAA", 12, ["Title"], ["References"]).select("doc_no", F.md5("text").alias("m"), "truth")


@query(f"with {K} select doc_id, rank, [0.7::double, 0.9::double, 1.1::double][(rank % 3 + 1)::int] as temp, 'Continue: ' || {FLAT.format('substr(text, 1, 300)')} as prompt from {rank('pool', '', '(select * from c where label = 0 and length(text) >= 200)')} where rank between 11 and 60")
def seed_pool(spark, sf_dir):
    return C.seed_pool(corpus(spark, sf_dir), 10, 50).select("doc_id", "rank", "temp", "prompt")


@query("with ca as (select distinct md5(text) as m from documents where doc_id % 2 = 0) select doc_id, md5(text) as text_md5, (length(text) % 1000) / 1000.0::double as p, md5(text) in (select m from ca) as cached from documents")
def score_incremental(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    score = lambda df: df.withColumn("p", F.length("text") % 1000 / F.lit(1000.0))
    cache = score(docs.where("doc_id % 2 = 0").select(F.md5("text").alias("text_md5"), "text")).groupBy("text_md5").agg(F.max("p").alias("p"))
    rows, _ = C.score_incremental(docs, cache, score)
    return rows.join(cache.select("text_md5", F.lit(True).alias("hit")), "text_md5", "left").select("doc_id", "text_md5", "p", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("""with f as (select text, doc_id, (length(text) % 1000) / 1000.0::double as p from documents), a as (select md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as m, max(p) as pa from f where doc_id % 3 <> 0 group by 1), b as (select md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as m, max(p / 2 + 0.25) as pb from f where doc_id % 3 <> 1 group by 1)
select count(abs(pa - pb)) as n, round(quantile_cont(abs(pa - pb), 0.5), 6) as median_gap, round(max(abs(pa - pb)), 6) as max_gap, count(*) filter (where pa >= 0.6 and not coalesce(pb >= 0.6, false)) as only_a, count(*) filter (where pb >= 0.6 and not coalesce(pa >= 0.6, false)) as only_b from a full join b using (m)""")
def compare_versions(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select("doc_id", "text", (F.length("text") % 1000 / F.lit(1000.0)).alias("p"))
    return C.compare_versions(f.where("doc_id % 3 <> 0"), f.where("doc_id % 3 <> 1").withColumn("p", F.col("p") / 2 + 0.25), 0.6)


@query(f"with {K}, a as (select avg(length(text)) filter (where label = 0) as h, avg(length(text)) filter (where label = 1) as m from c) select round(greatest(h, m) / greatest(1, least(h, m)), 6) as ratio, greatest(h, m) / greatest(1, least(h, m)) > 1.5 as leak from a")
def length_leak(spark, sf_dir):
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.length("text")))
    ratio = F.greatest("h", "m") / F.greatest(F.lit(1.0), F.least("h", "m"))
    return corpus(spark, sf_dir).agg(mean(0).alias("h"), mean(1).alias("m")).select(F.round(ratio, 6).alias("ratio"), (ratio > 1.5).alias("leak"))


@query(f"with {K} select label, source, count(*) as n, min(length(text)) as shortest, quantile_cont(length(text), 0.5)::double as median, max(length(text)) as longest from c group by grouping sets ((label), (source), (label, source), ())")
def composition(spark, sf_dir):
    n = F.length("text")
    c = corpus(spark, sf_dir)
    return c.groupingSets([["label"], ["source"], ["label", "source"], []], "label", "source").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("longest"))


_VERSIONS = """f as (select text, doc_id, (length(text) % 1000) / 1000.0::double as p from documents), a as (select trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, max(p) as pa from f where doc_id % 3 <> 0 group by 1), b as (select trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, max(p / 2 + 0.25) as pb from f where doc_id % 3 <> 1 group by 1),
v as (select md5(text) as m, text, pa, pb, round(abs(pa - pb), 6) as gap from a full join b using (text))"""


def _versions(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select("doc_id", "text", (F.length("text") % 1000 / F.lit(1000.0)).alias("p"))
    return f.where("doc_id % 3 <> 0"), f.where("doc_id % 3 <> 1").withColumn("p", F.col("p") / 2 + 0.25)


@query(f"with {_VERSIONS} select m, pa, pb, gap from v where gap is not null order by gap desc, m limit 5")
def version_gaps(spark, sf_dir):
    return C.version_gaps(*_versions(spark, sf_dir)).drop("text")


@query(f"with {_VERSIONS}, h as (select *, coalesce(pa >= 0.6, false) as ha, coalesce(pb >= 0.6, false) as hb from v) select case when ha then 'a' else 'b' end as side, m, case when ha then pa else pb end as p, case when ha then pb else pa end as other from h where ha <> hb")
def flagged_in_one(spark, sf_dir):
    return C.flagged_in_one(*_versions(spark, sf_dir), 0.6).drop("text")


@query(f"with {K}, b as (select *, case when length(text) < 1000 then 'A' else 'B' end as bucket from c) select label, generator, bucket, count(*) as n, round(avg(length(text)), 6) as mean_chars from b group by grouping sets ((label, generator), (bucket, generator), (bucket), ())")
def composition_by_generator(spark, sf_dir):
    """Rows of each label and bucket by generator."""
    rows = corpus(spark, sf_dir).withColumn("bucket", F.when(F.length("text") < 1000, "A").otherwise("B"))
    sets = [["label", "generator"], ["bucket", "generator"], ["bucket"], []]
    return rows.groupingSets(sets, "label", "generator", "bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


BUCKETS = ((30, 199), (50, 199), (200, 3000), (200, None))


@query(f"with {K} " + " union all ".join(f"select {low} as low, {high or 'null::int'} as high, doc_id, label from c where length(text) >= {low}" + (f" and length(text) <= {high}" if high else "") for low, high in BUCKETS))
def length_buckets(spark, sf_dir):
    """Documents of each range of lengths."""
    rows = corpus(spark, sf_dir)
    found = [C.filter_len(rows, low, high).select(F.lit(low).alias("low"), F.lit(high).cast("int").alias("high"), "doc_id", "label") for low, high in BUCKETS]
    return reduce(DataFrame.unionByName, found)


@query("select md5(text) as m, case when lang = 'en' then 0 else 1 end as label, 'table:' || source as source, coalesce(lang, 'unknown') as generator from documents")
def normalised(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = C.normalise(docs, "text", F.when(F.col("lang") == "en", 0).otherwise(1), F.concat(F.lit("table:"), "source"), F.coalesce("lang", F.lit("unknown")))
    return rows.select(F.md5("text").alias("m"), "label", "source", "generator")


@query(f"with {K}, u as (select * from c qualify row_number() over (partition by text order by doc_id) = 1), p as (select md5(text) as m, case when rank <= round(n * 0.7) then 'train' else 'holdout' end as part from (select *, count(*) over (partition by generator) as n from {rank('gen', 'generator', 'u')})) select 'holdout' as \"left\", 'train' as \"right\", (select count(*) from (select m from p where part = 'train' intersect select m from p where part = 'holdout')) as n")
def split_is_disjoint(spark, sf_dir):
    """Texts that both parts of a split by generator hold, once exact copies are gone."""
    return C.parts_overlap(C.split_by(C.dedup_exact(corpus(spark, sf_dir)), "generator", 0.7, "gen"))


@query("select doc_id, md5(text) as m, 1 as label, source from documents where doc_id % 7 <> 3")
def json_lines(spark, sf_dir):
    """Lines of which each seventh is cut off in the middle: what is no JSON object is counted and left out."""
    docs = read(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "text", F.lit(1).alias("label"), "source"))
    path = scratch(spark, "lines")
    docs.select(F.when(F.col("doc_id") % 7 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return readers.read_corpus(spark, path, "doc_id long, text string, label int, source string").select("doc_id", F.md5("text").alias("m"), "label", "source")
