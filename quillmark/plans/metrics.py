"""Queries of metrics, genre, language-model features and edits, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features, prefix
from ..functions import text as T
from ..operators import genre, lm, metrics, segments
from . import corpus as C
from . import documents as D

QUERIES, ORACLES = {}, {}
THR = 0.55


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scores(spark, sf_dir):
    """Labelled documents in long form: doc_id, label, source, n_words, n_chars, scorer (a, b, ensemble), p."""
    rows = features.with_scores(C.corpus(spark, sf_dir), "text", ("a", "b"))
    both = F.array(F.struct(F.lit("a").alias("scorer"), F.round("p_a", 6).alias("p")), F.struct(F.lit("b").alias("scorer"), F.round("p_b", 6).alias("p")), F.struct(F.lit("ensemble").alias("scorer"), F.round(T.ensemble(F.col("p_a"), F.col("p_b"), F.col("n_chars")), 6).alias("p")))
    return rows.select("doc_id", "label", "source", "n_words", "n_chars", F.explode(both).alias("s")).select("doc_id", "label", "source", "n_words", "n_chars", "s.scorer", "s.p")


def one(spark, sf_dir):
    return scores(spark, sf_dir).where("scorer = 'a'")


Q = f"""{C.K}, f as ({features.sql_features('c', 'text', ('a', 'b'))}), sc as (select doc_id, label, source, n_words, n_chars, 'a' as scorer, round(p_a, 6) as p from f union all select doc_id, label, source, n_words, n_chars, 'b', round(p_b, 6) from f
union all select doc_id, label, source, n_words, n_chars, 'ensemble', round(case when n_chars < 200 then p_b else (p_a + p_b) / 2 end, 6) from f), s as (select * from sc where scorer = 'a')"""
AVG = "round(avg((p >= {0})::int) filter (where label = {1}), 6)"


@query(f"with {Q} select scorer, count(*) as n, {AVG.format(THR, 0)} as fpr, {AVG.format(THR, 1)} as recall from sc group by 1")
def compare_scorers(spark, sf_dir):
    return metrics.fpr_recall_at(scores(spark, sf_dir), THR, ("scorer",))


@query(f"with {Q}, r as (select scorer, label, rank() over (partition by scorer order by p) + (count(*) over (partition by scorer, p) - 1) / 2.0::double as r from sc) select scorer, round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0::double) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)), 6) as auc from r group by 1")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scores(spark, sf_dir), ("scorer",))


@query(f"""with {Q}, c2 as (select count(*) filter (where p >= {THR} and label = 1) as tp, count(*) filter (where p >= {THR} and label = 0) as fp, count(*) filter (where p < {THR} and label = 1) as fn, count(*) filter (where p < {THR} and label = 0) as tn from s)
select *, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(fp / nullif(fp + tn, 0), 6) as fpr, round(tp / nullif(tp + fp, 0), 6) as precision1, round(tp / nullif(tp + fn, 0), 6) as recall1, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1_1, round(tn / nullif(tn + fn, 0), 6) as precision0, round(tn / nullif(tn + fp, 0), 6) as recall0, round(2 * tn / nullif(2 * tn + fp + fn, 0), 6) as f1_0 from c2""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(one(spark, sf_dir), THR)


@query(f"with {Q} select threshold, {AVG.format('threshold', 0)} as fpr, {AVG.format('threshold', 1)} as recall from s, (select unnest([0.4, 0.5, 0.55, 0.6, 0.9])::double as threshold) group by 1")
def threshold_table(spark, sf_dir):
    return metrics.threshold_table(one(spark, sf_dir), (0.4, 0.5, 0.55, 0.6, 0.9))


@query(f"with {Q}, g as (select round(0.05::double + 0.005::double * unnest(range(189)), 3) as t), x as (select scorer, t, avg((p >= t)::int) filter (where label = 0) as fpr from sc, g group by 1, 2) select scorer, coalesce(min(t) filter (where fpr <= 0.03), max(t)) as threshold from x group by 1")
def pick_threshold(spark, sf_dir):
    return metrics.pick_threshold(scores(spark, sf_dir), 0.03, keys=("scorer",))


@query(f"with {Q} select scorer, round(quantile_cont(p, 0.975), 6) as threshold from sc where label = 0 group by 1")
def quantile_threshold(spark, sf_dir):
    return metrics.quantile_threshold(scores(spark, sf_dir), 0.975, ("scorer",))


@query(f"with {Q}, e as (select [quantile_cont(p, 0.2), quantile_cont(p, 0.4), quantile_cont(p, 0.6), quantile_cont(p, 0.8)] as e from s) select len(list_filter(e, lambda x: x < p))::int as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(label), 6) as observed from s, e group by 1")
def calibration_curve(spark, sf_dir):
    return metrics.calibration_curve(one(spark, sf_dir))


@query(f"with {Q}, h as (select least(floor(p * 20), 19) as bin, count(*) filter (where label = 0) as a, count(*) filter (where label = 1) as b from s group by 1) select round(sum(least(a / (select sum(a) from h), b / (select sum(b) from h))), 6) as overlap from h")
def overlap_coeff(spark, sf_dir):
    return metrics.overlap_coeff(one(spark, sf_dir))


LENGTHS = (300, 150, 100, 75, 50, 40, 30, 20)


def swept(spark, sf_dir, scorers=("a",)):
    """Scores of every labelled text cut to each of `LENGTHS` words: doc_id, label, source, n, n_words, scorer, p."""
    rows = prefix.with_prefixes(C.corpus(spark, sf_dir).select("doc_id", "label", "source", "text"), LENGTHS)
    each = F.array(*[F.struct(F.lit(name).alias("scorer"), F.round(features.linear(name), 6).alias("p")) for name in scorers])
    return rows.select("doc_id", "label", "source", "n", "n_words", F.explode(each).alias("_s")).select("doc_id", "label", "source", "n", "n_words", "_s.scorer", "_s.p")


def part():
    """validation or test, by a digest's half."""
    return F.when(F.md5(F.col("doc_id").cast("string")) < "8", "validation").otherwise("test")


def sweep_counts(spark, sf_dir, scorers=("a", "b")):
    """Counts (scorer, n, part, source, p, n0, n1) at each length and, as n = 0, of whole texts; the part is a digest's half."""
    whole = scores(spark, sf_dir).where(F.col("scorer").isin(*scorers)).select("doc_id", "label", "source", F.lit(0).alias("n"), "scorer", "p")
    rows = swept(spark, sf_dir, scorers).select(*whole.columns).unionByName(whole).withColumn("part", part())
    return metrics.score_counts(rows, ("scorer", "n", "part", "source"))


SWEPT = f"{C.K}, x as (select doc_id, label, n, {C._cut('text', 'n')} as text from c, (select unnest([300, 150, 100, 75, 50, 40, 30, 20]) as n)), sw as (select doc_id, label, n, n_words, round(p_a, 6) as p from ({features.sql_features('x')}))"
#: Both scorers, with whole texts as n = 0, and halves by digest.
SWEPT_ALL = f"""{C.K}, x as (select doc_id, label, source, n, {C._cut('text', 'n')} as text from c, (select unnest([300, 150, 100, 75, 50, 40, 30, 20]) as n) union all select doc_id, label, source, 0, text from c),
xf as (select *, case when md5(doc_id::varchar) < '8' then 'validation' else 'test' end as part from ({features.sql_features('x', 'text', ('a', 'b'))})),
sw as (select 'a' as scorer, n, part, source, label, n_words, round(p_a, 6) as p from xf union all select 'b', n, part, source, label, n_words, round(p_b, 6) from xf)"""
_AUC = "round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0::double) / nullif(count(*) filter (where label = 1) * count(*) filter (where label = 0), 0), 6)"
_RANK = "rank() over (partition by scorer, n order by p) + (count(*) over (partition by scorer, n, p) - 1) / 2.0::double as r"
FIRST = "src2"
REPORT = f"""{SWEPT_ALL}, th as (select scorer, n, round(quantile_cont(p, 0.975), 6) as threshold from sw where label = 0 and part = 'validation' group by 1, 2), te as (select * from sw where part = 'test'),
a1 as (select scorer, n, {_AUC} as auc from (select *, {_RANK} from te) group by 1, 2), a2 as (select scorer, n, {_AUC} as auc_first from (select *, {_RANK} from te where label = 0 or source = '{FIRST}') group by 1, 2),
rep as (select scorer, n, threshold, round(avg((p >= threshold)::int) filter (where label = 1), 6) as recall, round(avg((p >= threshold)::int) filter (where label = 1 and source = '{FIRST}'), 6) as recall_first, round(avg((p >= threshold)::int) filter (where label = 0), 6) as fpr from te join th using (scorer, n) group by 1, 2, 3),
report as (select * from rep left join a1 using (scorer, n) left join a2 using (scorer, n))"""


@query(f"""with {SWEPT}, r as (select n, label, rank() over (partition by n order by p) + (count(*) over (partition by n, p) - 1) / 2.0::double as r from sw), au as (select n, round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0::double) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)), 6) as auc from r group by 1)
select n, any_value(auc) as auc, {AVG.format(THR, 0)} as fpr, {AVG.format(THR, 1)} as recall, quantile_cont(n_words, 0.5)::double as median_words, round(quantile_cont(p, 0.5), 6) as median_p from sw join au using (n) group by 1""")
def length_sweep(spark, sf_dir):
    """Everything follows from one reduction: counts of scores and of words by length."""
    each = F.array(F.struct(F.lit("p").alias("kind"), F.col("p").alias("v")), F.struct(F.lit("words").alias("kind"), F.col("n_words").cast("double").alias("v")))
    rows = swept(spark, sf_dir).select("label", "n", F.explode(each).alias("_m")).select("label", "n", "_m.kind", "_m.v")
    by = metrics.score_counts(rows, ("n", "kind"), "v")
    p = F.col("kind") == "p"
    share = lambda c: F.round(F.sum(F.when(p & (F.col("v") >= THR), F.col(c)).otherwise(0)) / F.nullif(F.sum(F.when(p, F.col(c))), F.lit(0)), 6)
    rates = by.groupBy("n").agg(share("n0").alias("fpr"), share("n1").alias("recall"))
    medians = metrics.quantiles(by, (0.5,), ("n", "kind"), "v")
    medians = medians.groupBy("n").agg(F.max(F.when(~p, F.col("v"))).alias("median_words"), F.round(F.max(F.when(p, F.col("v"))), 6).alias("median_p"))
    auc = metrics.auc_of_counts(by, ("n", "kind"), "v").where(p).select("n", "auc")
    return auc.join(rates, "n").join(medians, "n")


@query(f"with {REPORT} select * from report")
def sweep_by_scorer(spark, sf_dir):
    return metrics.sweep_report(sweep_counts(spark, sf_dir), first=FIRST)


@query(f"""with {SWEPT_ALL}, t as (select n, round(quantile_cont(p, 0.975), 6) as own from sw where scorer = 'a' and n > 0 and label = 0 and part = 'validation' group by 1), g as (select round(quantile_cont(p, 0.975), 6) as flat from sw where scorer = 'a' and n = 0 and label = 0 and part = 'validation'),
j as (select n, any_value(own) as own, any_value(flat) as flat, round(avg((p >= own)::int) filter (where label = 1), 6) as recall_own, round(avg((p >= flat)::int) filter (where label = 1), 6) as recall_flat, round(avg((p >= own)::int) filter (where label = 0), 6) as fpr_own, round(avg((p >= flat)::int) filter (where label = 0), 6) as fpr_flat from (select * from sw where scorer = 'a' and part = 'test') join t using (n), g group by 1)
select *, round(recall_own - recall_flat, 6) as gain from j""")
def length_aware_gain(spark, sf_dir):
    """Thresholds of each length, and one of whole texts, from the validation half; what they do on the test half."""
    return metrics.length_aware_gain(sweep_counts(spark, sf_dir, ("a",)))


#: Recalls that hold-out sources must reach, and the source of which no text may be flagged.
FLOORS, CLEAN = (("src2", 0.70), ("src5", 0.78), ("src10", 0.50), ("src19", 0.50)), "src0"
_floor = " union all ".join(f"select 'recall {s}', round(avg((p >= {THR})::int) filter (where label = 1 and source = '{s}'), 6), '>=', {b}::double from w" for s, b in FLOORS)


@query(f"""with {REPORT}, pk as (select max(recall) filter (where scorer = 'b' and n = 40) - max(recall) filter (where scorer = 'a' and n = 40) as g, max(fpr) filter (where scorer = 'b' and n > 0) as f, max(fpr) filter (where scorer = 'b' and n = 0) - max(fpr) filter (where scorer = 'a' and n = 0) as w from report),
k as (select round(g, 6) as g, round(f, 6) as f, round(w, 6) as w, coalesce(round(g, 6) >= 0.1, false) as g1, coalesce(round(g, 6) >= 0.05, false) as g2, coalesce(round(f, 6) <= 0.03, false) as f1, coalesce(round(w, 6) <= 0.005, false) as w1 from pk), v as (select case when g1 and f1 and w1 then 'accepted' when g2 and f1 then 'partial' else 'rejected' end as verdict from k),
gr as (select 'gain' as rules, 'gain at 40' as name, g as value, '>=' as op, 0.1::double as bound, g1 as passed, verdict from k, v union all select 'gain', 'largest fpr', f, '<=', 0.03::double, f1, verdict from k, v union all select 'gain', 'fpr of whole texts, change', w, '<=', 0.005::double, w1, verdict from k, v),
w as (select * from sw where scorer = 'b' and n = 0 and part = 'test'), fl as (select 'fpr' as name, round(avg((p >= case when n_words < 40 then 0.6 else {THR} end)::int) filter (where label = 0), 6) as value, '<=' as op, 0.03::double as bound from w union all {_floor} union all select 'flagged of {CLEAN}', (count(*) filter (where label = 0 and source = '{CLEAN}' and p >= {THR}))::double, '<=', 0.0::double from w),
fo as (select *, coalesce(case when op = '>=' then value >= bound else value <= bound end, false) as passed from fl) select * from gr union all select 'floors', name, value, op, bound, passed, case when (select bool_and(passed) from fo) then 'accepted' else 'rejected' end from fo""")
def acceptance_sweep(spark, sf_dir):
    """Whether scorer b may take the place of scorer a, by what it gains at short lengths, and by floors on whole texts."""
    gain = metrics.sweep_acceptance(metrics.sweep_report(sweep_counts(spark, sf_dir), first=FIRST), "a", "b")
    whole = scores(spark, sf_dir).where("scorer = 'b'").withColumn("part", part()).where("part = 'test'")
    thr = T.threshold_for(F.col("n_words"), F.lit(THR), F.lit(0.6), F.lit(40))
    p, label, source = F.col("p"), F.col("label"), F.col("source")
    rules = [("fpr", metrics.rate(p >= thr, label == 0), "<=", 0.03)]
    rules += [(f"recall {s}", metrics.rate(p >= THR, (label == 1) & (source == s)), ">=", floor) for s, floor in FLOORS]
    rules += [(f"flagged of {CLEAN}", F.count_if((label == 0) & (source == CLEAN) & (p >= THR)).cast("double"), "<=", 0.0)]
    found = whole.agg(F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value, _, _ in rules]).alias("m")).select(F.inline("m"))
    floors = metrics.acceptance(found, spark.createDataFrame([(name, op, bound) for name, _, op, bound in rules], "name string, op string, bound double"))
    floors = floors.withColumn("verdict", F.when(F.col("all_passed"), "accepted").otherwise("rejected"))
    columns = ("name", "value", "op", "bound", "passed", "verdict")
    return gain.select(F.lit("gain").alias("rules"), *columns).unionByName(floors.select(F.lit("floors").alias("rules"), *columns))


@query(f"with {SWEPT} select n, label, round(avg((p >= case when n_words < 40 then 0.6 else {THR} end)::int), 6) as aware, round(avg((p >= {THR})::int), 6) as flat from sw group by 1, 2")
def flag_rate(spark, sf_dir):
    thr = T.threshold_for(F.col("n_words"), F.lit(THR), F.lit(0.6), F.lit(40))
    return swept(spark, sf_dir).groupBy("n", "label").agg(F.round(F.avg((F.col("p") >= thr).cast("int")), 6).alias("aware"), F.round(F.avg((F.col("p") >= THR).cast("int")), 6).alias("flat"))


@query(f"with {SWEPT} select n, count(*) as total, count(*) filter (where p >= {THR}) as flagged, count(*) filter (where p >= {THR}) <= ceil(0.03 * count(*)) as within from sw where label = 0 group by 1")
def fpr_budget(spark, sf_dir):
    rows = swept(spark, sf_dir).withColumnRenamed("n", "words")
    return metrics.fpr_budget(rows, THR, ("words",)).select(F.col("words").alias("n"), F.col("n").alias("total"), "flagged", "within")


@query(f"with {Q} select source, case when n_chars < 1000 then 'A' else 'B' end as bucket, count(*) as n, round(avg((p >= {THR})::int), 6) as recall from s where label = 1 group by rollup (bucket, source)")
def recall_by(spark, sf_dir):
    rows = one(spark, sf_dir).withColumn("bucket", F.when(F.col("n_chars") < 1000, "A").otherwise("B"))
    return metrics.recall_by(rows, ("bucket", "source"), THR)


@query(f"with {Q} select label, count(*) as n, round(avg((p >= 0.5)::int), 6) as flagged, round(avg(p), 6) as mean_p from s where n_chars between 30 and 199 group by 1")
def evaluate_short(spark, sf_dir):
    rows = one(spark, sf_dir).where(F.col("n_chars").between(30, 199))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") >= 0.5).cast("int")), 6).alias("flagged"), F.round(F.avg("p"), 6).alias("mean_p"))


@query(f"with {Q}, m as (select 'fpr' as name, avg((p >= {THR})::int) filter (where label = 0) as value from s union all select 'recall', avg((p >= {THR})::int) filter (where label = 1) from s), r as (select * from (values ('fpr', '<=', 0.5::double), ('recall', '>=', 0.99::double)) as t(name, op, bound)), o as (select name, round(value, 6) as value, op, bound, coalesce(case when op = '>=' then value >= bound else value <= bound end, false) as passed from m join r using (name)) select *, (select bool_and(passed) from o) as all_passed from o")
def acceptance(spark, sf_dir):
    found = metrics.fpr_recall_at(one(spark, sf_dir), THR).select(F.explode(F.create_map(F.lit("fpr"), F.col("fpr"), F.lit("recall"), F.col("recall"))).alias("name", "value"))
    rules = spark.createDataFrame([("fpr", "<=", 0.5), ("recall", ">=", 0.99)], "name string, op string, bound double")
    return metrics.acceptance(found, rules)


@query(f"with f as ({features.sql_features('documents')}) select doc_id, round(p_a, 6) as p, case when n_words < 40 then 0.889::double else 0.834::double end as threshold, p_a >= case when n_words < 40 then 0.889 else 0.834 end as verdict, array_to_string(list_filter([case when n_chars < 200 then 'short text' end, case when n_words < 40 then 'stricter threshold' end], lambda x: x is not null), '; ') as notes from f")
def detect(spark, sf_dir):
    rows = features.with_scores(D.documents(spark, sf_dir))
    thr = T.threshold_for(F.col("n_words"), F.lit(0.834), F.lit(0.889), F.lit(40))
    return rows.select("doc_id", F.round("p_a", 6).alias("p"), thr.alias("threshold"), T.verdict(F.col("p_a"), thr).alias("verdict"), T.notes(F.col("n_chars"), F.col("n_words"), F.lit(40)).alias("notes"))


def _sample(spark, sf_dir):
    docs = D.documents(spark, sf_dir)
    mark = F.when(F.col("doc_id") % 3 == 0, "[12] ").when(F.col("doc_id") % 3 == 1, "[Author, 2020] ").otherwise("")
    paras = segments.split_paragraphs(docs.withColumn("text", F.concat(mark, "text")), "\n")
    return genre.genre_sample(paras)


_per = ", ".join(f"round(len(regexp_extract_all(sample, '(?i){rx}')) / greatest(n_words, 1) * 1000, 1) as {name}_per1k" for name, rx in genre.TERMS.items())
GENRE = f"""docs as (select doc_id, case doc_id % 3 when 0 then '[12] ' when 1 then '[Author, 2020] ' else '' end || text as text from documents), {D.sql_paras('docs', 'chr(10)')},
k as (select *, length(text) >= 40 and not starts_with(text, '⟦таблица') as ok from paras), k2 as (select *, bool_or(ok) over (partition by doc_id) as any_ok from k), k3 as (select *, coalesce(sum(length(text)) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as b from k2 where ok or not any_ok),
sm as (select doc_id, count(*) as n_paras, count(*) filter (where regexp_matches(text, '{genre.CITE}')) as n_cited, substr(string_agg(text, ' ' order by idx), 1, 5000) as sample from k3 where b < 5000 group by 1),
l as (select *, len(regexp_extract_all(sample, '{D.W}')) as n_words, list_transform(list_filter(string_split_regex(sample, '[.!?]+([ \\t\\n\\r\\f\\x0B]|\\z)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), lambda x: len(regexp_extract_all(x, '{D.W}'))) as lens from sm),
gf as (select doc_id, n_paras, n_words, round(coalesce(list_sum(lens)::double / nullif(len(lens), 0), 0.0), 1) as mean_sent_len, round(coalesce(case when len(lens) > 1 then sqrt(greatest(list_sum(list_transform(lens, lambda x: x * x))::double / len(lens) - (list_sum(lens)::double / len(lens)) * (list_sum(lens)::double / len(lens)), 0.0)) end, 0.0), 1) as sent_std,
round(n_cited / greatest(n_paras, 1), 3) as cite_frac, round(length(regexp_replace(sample, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(sample, '[^\\p{{L}}]', '', 'g')), 1), 3) as latin_frac, round(len(regexp_extract_all(sample, '{genre.MATH}')) / greatest(n_words, 1), 3) as mathcode_per_w, {_per} from l)"""


@query(f"with {GENRE} select * from gf")
def genre_features(spark, sf_dir):
    return genre.genre_features(_sample(spark, sf_dir))


@query(f"""with {GENRE}, sg as (select doc_id, tech_per1k + 800 * mathcode_per_w + 0.6::double * sci_per1k as tech, hum_per1k + 120 * cite_frac + 80 * latin_frac + greatest(0.0::double, mean_sent_len - 14) * 1.2::double as hum from gf), mx as (select *, greatest(tech, hum) < 8 or (least(tech, hum) > 8 and least(tech, hum) / greatest(tech, hum) > 0.75) as mixed from sg)
select doc_id, case when mixed then 'mixed' when tech >= hum then 'technical' else 'humanities' end as genre, case when mixed then 'agree' when tech >= hum then 'v4' else 'v3' end as recommended, not mixed as confident from mx""")
def genre_decision(spark, sf_dir):
    return genre.classify_genre(genre.genre_features(_sample(spark, sf_dir))).select("doc_id", "genre", "recommended", "confident")


@query(f"""with {GENRE}, sg as (select doc_id, tech_per1k + 800 * mathcode_per_w + 0.6::double * sci_per1k as tech, hum_per1k + 120 * cite_frac + 80 * latin_frac + greatest(0.0::double, mean_sent_len - 14) * 1.2::double as hum from gf), mx as (select *, greatest(tech, hum) < 8 or (least(tech, hum) > 8 and least(tech, hum) / greatest(tech, hum) > 0.75) as mixed from sg),
gd as (select doc_id, case when mixed then 'mixed' when tech >= hum then 'technical' else 'humanities' end as genre, case when mixed then 'agree' when tech >= hum then 'v4' else 'v3' end as rec from mx), qa as ({D.ORACLES['quick_agreement']})
select doc_id, genre, case when genre = 'technical' and coalesce(divergence, 0) > 0.15 then 'agree' else rec end as recommended, divergence from gd left join qa using (doc_id)""")
def recommended_scorer(spark, sf_dir):
    genres = genre.classify_genre(genre.genre_features(_sample(spark, sf_dir)))
    return genre.recommend(genres, D.quick_agreement(spark, sf_dir)).select("doc_id", "genre", "recommended", "divergence")


@query(rf"""with sents as (select doc_id, unnest(string_split_regex(text, '[.!?]+([ \t\n\r\f\x0B]|\z)')) as s, unnest(range(len(string_split_regex(text, '[.!?]+([ \t\n\r\f\x0B]|\z)')))) as sent from documents),
wl as (select doc_id, sent, list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '\p{{L}}+')) as ws from sents), t0 as (select doc_id, sent, unnest(ws) as w, unnest(range(len(ws))) as pos from wl),
t as (select doc_id, sent, w, lag(w, 1, '<s>') over (partition by doc_id order by sent, pos) as v from t0), tr as (select * from t where doc_id % 5 <> 0),
pr as (select v, w, count(*) as n from tr where v <> '<s>' group by 1, 2), rk as (select *, rank() over (partition by v order by n desc) - 1 as rank, sum(n) over (partition by v) as of_v from pr), uv as (select v, any_value(of_v) as of_v from rk group by 1), u as (select w, count(*) as n_w from tr group by 1), z as (select sum(n_w) as big_n, count(*) as big_v from u),
j as (select t.doc_id, t.sent, t.v, rk.n, rk.rank, uv.of_v, (coalesce(u.n_w, 0) + 1)::double / (big_n + big_v + 1) as uni from t left join rk on rk.v = t.v and rk.w = t.w left join u on u.w = t.w left join uv on uv.v = t.v, z),
p as (select doc_id, sent, -ln(case when v = '<s>' then uni else coalesce(0.7::double * n / of_v, 0) + 0.3::double * uni end) as loss, case when rank is null then 4 when rank = 0 then 0 when rank < 10 then 1 when rank < 100 then 2 when rank < 1000 then 3 else 4 end as bin from j),
ps as (select doc_id, sent, exp(round(avg(loss), 9)) as ppl from p group by 1, 2), sd as (select doc_id, case when count(*) > 1 then stddev_pop(ppl) else 0.0 end as sentence_std from ps group by 1), pd as (select doc_id, count(*) as n_tokens, exp(round(avg(loss), 9)) as perplexity from p group by 1),
bn as (select doc_id, bin, count(*)::double as c from p group by 1, 2), en as (select doc_id, sum(-(c / n_tokens) * log2(c / n_tokens)) as rank_entropy from bn join pd using (doc_id) group by 1)
select doc_id, n_tokens, round(perplexity, 4) as perplexity, round(sentence_std, 4) as sentence_std, round(rank_entropy, 6) as rank_entropy from pd join sd using (doc_id) join en using (doc_id)""")
def lm_features(spark, sf_dir):
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    return lm.lm_features(docs, F.col("doc_id") % 5 != 0)


SEED = 7


@query(f"with {T.sql_perturb('documents', SEED)} select doc_id, text from edited")
def perturbed(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", T.perturb(F.col("text"), SEED).alias("text"))


@query(f"with ru as (select doc_id, replace(text, ' and ', ', однако ') as text from documents), {T.sql_perturb('ru', SEED, T.RUSSIAN)} select doc_id, text from edited")
def perturbed_russian(spark, sf_dir):
    """The fixed rules for Russian, over texts in which one English word is a Russian place to split at."""
    text = F.replace(F.col("text"), F.lit(" and "), F.lit(", однако "))
    return D.documents(spark, sf_dir).select("doc_id", T.perturb(text, SEED, T.RUSSIAN).alias("text"))


def paired(spark, sf_dir, scorers=("a",)):
    """Scores of generated texts before and after edits: doc_id, generator, bucket, n_chars, scorer, before, after."""
    rows = C.corpus(spark, sf_dir).where("label = 1").select("doc_id", F.col("source").alias("generator"), "text")
    both = rows.select("doc_id", "generator", F.length("text").alias("size"), F.explode(F.array(F.struct(F.lit("before").alias("at"), F.col("text")), F.struct(F.lit("after").alias("at"), T.perturb(F.col("text"), SEED).alias("text")))).alias("v")).select("doc_id", "generator", "size", "v.at", "v.text")
    scored = features.with_scores(both, "text", ("a", "b"))
    p = {"a": F.col("p_a"), "b": F.col("p_b"), "ensemble": T.ensemble(F.col("p_a"), F.col("p_b"), F.col("n_chars"))}
    each = scored.select("doc_id", "generator", "size", "at", F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.round(p[s], 6).alias("p")) for s in scorers])).alias("s"))
    pick = lambda at: F.max(F.when(F.col("at") == at, F.col("s.p"))).alias(at)
    pairs = each.groupBy("doc_id", "generator", "size", "s.scorer").agg(pick("before"), pick("after"))
    bucket = F.when(F.col("size") < 1000, "A").otherwise("B").alias("bucket")
    return pairs.select("doc_id", "generator", bucket, F.col("size").alias("n_chars"), "scorer", "before", "after")


PAIRS = f"""ai as (select doc_id, source, text from c where label = 1), {T.sql_perturb('ai', SEED)}, fb as ({features.sql_features('ai', 'text', ('a', 'b'))}), fa as ({features.sql_features('edited', 'text', ('a', 'b'))}),
pr as (select fb.doc_id, fb.source as generator, case when fb.n_chars < 1000 then 'A' else 'B' end as bucket, fb.n_chars, fb.p_a as ba, fb.p_b as bb, fa.p_a as aa, fa.p_b as ab, fa.n_chars as n_after from fb join fa using (doc_id)),
pairs as (select doc_id, generator, bucket, n_chars, 'a' as scorer, round(ba, 6) as before, round(aa, 6) as after from pr union all select doc_id, generator, bucket, n_chars, 'b', round(bb, 6), round(ab, 6) from pr
union all select doc_id, generator, bucket, n_chars, 'ensemble', round(case when n_chars < 200 then bb else (ba + bb) / 2 end, 6), round(case when n_after < 200 then ab else (aa + ab) / 2 end, 6) from pr)"""
PAIRED = f"{C.K}, {PAIRS}"
_DROP = f"round(avg((before >= {THR})::int), 6) as recall_before, round(avg((after >= {THR})::int), 6) as recall_after, round(100 * (avg((before >= {THR})::int) - avg((after >= {THR})::int)), 6) as drop_pp"


@query(f"""with {PAIRED} select count(*) as n, {_DROP}, count(*) filter (where before >= {THR} and after < {THR}) as flipped, count(*) filter (where before < {THR} and after >= {THR}) as gained, round(avg(after - before), 6) as mean_delta,
round(quantile_cont(before, 0.5), 6) as median_before, round(quantile_cont(after, 0.5), 6) as median_after, round(quantile_cont(round(after - before, 6), 0.5), 6) as median_delta from pairs where scorer = 'a'""")
def robustness(spark, sf_dir):
    return metrics.robustness_report(paired(spark, sf_dir), THR)


@query(f"with {PAIRED} select bucket, generator, count(*) as n, {_DROP} from pairs where scorer = 'a' group by grouping sets ((), (bucket), (generator))")
def robustness_by(spark, sf_dir):
    """Recall before and after edits of all texts, of each bucket and of each generator."""
    return metrics.robustness_by(paired(spark, sf_dir), THR, ("bucket", "generator"))


_EDGES = ", ".join(f"({a}::double, {b}::double)" for a, b in zip(metrics.DELTA_EDGES, metrics.DELTA_EDGES[1:]))


@query(f"with {PAIRED} select low, high, count(*) filter (where scorer = 'a' and round(after - before, 6) >= low and round(after - before, 6) < high) as n from (values {_EDGES}) as e(low, high), pairs group by 1, 2")
def delta_histogram(spark, sf_dir):
    return metrics.delta_histogram(paired(spark, sf_dir))


#: Sources that hold out a generator each, in model comparisons.
HOLDOUTS = ("src2", "src10")
_SETS = f"""tst as (select * from sc where md5(doc_id::varchar) >= '8'), sets as (select 'test' as set, * from tst where n_chars >= 200 union all select 'short', * from tst where n_chars < 200 union all select 'hold-out ' || source, * from tst where label = 1 and source in {HOLDOUTS}),
ru as (select set, scorer, label, rank() over (partition by set, scorer order by p) + (count(*) over (partition by set, scorer, p) - 1) / 2.0::double as r from sets),
au as (select set, scorer, {_AUC} as auc from ru group by 1, 2), gr as (select round(0.05::double + 0.005::double * unnest(range(189)), 3) as t), pk as (select scorer, t, avg((p >= t)::int) as fpr from sc, gr where label = 0 and md5(doc_id::varchar) < '8' group by 1, 2), th as (select scorer, coalesce(min(t) filter (where fpr <= 0.03), max(t)) as threshold from pk group by 1)"""


@query(f"""with {Q}, {_SETS}, {PAIRS} select set, scorer, any_value(threshold) as threshold, count(*) as n, any_value(auc) as auc, round(avg((p >= threshold)::int) filter (where label = 0), 6) as fpr, round(avg((p >= threshold)::int) filter (where label = 1), 6) as recall, null::double as recall_after
from sets join th using (scorer) join au using (set, scorer) group by 1, 2 union all select 'edited', scorer, any_value(threshold), count(*), null, null, round(avg((before >= threshold)::int), 6), round(avg((after >= threshold)::int), 6) from pairs join th using (scorer) group by 2""")
def compare_on_sets(spark, sf_dir):
    """Scorers on the sets of a comparison: tests of long and of short texts, generators held out, and edited texts; each
    scorer at the threshold that the validation half gives it."""
    rows = scores(spark, sf_dir).withColumn("part", part())
    thresholds = metrics.pick_threshold(rows.where("part = 'validation'"), 0.03, keys=("scorer",))
    own = F.when(F.col("n_chars") >= 200, "test").otherwise("short")
    held = F.when((F.col("label") == 1) & F.col("source").isin(*HOLDOUTS), F.concat(F.lit("hold-out "), "source"))
    sets = rows.where("part = 'test'").select(F.explode(F.array_compact(F.array(own, held))).alias("set"), "scorer", "label", "p")
    return metrics.compare_on_sets(sets, thresholds, paired(spark, sf_dir, ("a", "b", "ensemble")))
