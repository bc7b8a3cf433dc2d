"""Metrics of scores (label, p): every metric reduces the scores first, to counts by threshold, bin or distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = tuple(round(0.05 + 0.005 * k, 3) for k in range(189))


def rate(hit: Column, among: Column) -> Column:
    """Share of `hit` in rows of `among`, to 6 places; null without rows."""
    return F.round(F.avg(F.when(among, hit.cast("int"))), 6)


def fpr_recall_at(df: DataFrame, threshold: float | Column, keys: tuple[str, ...] = (), p: str = "p") -> DataFrame:
    """(*keys, n, fpr, recall) at a threshold."""
    hit = F.col(p) >= threshold
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rate(hit, F.col("label") == 0).alias("fpr"), rate(hit, F.col("label") == 1).alias("recall"))


def classification_report(df: DataFrame, threshold: float) -> DataFrame:
    """One row: confusion counts, accuracy, fpr, and precision, recall and f1 of both classes."""
    hit, y = F.col("p") >= threshold, F.col("label") == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "fpr": ratio(fp, fp + tn), "precision1": ratio(tp, tp + fp), "recall1": ratio(tp, tp + fn), "f1_1": ratio(2 * tp, 2 * tp + fp + fn), "precision0": ratio(tn, tn + fn), "recall0": ratio(tn, tn + fp), "f1_0": ratio(2 * tn, 2 * tn + fp + fn)})


def apart(df: DataFrame) -> DataFrame:
    """`df` with its columns taken out of a generator. A join or filter above then stays above: what it implies of a column
    is not pushed below an aggregation, where it would write out and compute the column's whole expression again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def score_counts(df: DataFrame, keys: tuple[str, ...] = (), value: str = "p") -> DataFrame:
    """(*keys, value, n0, n1): rows of either label by distinct value, all that the metrics below need of the scored rows."""
    return apart(df.groupBy(*keys, value).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))


def auc_of_counts(by: DataFrame, keys: tuple[str, ...] = (), value: str = "p") -> DataFrame:
    """(*keys, auc) of counts (*keys, value, n0, n1), ties one half. Distinct scores reduce to score bins whose counts give
    each bin's share of lower negatives, so no partition holds all scores."""
    rows = by.withColumn("_bin", F.floor(F.col(value) * 1000))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("n0").alias("_b0"))
    lower = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_low", F.coalesce(F.sum("_b0").over(lower), F.lit(0))).drop("_b0")
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n0").over(inside), F.lit(0))).join(F.broadcast(bins), [*keys, "_bin"])
    wins = F.sum(F.col("n1") * (F.col("_low") + F.col("_in") + F.col("n0") / 2))
    return rows.groupBy(*keys).agg(F.round(F.when((F.sum("n0") > 0) & (F.sum("n1") > 0), wins / (F.sum("n0") * F.sum("n1"))), 6).alias("auc"))


def roc_auc(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, auc) by ranks, ties one half."""
    return auc_of_counts(score_counts(df, keys), keys)


def quantiles(by: DataFrame, at: tuple[float, ...], keys: tuple[str, ...] = (), value: str = "p", weight: Column | None = None, width: float = 0.001) -> DataFrame:
    """(*keys, q, value): exact quantiles, linear between neighbours, of counts by distinct value; keys without rows are absent.

    `weight` is a value's count (default n0 + n1). Counts add up by bins of `width` first, and only bins that hold a wanted
    rank are looked into, so no task sorts all values of a key. Keys are few: two bins for each of them and q are broadcast.
    """
    weight = F.col("n0") + F.col("n1") if weight is None else weight
    rows = by.select(*keys, F.col(value).alias("_v"), weight.alias("_w"), F.floor(F.col(value) / width).alias("_bin")).where("_w > 0 and _v is not null")
    per = Window.partitionBy(*(keys or (F.lit(0),)))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_n"))
    before = F.sum("_n").over(per.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*keys, "_bin", "_n", F.coalesce(before, F.lit(0)).alias("_low"), F.sum("_n").over(per).alias("_all"))
    bins = bins.withColumn("q", F.explode(F.array(*map(F.lit, at))))  # after the sums, which would count a bin once for each q
    bins = bins.withColumn("_r", F.col("q") * (F.col("_all") - 1)).withColumns({"_a": F.floor("_r"), "_b": F.ceil("_r")})
    bins = bins.where("_low <= _b and _a < _low + _n").select(*keys, "q", "_bin", "_low", "_a", "_b", (F.col("_r") - F.col("_a")).alias("_part"))
    inside = Window.partitionBy(*keys, "q", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(F.broadcast(bins), [*keys, "_bin"]).withColumn("_from", F.col("_low") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    ranked = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_from") + F.col("_w")), F.col("_v")))
    ends = found.groupBy(*keys, "q").agg(ranked("_a").alias("_lo"), ranked("_b").alias("_hi"), F.first("_part").alias("_part"))
    return ends.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(value))


def threshold_table(df: DataFrame, thresholds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, threshold, fpr, recall) for each of a few thresholds."""
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return fpr_recall_at(df.select(*keys, "label", "p", at), F.col("threshold"), (*keys, "threshold")).drop("n")


def pick_threshold(df: DataFrame, target: float, grid: tuple[float, ...] = GRID, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, threshold): the smallest grid value with at most the target share of negatives at or above, else the
    last. Scores reduce to counts by grid cell before the grid is laid over them."""
    cell = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))
    # out of a generator, as each grid value would compute the score again
    counts = apart(df.where("label = 0").select(*keys, "p")).groupBy(*keys, cell.alias("cell")).count()
    steps = counts.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(grid))))).groupBy(*keys, "at").agg(F.sum(F.when(F.col("cell") >= F.col("at"), F.col("count")).otherwise(0)).alias("above"), F.sum("count").alias("n"))
    value = F.element_at(F.array(*map(F.lit, grid)), F.col("at"))
    return steps.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("above") / F.col("n") <= target, value)), F.lit(grid[-1])).alias("threshold"))


def quantile_threshold(df: DataFrame, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, threshold): the q-quantile of negatives' scores, linear between neighbours."""
    found = quantiles(score_counts(df, keys), (q,), keys, weight=F.col("n0"))
    return found.select(*keys, F.round("p", 6).alias("threshold"))


def calibration_curve(df: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n, predicted, observed) by quantiles of p; of the scored rows only counts by score are kept."""
    by = score_counts(df)
    edges = F.broadcast(quantiles(by, tuple(k / bins for k in range(1, bins))).agg(F.sort_array(F.collect_list("p")).alias("_e")))
    at = F.size(F.filter("_e", lambda e: e < F.col("p")))
    n = F.col("n0") + F.col("n1")
    sums = by.crossJoin(edges).groupBy(at.alias("bin")).agg(F.sum(n).alias("n"), F.sum(F.col("p") * n).alias("_p"), F.sum("n1").alias("_y"))
    return sums.select("bin", "n", F.round(F.col("_p") / F.col("n"), 6).alias("predicted"), F.round(F.col("_y") / F.col("n"), 6).alias("observed"))


def overlap_coeff(df: DataFrame, bins: int = 20) -> DataFrame:
    """One row: overlap, the shared area of both classes' histograms."""
    rows = df.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    total = F.broadcast(rows.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b")))
    return rows.crossJoin(total).agg(F.round(F.sum(F.least(F.col("a") / F.col("_a"), F.col("b") / F.col("_b"))), 6).alias("overlap"))


def recall_by(df: DataFrame, keys: tuple[str, ...], threshold: float) -> DataFrame:
    """Recall of label 1 by rollup of keys."""
    return df.where("label = 1").rollup(*keys).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") >= threshold).cast("int")), 6).alias("recall"))


#: Edges of the histogram of changes of a score; fixed values.
DELTA_EDGES = (-1.0, -0.8, -0.6, -0.4, -0.3, -0.2, -0.1, -0.05, 0.0, 0.05, 1.0)


def _drop(threshold: float) -> dict[str, Column]:
    a, b = (F.avg((F.col(c) >= threshold).cast("int")) for c in ("before", "after"))
    return {"recall_before": F.round(a, 6), "recall_after": F.round(b, 6), "drop_pp": F.round(100 * (a - b), 6)}


def robustness_report(df: DataFrame, threshold: float) -> DataFrame:
    """One row from paired scores (before, after): recalls, drop in points, flips, medians of both and of the change, and its mean."""
    a, b = F.col("before") >= threshold, F.col("after") >= threshold
    sums = df.agg(F.count("*").alias("n"), *[c.alias(name) for name, c in _drop(threshold).items()], F.count_if(a & ~b).alias("flipped"), F.count_if(~a & b).alias("gained"), F.round(F.avg(F.col("after") - F.col("before")), 6).alias("mean_delta"))
    each = F.array(*[F.struct(F.lit(name).alias("kind"), F.round(c, 6).alias("v")) for name, c in (("median_before", F.col("before")), ("median_after", F.col("after")), ("median_delta", F.col("after") - F.col("before")))])
    by = apart(df.select(F.explode(each).alias("_m")).select("_m.kind", "_m.v").groupBy("kind", "v").agg(F.count("*").alias("_k")))
    medians = quantiles(by, (0.5,), ("kind",), "v", F.col("_k"))
    return sums.crossJoin(F.broadcast(medians.agg(*[F.round(F.max(F.when(F.col("kind") == name, F.col("v"))), 6).alias(name) for name in ("median_before", "median_after", "median_delta")])))


def robustness_by(df: DataFrame, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, n, recall_before, recall_after, drop_pp) of paired scores, for each key alone and, with nulls, for all rows."""
    sets = [[], *[[k] for k in keys]]
    return df.groupingSets(sets, *keys).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in _drop(threshold).items()])


def delta_histogram(df: DataFrame, edges: tuple[float, ...] = DELTA_EDGES) -> DataFrame:
    """(low, high, n): changes after - before from each edge to below the next, empty bins with 0."""
    delta = F.round(F.col("after") - F.col("before"), 6)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= delta))
    counts = df.groupBy(at.alias("_at")).agg(F.count("*").alias("_n"))
    bins = df.sparkSession.createDataFrame([(k + 1, low, high) for k, (low, high) in enumerate(zip(edges, edges[1:]))], "_at int, low double, high double")
    return bins.join(counts, "_at", "left").select("low", "high", F.coalesce("_n", F.lit(0)).alias("n"))


def sweep_report(by: DataFrame, q: float = 0.975, first: str = "", keys: tuple[str, ...] = ("scorer", "n")) -> DataFrame:
    """(*keys, threshold, recall, recall_first, fpr, auc, auc_first) of counts (*keys, part, source, p, n0, n1).

    Thresholds are quantiles of the validation part's negatives, and the test part is judged by them; `first` names a
    source whose positives are reported by themselves.
    """
    thresholds = quantiles(by.where("part = 'validation'"), (q,), keys, weight=F.col("n0")).select(*keys, F.round("p", 6).alias("threshold"))
    test = by.where("part = 'test'").withColumn("n2", F.when(F.col("source") == first, F.col("n1")).otherwise(0))
    hit = F.col("p") >= F.col("threshold")
    share = lambda c: F.round(F.sum(F.when(hit, F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0)), 6)
    rates = test.join(F.broadcast(thresholds), list(keys)).groupBy(*keys).agg(F.first("threshold").alias("threshold"), share("n1").alias("recall"), share("n2").alias("recall_first"), share("n0").alias("fpr"))
    sums = test.groupBy(*keys, "p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    rows = rates.join(auc_of_counts(sums.select(*keys, "p", "n0", "n1"), keys), list(keys), "left")
    return rows.join(auc_of_counts(sums.select(*keys, "p", "n0", F.col("n2").alias("n1")), keys).withColumnRenamed("auc", "auc_first"), list(keys), "left")


def length_aware_gain(by: DataFrame, q: float = 0.975) -> DataFrame:
    """(n, own, flat, recall_own, recall_flat, fpr_own, fpr_flat, gain) of counts (n, part, p, n0, n1), n = 0 being whole texts.

    The validation part's negatives set a threshold for each length, `own`, and one of whole texts, `flat`; recalls and
    rates of false positives are those of the test part.
    """
    by = by.groupBy("n", "part", "p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    thresholds = quantiles(by.where("part = 'validation'"), (q,), ("n",), weight=F.col("n0")).select("n", F.round("p", 6).alias("own"))
    flat = F.broadcast(thresholds.where("n = 0").select(F.col("own").alias("flat")))
    rows = by.where("part = 'test' and n > 0").join(F.broadcast(thresholds), "n").crossJoin(flat)  # one row
    share = lambda t, c: F.round(F.sum(F.when(F.col("p") >= F.col(t), F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0)), 6)
    sums = rows.groupBy("n").agg(F.first("own").alias("own"), F.first("flat").alias("flat"), *[share(t, c).alias(f"{name}_{t}") for name, c in (("recall", "n1"), ("fpr", "n0")) for t in ("own", "flat")])
    return sums.withColumn("gain", F.round(F.col("recall_own") - F.col("recall_flat"), 6))


def sweep_acceptance(report: DataFrame, old: str, new: str, at: int = 40, gain: tuple[float, float] = (0.10, 0.05), fpr: float = 0.03, slack: float = 0.005) -> DataFrame:
    """(name, value, op, bound, passed, verdict) of a new scorer's `sweep_report` against an old one's.

    The recall at length `at` must rise by the first of `gain`, no length's rate of false positives pass `fpr`, and that of
    whole texts (n = 0) not pass the old one's by more than `slack`: accepted. With a rise by the second of `gain` and the
    rates of all lengths within bounds: partial. Else rejected.
    """
    pick = lambda scorer, n, c: F.max(F.when((F.col("scorer") == scorer) & (F.col("n") == n), F.col(c)))
    found = report.agg((pick(new, at, "recall") - pick(old, at, "recall")).alias("g"), F.max(F.when((F.col("scorer") == new) & (F.col("n") > 0), F.col("fpr"))).alias("f"), (pick(new, 0, "fpr") - pick(old, 0, "fpr")).alias("w"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    g, f, w = (F.round(c, 6) for c in ("g", "f", "w"))
    verdict = F.when(ok(g >= gain[0]) & ok(f <= fpr) & ok(w <= slack), "accepted").when(ok(g >= gain[1]) & ok(f <= fpr), "partial").otherwise("rejected")
    rows = [(f"gain at {at}", g, ">=", gain[0], ok(g >= gain[0])), ("largest fpr", f, "<=", fpr, ok(f <= fpr)), ("fpr of whole texts, change", w, "<=", slack, ok(w <= slack))]
    each = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(op).alias("op"), F.lit(bound).alias("bound"), passed.alias("passed"), verdict.alias("verdict")) for name, value, op, bound, passed in rows])
    return found.select(F.inline(each))


def acceptance(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, value, op, bound, passed, all_passed) of metrics (name, value) under rules (name, op, bound)."""
    rows = metrics.join(F.broadcast(rules), "name")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    rows = rows.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return rows.crossJoin(F.broadcast(rows.agg(F.bool_and("passed").alias("all_passed"))))


def fpr_budget(df: DataFrame, threshold: float, keys: tuple[str, ...], budget: float = 0.03) -> DataFrame:
    """(*keys, n, flagged, within): whether flagged negatives are at most ceil(budget * n)."""
    return df.where("label = 0").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("p") >= threshold).alias("flagged")).withColumn("within", F.col("flagged") <= F.ceil(budget * F.col("n")))


def compare_on_sets(sets: DataFrame, thresholds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set, scorer, threshold, n, auc, fpr, recall, recall_after) of scores in long form (set, scorer, label, p), each scorer at its own of
    `thresholds` (scorer, threshold), and as set `edited` the recalls of paired scores (scorer, before, after)."""
    by = score_counts(sets, ("set", "scorer"))
    few = F.broadcast(thresholds)  # a row for each scorer
    hit = F.col("p") >= F.col("threshold")
    share = lambda c: F.round(F.sum(F.when(hit, F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0)), 6)
    rates = by.join(few, "scorer").groupBy("set", "scorer").agg(F.first("threshold").alias("threshold"), F.sum(F.col("n0") + F.col("n1")).alias("n"), share("n0").alias("fpr"), share("n1").alias("recall"))
    rates = rates.join(auc_of_counts(by, ("set", "scorer")), ["set", "scorer"], "left")
    over = lambda c: F.round(F.avg((F.col(c) >= F.col("threshold")).cast("int")), 6)
    edited = pairs.join(few, "scorer").groupBy("scorer").agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), over("before").alias("recall"), over("after").alias("recall_after"))
    none = F.lit(None).cast("double")
    columns = ("set", "scorer", "threshold", "n", "auc", "fpr", "recall", "recall_after")
    return rates.withColumn("recall_after", none).select(*columns).unionByName(edited.select(F.lit("edited").alias("set"), "scorer", "threshold", "n", none.alias("auc"), none.alias("fpr"), "recall", "recall_after"))
