"""Reports of scanned documents as strings, one row per document, and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files

LABELS = ("suspicious", "uncertain", "human", "insufficient")
COLOURS = {"suspicious": "#d33", "uncertain": "#c90", "human": "#393", "insufficient": "#888"}
NOTE = "A score is a probabilistic estimate, not proof of authorship."


def _score(p):
    return F.coalesce(F.format_number(p, 2), F.lit("-"))


def _per_document(results: DataFrame, dropped: DataFrame | None, glued: DataFrame | None) -> DataFrame:
    """A row a document: its labels as (label, n, chars, mil), largest share first; kinds of short paragraphs, reasons of dropped ones,
    both as (name, n) by falling count; glued fragments (first, last, n, label, p, text) by falling score; `n_dropped`."""
    named = lambda df, name: df.groupBy("doc_id", F.col(name).alias("name")).agg(F.count("*").alias("n"))
    ranked = lambda df, out: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))).alias(out))
    sums = results.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    all_chars = F.aggregate("_s", F.lit(0).cast("long"), lambda t, x: t + x["chars"])
    order = {label: k for k, label in enumerate(LABELS)}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("label"))
    rows = sums.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "label", "n", "chars"))).alias("_s")).withColumn("_t", all_chars)
    rows = rows.withColumn("shares", F.transform("_s", lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"), x["chars"].alias("chars"), F.round(1000 * x["chars"] / F.greatest("_t", F.lit(1))).cast("int").alias("mil")))).drop("_s", "_t")
    rows = rows.join(ranked(named(results.where("p is null"), "subcat"), "kinds"), "doc_id", "left")
    if dropped is not None:
        rows = rows.join(ranked(named(dropped, "drop_reason"), "reasons"), "doc_id", "left")
    else:
        rows = rows.withColumn("reasons", F.lit(None).cast("array<struct<o:bigint,name:string,n:bigint>>"))
    if glued is not None:
        fragment = F.struct(F.round(-F.col("p"), 6).alias("o"), F.col("member_idxs")[0].alias("first"), F.element_at("member_idxs", -1).alias("last"), F.size("member_idxs").alias("n"), "label", "p", "text")
        rows = rows.join(glued.groupBy("doc_id").agg(F.array_sort(F.collect_list(fragment)).alias("glued")), "doc_id", "left")
    else:
        rows = rows.withColumn("glued", F.lit(None).cast("array<struct<o:double,first:bigint,last:bigint,n:int,label:string,p:double,text:string>>"))
    return rows.withColumn("n_dropped", F.aggregate(F.coalesce("reasons", F.array().cast("array<struct<o:bigint,name:string,n:bigint>>")), F.lit(0).cast("long"), lambda t, x: t + x["n"]))


def _percent(mil):
    return F.concat(F.floor(mil / 10).cast("string"), F.lit("."), (mil % 10).cast("string"), F.lit("%"))


def _said(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _list(items, line, joint: str):
    return F.array_join(F.transform(items, line), joint)


def _section(title: str, items, line, joint: str, end: str = ""):
    """A titled list; nothing without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(title), _list(items, line, joint), F.lit(end))).otherwise("")


def _heads(threshold: float, n):
    return (("threshold", F.lit(f"{threshold:.2f}")), ("paragraphs", n), ("dropped", F.col("n_dropped")))


def _bodies(results: DataFrame, line, joint: str) -> DataFrame:
    return results.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda r: r["line"]), joint).alias("body"), F.count("*").alias("n_paras"))


def report_markdown(results: DataFrame, dropped: DataFrame | None = None, glued: DataFrame | None = None, threshold: float = 0.72) -> DataFrame:
    """(doc_id, md): a header, shares of labels and kinds of short paragraphs, each paragraph in order with label and score, fragments
    `glued` (as scored, with their text) by falling score, reasons of `dropped` paragraphs, and a note. Sections without
    entries are left out."""
    line = _said("**", F.col("label"), "** (", _score(F.col("p")), ") ", F.col("text"))
    rows = _bodies(results, line, "\n\n").join(_per_document(results, dropped, glued), "doc_id")
    head = F.concat(*[_said(f"- {name}: ", value, "\n") for name, value in _heads(threshold, F.col("n_paras"))])
    shares = _section("\n## Shares\n", F.col("shares"), lambda x: _said("- ", x["label"], ": ", _percent(x["mil"]), " (", x["n"], " paragraphs, ", x["chars"], " characters)"), "\n", "\n")
    kinds = _section("- short: ", F.col("kinds"), lambda x: _said(x["name"], " ", x["n"]), ", ", "\n")
    joined = _section("\n\n## Glued\n", F.col("glued"), lambda x: _said("**", x["first"], "-", x["last"], "** ", x["label"], " (", _score(x["p"]), ") ", x["text"]), "\n\n")
    reasons = _section("\n\n## Dropped\n", F.col("reasons"), lambda x: _said("- ", x["name"], ": ", x["n"]), "\n")
    return rows.select("doc_id", _said("# Document ", F.col("doc_id"), "\n\n", head, shares, kinds, "\n## Paragraphs\n", F.col("body"), joined, reasons, f"\n\n{NOTE}\n").alias("md"))


def escaped(text):
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def report_html(results: DataFrame, dropped: DataFrame | None = None, glued: DataFrame | None = None, threshold: float = 0.72) -> DataFrame:
    """(doc_id, html): the same as a page; paragraphs have an anchor and the colour of their label, texts are escaped."""
    colour = lambda label: F.element_at(F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(v))]), label)
    line = _said('<p id="p', F.col("idx"), '" style="color:', colour(F.col("label")), '">', escaped(F.col("text")), "</p>")
    rows = _bodies(results, line, "\n").join(_per_document(results, dropped, glued), "doc_id")
    head = F.concat(*[_said(f"<tr><td>{name}</td><td>", value, "</td></tr>") for name, value in _heads(threshold, F.col("n_paras"))])
    shares = _section("<ul>", F.col("shares"), lambda x: _said('<li style="color:', colour(x["label"]), '">', x["label"], " <b>", _percent(x["mil"]), "</b> (", x["n"], ", ", x["chars"], ")</li>"), "", "</ul>")
    kinds = _section("<p>short: ", F.col("kinds"), lambda x: _said(x["name"], " ", x["n"]), ", ", "</p>")
    joined = _section("\n<h2>Glued</h2>\n", F.col("glued"), lambda x: _said('<p id="g', x["first"], '" style="color:', colour(x["label"]), '">', x["first"], "-", x["last"], ": ", escaped(x["text"]), "</p>"), "\n")
    reasons = _section("\n<h2>Dropped</h2><ul>", F.col("reasons"), lambda x: _said("<li>", x["name"], ": ", x["n"], "</li>"), "", "</ul>")
    return rows.select("doc_id", _said('<html><head><meta charset="utf-8"></head><body>\n<h1>Document ', F.col("doc_id"), "</h1><table>", head, "</table>", shares, kinds, "\n", F.col("body"), joined, reasons, f"\n<footer>{NOTE}</footer></body></html>").alias("html"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Report strings as files, one a document: `<doc_id>.report.md` or `<doc_id>.report.html`."""
    body = "md" if "md" in reports.columns else "html"
    files.write_files(reports, path, "doc_id", body, f".report.{body}")


#: What the reports take from results, dropped paragraphs (dr) and scored fragments with their text (gl).
_SH = """sh as (select doc_id, label, count(*) as n, sum(length(text)) as chars from results group by 1, 2), st as (select *, round(1000 * chars::double / greatest(sum(chars) over (partition by doc_id), 1))::int as mil from sh),
ki as (select doc_id, subcat as name, count(*) as n from results where p is null group by 1, 2), re as (select doc_id, drop_reason as name, count(*) as n from dr group by 1, 2)"""
_RANK = "list_position(['suspicious', 'uncertain', 'human', 'insufficient'], label)"
_PCT = "(mil // 10) || '.' || (mil % 10) || '%'"
_CASE = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in COLOURS.items()) + " end"
_ESC = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
NL = "chr(10)"


def _sql(share: str, line: str, joint: str, glue: str, reason: str, ends: str) -> str:
    return f"""{_SH}, x_s as (select doc_id, string_agg({share}, {ends} order by {_RANK}) as x from st group by 1), x_k as (select doc_id, string_agg(name || ' ' || n, ', ' order by n desc, name) as x from ki group by 1),
x_b as (select doc_id, string_agg({line}, {joint} order by idx) as x, count(*) as n from results group by 1), x_g as (select doc_id, string_agg({glue}, {joint} order by round(-p, 6), member_idxs[1]) as x from gl group by 1),
x_r as (select doc_id, string_agg({reason}, {ends} order by n desc, name) as x, sum(n)::bigint as n from re group by 1),
al as (select x_b.doc_id, x_b.x as body, x_b.n as n_paras, coalesce(x_r.n, 0) as n_dropped, x_s.x as sx, x_k.x as kx, x_g.x as gx, x_r.x as rx from x_b left join x_s using (doc_id) left join x_k using (doc_id) left join x_g using (doc_id) left join x_r using (doc_id))"""


SQL_MARKDOWN = (
    _sql(f"'- ' || label || ': ' || {_PCT} || ' (' || n || ' paragraphs, ' || chars || ' characters)'", "'**' || label || '** (' || coalesce(format('{:.2f}', p), '-') || ') ' || text", f"{NL} || {NL}",
         "'**' || member_idxs[1] || '-' || member_idxs[-1] || '** ' || label || ' (' || coalesce(format('{:.2f}', p), '-') || ') ' || text", "'- ' || name || ': ' || n", NL)
    + f""" select doc_id, md5(md) as md5, length(md) as n from (select doc_id, '# Document ' || doc_id || {NL} || {NL} || '- threshold: 0.72' || {NL} || '- paragraphs: ' || n_paras || {NL} || '- dropped: ' || n_dropped || {NL} || coalesce({NL} || '## Shares' || {NL} || sx || {NL}, '') || coalesce('- short: ' || kx || {NL}, '') || {NL} || '## Paragraphs' || {NL} || body
    || coalesce({NL} || {NL} || '## Glued' || {NL} || gx, '') || coalesce({NL} || {NL} || '## Dropped' || {NL} || rx, '') || {NL} || {NL} || '{NOTE}' || {NL} as md from al)"""
)
SQL_HTML = (
    _sql(f"'<li style=\"color:' || {_CASE} || '\">' || label || ' <b>' || {_PCT} || '</b> (' || n || ', ' || chars || ')</li>'", f"'<p id=\"p' || idx || '\" style=\"color:' || {_CASE} || '\">' || {_ESC} || '</p>'", NL,
         f"'<p id=\"g' || member_idxs[1] || '\" style=\"color:' || {_CASE} || '\">' || member_idxs[1] || '-' || member_idxs[-1] || ': ' || {_ESC} || '</p>'", "'<li>' || name || ': ' || n || '</li>'", "''")
    + f""" select doc_id, md5(html) as md5, length(html) as n from (select doc_id, '<html><head><meta charset="utf-8"></head><body>' || {NL} || '<h1>Document ' || doc_id || '</h1><table><tr><td>threshold</td><td>0.72</td></tr><tr><td>paragraphs</td><td>' || n_paras || '</td></tr><tr><td>dropped</td><td>' || n_dropped || '</td></tr></table>'
    || coalesce('<ul>' || sx || '</ul>', '') || coalesce('<p>short: ' || kx || '</p>', '') || {NL} || body || coalesce({NL} || '<h2>Glued</h2>' || {NL} || gx, '') || coalesce({NL} || '<h2>Dropped</h2><ul>' || rx || '</ul>', '') || {NL} || '<footer>{NOTE}</footer></body></html>' as html from al)"""
)
