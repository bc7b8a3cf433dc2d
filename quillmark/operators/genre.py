"""Genre of a document from its leading content: densities of terms, citations, Latin letters, formulas and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SAMPLE = 5000
CITE = r"\[[^\]]*[0-9]{4}[^\]]*\]|\[[ \t]*[0-9]+([ \t]*[,;–-][ \t]*[0-9]+)*[ \t]*\]"
MATH = r"[=+→×÷≤≥∑∫√{}<>−]"
#: Term patterns of the fixture language; callers with other languages give their own.
TERMS = {"hum": "the|and|of", "tech": "in|on|ing", "sci": "tion|ment", "canc": "that|with"}
_APART, _ENDED = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Term stems of Russian academic texts, and words of program code; fixed values, for `terms` and `code`.
RUSSIAN_TERMS = {
    "hum": "исследован|методологи|корпус|семантик|дискурс|лингвист|интерпретац|концепт|нарратив|поэтик|философ|культур|"
    "социолог|историограф|художеств|литератур|роман|произведени|жанр|метафор|стилист|герменевт|эстетик|идентичност",
    "tech": f"систем|таблиц|интерфейс|база данных|{_APART}бд{_ENDED}|реализац|модул|сервер|алгоритм|диаграмм|разработк|программн|"
    f"функционал|приложени|пользовател|запрос|клиент|архитектур|{_APART}код{_ENDED}|развёртыван|тестирован|фреймворк|компонент|сущност",
    "sci": "гипотез|эксперимент|выборк|корреляц|значимост|респондент|статистическ|регресс|p-значени|контрольн.{0,3} групп",
    "canc": "обусловлен|представляет собой|в результате|таким образом|в связи с|следует отметить|необходимо отметить|"
    f"осуществляет|данн(ый|ая|ое|ых|ыми){_ENDED}",
}
CODE = f"{_APART}(function|var|import|def|class|return|select|create|insert|public|void|int |float){_ENDED}"


def genre_sample(content: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, sample, n_paras, n_cited): content paragraphs of 40 characters that are no tables (all content if there
    are none) in order until `most` characters are reached, joined and cut there."""
    ok = (F.length("text") >= 40) & ~F.startswith("text", F.lit(T.TABLE_MARK))
    any_ok = F.max(ok).over(Window.partitionBy("doc_id"))
    rows = content.withColumns({"_ok": ok, "_any": any_ok}).where("_ok or not _any")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < most)
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    docs = rows.groupBy("doc_id").agg(parts.alias("m"), F.count("*").alias("n_paras"), F.count_if(F.rlike("text", F.lit(CITE))).alias("n_cited"))
    return docs.select("doc_id", "n_paras", "n_cited", F.substring(F.array_join(F.transform("m", lambda r: r["text"]), " "), 1, most).alias("sample"))


def genre_features(sample: DataFrame, terms: dict[str, str] = TERMS, code: str | None = None) -> DataFrame:
    """Adds sentence length mean and deviation, cite_frac, latin_frac, mathcode_per_w and <term>_per1k; matches of the
    pattern `code` count with the formula signs."""
    signs = f"(?iu){MATH}|{code}" if code else MATH
    s = F.col("sample")
    rows = sample.withColumns({"n_words": T.word_count(s), "_lens": F.transform(F.filter(T.sentences(s), lambda x: T.strip(x) != ""), lambda x: T.word_count(x))})
    n, words = F.size("_lens"), F.greatest("n_words", F.lit(1))
    total, square = F.aggregate("_lens", F.lit(0), lambda a, x: a + x), F.aggregate("_lens", F.lit(0), lambda a, x: a + x * x)
    letters = F.greatest(F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.lit(1))
    per1k = {f"{name}_per1k": F.round(F.regexp_count(s, F.lit(f"(?iu){rx}")) / words * 1000, 1) for name, rx in terms.items()}
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return rows.withColumns(
        {
            "mean_sent_len": F.round(mean, 1), "sent_std": F.round(F.when(n > 1, F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0)))).otherwise(0.0), 1),
            "cite_frac": F.round(F.col("n_cited") / F.greatest("n_paras", F.lit(1)), 3), "latin_frac": F.round(F.length(F.regexp_replace(s, "[^A-Za-z]", "")) / letters, 3),
            "mathcode_per_w": F.round(F.regexp_count(s, F.lit(signs)) / words, 3), **per1k,
        }
    ).drop("_lens", "sample", "n_cited")


def genre_signals() -> tuple[Column, Column]:
    """(technical, humanities) on comparable scales."""
    tech = F.col("tech_per1k") + 800 * F.col("mathcode_per_w") + 0.6 * F.col("sci_per1k")
    hum = F.col("hum_per1k") + 120 * F.col("cite_frac") + 80 * F.col("latin_frac") + F.greatest(F.lit(0.0), F.col("mean_sent_len") - 14) * 1.2
    return tech, hum


def classify_genre(feats: DataFrame) -> DataFrame:
    """Adds tech_signal, hum_signal, genre, recommended and confident."""
    tech, hum = genre_signals()
    strong, weak = F.greatest(tech, hum), F.least(tech, hum)
    # Spark may take the quotient out of the condition that guards it, where both signals of a text can be 0
    mixed = (strong < 8) | ((weak > 8) & (F.try_divide(weak, strong) > 0.75))
    genre = F.when(mixed, "mixed").when(tech >= hum, "technical").otherwise("humanities")
    pick = F.when(mixed, "agree").when(tech >= hum, "v4").otherwise("v3")
    return feats.withColumns({"tech_signal": F.round(tech, 1), "hum_signal": F.round(hum, 1), "genre": genre, "recommended": pick, "confident": ~mixed})


def recommend(genres: DataFrame, divergence: DataFrame, most: float = 0.15) -> DataFrame:
    """The recommended scorer, but agreement for technical documents whose scorers diverge."""
    rows = genres.join(divergence.select("doc_id", "divergence"), "doc_id", "left")
    override = (F.col("genre") == "technical") & (F.col("divergence") > most)
    return rows.withColumn("recommended", F.when(F.coalesce(override, F.lit(False)), "agree").otherwise(F.col("recommended")))
