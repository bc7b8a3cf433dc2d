"""Column functions over texts: cleaning, predicates, words, sentences and rhythm features.

All are built-in expressions, so they stay inside the scan's stage. Words are written with explicit Unicode classes,
which mean the same in Java's and in other regular expression engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores with at least one letter.
WORD = r"[\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_]*"
#: The same without a step back, for Java.
WHOLE_WORD = r"[\p{N}_]*+\p{L}[\p{L}\p{N}_]*+"
#: A word from its first letter on, which is enough to count words and to find where they end.
WORD_END = r"\p{L}[\p{L}\p{N}_]*+"
SPACE = r"[ \t\n\r\f\x0B]"
BLANKS = " \t\n\r\f\x0b"
TABLE_MARK = "⟦таблица"
MARKS = r"[.,!?;:()«»—-]"
MIN_CHARS = 200


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_END))


def flat(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def preview(text: Column, n: int) -> Column:
    """One line of at most n characters, then an ellipsis."""
    line = flat(text)
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def clean_para(text: Column) -> Column:
    """Line breaks inside a paragraph as spaces."""
    return strip(F.regexp_replace(text, r"[ \t]*\n[ \t]*", " "))


#: Words up to which a beginning is matched by one expression, whose depth grows with them.
MATCHED_WORDS = 500


def truncate_words(text: Column, n: int | Column) -> Column:
    """The text up to the end of its n-th word; the whole text if it has no more than n.

    For a number up to `MATCHED_WORDS` one match from the start finds the end and reads no further than the next letter;
    otherwise the lengths of words and gaps are summed.
    """
    if isinstance(n, int) and 0 < n <= MATCHED_WORDS:
        cut = F.regexp_extract(text, rf"(?s)\A((?>.*?{WORD}){{{n}}}).*?\p{{L}}", 1)
        return F.when(cut != "", cut).otherwise(text)
    n = F.lit(n) if isinstance(n, int) else n
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    gaps = F.split(text, WORD, -1)
    length = lambda parts: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, x: total + F.length(x))
    return F.when(F.size(words) <= n, text).otherwise(F.substring(text, F.lit(1), length(gaps) + length(words)))


def script_ratio(text: Column, script: str = r"\p{IsCyrillic}") -> Column:
    """Share of letters that are of a script; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, f"[^{script}]", ""))
    return F.when(letters > 0, own / letters).otherwise(0.0)


#: Openings that a generator puts before its answer; fixed values, as a pattern over the start of a text.
PREAMBLE = r"(?i)^(конечно|разумеется|хорошо|вот|ниже|текст абзаца|абзац|certainly|sure|here is|here's)([^\p{L}\p{N}_:\n][^:\n]{0,89})?:[ \t]*\n*"
REFUSAL = r"(?i)^[ \t\n]*(извин|я не мог|как языков|не могу|к сожалению|i am sorry|i'm sorry|i cannot|as an ai)"
#: Tags of reasoning, and marks of markup.
THINK, MARKUP = r"(?i)</?think>", r"[#*`>_]"


def _unicode(pattern: str) -> str:
    """(?i) over all of Unicode, which Java asks for by a flag of its own."""
    return pattern.replace("(?i)", "(?iu)")


def clean_generated(text: Column, preamble: str = PREAMBLE) -> Column:
    """A generated text without reasoning blocks and stray tags, markup characters, up to two preambles, quotes around it and runs of
    white space."""
    text = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    text = F.regexp_replace(text, THINK, "")
    text = strip(F.regexp_replace(text, MARKUP, ""))
    for _ in range(2):
        text = strip(F.regexp_replace(text, _unicode(preamble), ""))
    return F.btrim(flat(text), F.lit("\"«»“” "))


def is_valid_generated(text: Column, min_chars: int = 200, min_words: int = 0, script: str = r"\p{IsCyrillic}", share: float = 0.5) -> Column:
    """Long enough, no reasoning tag left, no refusal, mostly of the script."""
    return (F.length(text) >= min_chars) & (word_count(text) >= min_words) & ~F.rlike(text, F.lit(THINK)) & ~F.rlike(text, F.lit(_unicode(REFUSAL))) & (script_ratio(text, script) >= share)


# ---- words, sentences and rhythm ---------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case tokens that are all letters; tokens are runs of letters, digits, _ and -."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]+"), 0)
    return F.filter(tokens, lambda token: F.rlike(token, F.lit(r"^\p{L}+$")))


#: Where a sentence ends.
END = r"[.!?]+(?:[ \t\n\r\f\x0B]|\z)"


def sentences(text: Column) -> Column:
    """Parts between runs of . ! ? before white space or the end."""
    return F.split(text, END)


def sentence_lengths(text: Column) -> Column:
    return F.filter(F.transform(sentences(text), lambda s: F.size(words(s))), lambda n: n > 0)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def punct_variety(text: Column) -> Column:
    """Distinct marks of ten, over 8."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKS), 0))) / F.lit(8.0)


def text_md5(text: Column) -> Column:
    return F.md5(text)


# ---- thresholds and labels ---------------------------------------------------------------------------------------


def verdict(p: Column, threshold: Column | float) -> Column:
    return p >= threshold


def label_for(p: Column, threshold: Column | float, floor: float = 0.5) -> Column:
    """suspicious from the threshold, uncertain from the floor, human below, insufficient without a score."""
    return F.when(p.isNull(), "insufficient").when(p >= threshold, "suspicious").when(p >= floor, "uncertain").otherwise("human")


def threshold_for(n_words: Column, base: Column, short: Column, cutoff: Column) -> Column:
    """The short threshold below `cutoff` words; the base one if short or cutoff is not given; 0.86 without any."""
    return F.coalesce(F.when(n_words < cutoff, short), base, F.lit(0.86))


def ensemble(p1: Column, p2: Column, length: Column) -> Column:
    """The second scorer for short texts, else the mean of both."""
    return F.when(length < MIN_CHARS, p2).otherwise((p1 + p2) / 2)


def notes(length: Column, n_words: Column, cutoff: Column) -> Column:
    return F.concat_ws("; ", F.when(length < MIN_CHARS, F.lit("short text")), F.when(n_words < cutoff, F.lit("stricter threshold")))


# ---- edits -------------------------------------------------------------------------------------------------------


def chance(op: str, seed: int, text: Column, at: Column | int = 0) -> Column:
    """A number in [0, 1) that follows from the operation, seed, text and position."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{op}:"), at.cast("string"), F.lit(":"), text)), 1, 8), 16, 10).cast("double") / 4294967296.0


@dataclass(frozen=True)
class EditRules:
    """What the edits put in place: phrases and replacements; connectives that open a sentence; what a long sentence is split at
    with the opening of its second part (none: a capital); and a pattern of introductory words that may move to the end."""

    phrases: tuple[tuple[str, str], ...]
    connectives: tuple[str, ...]
    splits: tuple[tuple[str, str], ...]
    intro: str


PLAIN = EditRules(
    (("the", "this"), ("with", "plus"), ("and that", "so that")),
    ("Well,", "So,", "Indeed,", "Then,", "Now,", "Thus,", "Still,", "Also,"),
    ((" and ", ""), (" that ", "This "), (" which ", "It "), (" und ", ""), (" que ", "Que ")),
    r"^(However|Indeed|Therefore|The)[ ,]+",
)
#: The rules for Russian texts; fixed values.
RUSSIAN = EditRules(
    (
        ("важно отметить", "стоит сказать"), ("стоит отметить", "замечу"), ("следует отметить", "добавлю"), ("необходимо отметить", "скажу"),
        ("таким образом", "значит"), ("в заключение", "под конец"), ("играет важную роль", "много значит"), ("играет ключевую роль", "очень важна"),
        ("является неотъемлемой частью", "часть"), ("следует подчеркнуть", "подчеркну"), ("в современном мире", "сейчас"), ("в настоящее время", "сейчас"),
        ("не секрет, что", "понятно, что"), ("в первую очередь", "сперва"), ("необходимо учитывать", "надо помнить"), ("в целом можно сказать", "в общем"),
        ("подводя итог", "если коротко"), ("позволяет сделать вывод", "показывает"), ("открывает широкие возможности", "много чего даёт"),
        ("приобретают всё большую актуальность", "всё важнее"),
    ),
    ("В общем,", "Честно говоря,", "По сути,", "На самом деле,", "Если что,", "Грубо говоря,", "Кстати,", "Короче,"),
    ((", и ", ""), (", а также ", ""), (", а ", ""), (", но ", "Но "), (", однако ", "Однако "), (", поэтому ", "Поэтому "), (", что ", "Это ")),
    r"^(Однако|Кроме того|Таким образом|Тем не менее|Более того|Впрочем|Следовательно|Конечно) ?,[ ,]*",
)
#: Chances of the edits, the words beyond which a sentence is long, and the share of it that its first part has; fixed values.
P_PHRASE, P_SPLIT, P_CONNECTIVE, P_INTRO, LONG_SENTENCE, FIRST_PART = 0.7, 0.6, 0.3, 0.5, 16, 0.35


def _capital(x: str) -> str:
    return x[0].upper() + x[1:]


def _opened(text: Column, change: Callable[[Column], Column]) -> Column:
    """The text with its first character changed, but for one that would become two."""
    first = F.substring(text, 1, 1)
    return F.concat(F.when(first == "ß", first).otherwise(change(first)), F.substring(text, F.lit(2), F.length(text)))


def perturb_phrase(sentence: Column, seed: int, k: int, old: str, new: str, p: float = P_PHRASE) -> Column:
    """Replaces the k-th phrase with chance p, keeping a capital at its start."""
    edited = F.regexp_replace(sentence, rf"(^|[^\p{{L}}]){old}($|[^\p{{L}}])", f"$1{new}$2")
    edited = F.regexp_replace(edited, rf"(^|[^\p{{L}}]){_capital(old)}($|[^\p{{L}}])", f"$1{_capital(new)}$2")
    drawn = chance("phrase", seed, sentence, k) < p
    if re.escape(old).replace("\\ ", " ") == old:  # a plain phrase is looked for first, as few sentences have it
        drawn = (F.contains(sentence, F.lit(old)) | F.contains(sentence, F.lit(_capital(old)))) & drawn
    return F.when(drawn, edited).otherwise(sentence)


def perturb_split(sentence: Column, seed: int, splits: Sequence[tuple[str, str]] = PLAIN.splits, p: float = P_SPLIT, longest: int = LONG_SENTENCE) -> Column:
    """Ends a long sentence at the first place of `splits` past 35 % of its length; a second one starts there, with the
    opening that the place asks for or else a capital."""
    floor = F.floor(F.length(sentence) * FIRST_PART).cast("int") + 1
    found = F.array_min(F.filter(F.array(*[F.struct(F.instr(F.substring(sentence, floor, F.length(sentence)), s).alias("at"), F.lit(k).alias("k")) for k, (s, _) in enumerate(splits)]), lambda x: x["at"] > 0))
    begin = found["at"] + floor - 1
    width, head = (F.element_at(F.array(*map(F.lit, values)), found["k"] + 1) for values in ([len(s) for s, _ in splits], [h for _, h in splits]))
    rest = F.substring(sentence, begin + width, F.length(sentence))
    second = F.when(head == "", _opened(rest, F.upper)).otherwise(F.concat(head, rest))
    parted = F.concat(F.rtrim(F.substring(sentence, F.lit(1), begin - 1), F.lit(" ,")), F.lit(". "), second)
    return F.when((word_count(sentence) > longest) & found.isNotNull() & (chance("split", seed, sentence) < p), parted).otherwise(sentence)


def perturb_connective(sentence: Column, seed: int, connectives: Sequence[str] = PLAIN.connectives, p: float = P_CONNECTIVE) -> Column:
    """Puts a connective before a sentence that does not start with one."""
    pick = F.element_at(F.array(*map(F.lit, connectives)), F.floor(chance("pick", seed, sentence) * len(connectives)).cast("int") + 1)
    has = F.rlike(sentence, F.lit("^(" + "|".join(connectives) + ")"))
    return F.when((chance("connective", seed, sentence) < p) & (F.length(sentence) > 0) & ~has, F.concat(pick, F.lit(" "), _opened(sentence, F.lower))).otherwise(sentence)


def perturb_reorder(sentence: Column, seed: int, intro: str = PLAIN.intro, p: float = P_INTRO) -> Column:
    """Moves an introductory word to the end."""
    word, rest = F.regexp_extract(sentence, intro, 1), F.regexp_replace(sentence, intro, "")
    moved = F.concat(_opened(rest, F.upper), F.lit(", "), F.lower(word))
    return F.when(F.rlike(sentence, F.lit(intro)) & (F.length(rest) > 0) & (chance("reorder", seed, sentence) < p), moved).otherwise(sentence)


def _each(edit, *args):
    return lambda sentence: edit(sentence, *args)


def perturb(text: Column, seed: int, rules: EditRules = PLAIN) -> Column:
    """All edits, sentence by sentence, joined by a full stop and a space; no shuffle."""
    parts = F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > 0)
    # one transform an edit: an edit names its sentence many times, so nesting them would multiply the expression
    for k, (old, new) in enumerate(rules.phrases):
        parts = F.transform(parts, _each(perturb_phrase, seed, k, old, new))
    for edit, rule in ((perturb_split, rules.splits), (perturb_connective, rules.connectives), (perturb_reorder, rules.intro)):
        parts = F.transform(parts, _each(edit, seed, rule))
    return F.array_join(parts, ". ")


def sql_perturb(source: str, seed: int, rules: EditRules = PLAIN) -> str:
    """The same in DuckDB SQL: common table expressions that end in edited(doc_id, text)."""

    def draw(op: str, k: int = 0) -> str:
        return f"('0x' || substr(md5('{seed}:{op}:{k}:' || s), 1, 8))::bigint / 4294967296.0::double"

    opened = lambda x, f: f"case when substr({x}, 1, 1) = 'ß' then 'ß' else {f}(substr({x}, 1, 1)) end || substr({x}, 2)"
    parts = f"list_transform(string_split_regex(text, '{END}'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g'))"
    steps = [f"e0 as (select doc_id, unnest(l) as s, unnest(range(len(l))) as pos from (select doc_id, list_filter({parts}, lambda x: length(x) > 0) as l from {source}))"]

    def step(value: str) -> None:
        steps.append(f"e{len(steps)} as (select doc_id, pos, {value} as s from e{len(steps) - 1})")

    for k, (old, new) in enumerate(rules.phrases):
        edited = rf"regexp_replace(regexp_replace(s, '(^|[^\p{{L}}]){old}($|[^\p{{L}}])', '\1{new}\2', 'g'), '(^|[^\p{{L}}]){_capital(old)}($|[^\p{{L}}])', '\1{_capital(new)}\2', 'g')"
        step(f"case when {draw('phrase', k)} < {P_PHRASE} then {edited} else s end")
    floor = f"(floor(length(s) * {FIRST_PART}::double)::int + 1)"
    places = ", ".join(f"{{'place': instr(substr(s, {floor}), '{x}'), 'k': {k}}}" for k, (x, _) in enumerate(rules.splits))
    steps.append(f"e{len(steps)} as (select *, {floor} as lo, list_min(list_filter([{places}], lambda x: x.place > 0)) as f from e{len(steps) - 1})")
    width, head = f"[{', '.join(str(len(x)) for x, _ in rules.splits)}][f.k + 1]", f"[{', '.join(repr(h) for _, h in rules.splits)}][f.k + 1]"
    rest = f"substr(s, (f.place + lo - 1 + {width})::int)"
    step(f"case when len(regexp_extract_all(s, '{WORD}')) > {LONG_SENTENCE} and f is not null and {draw('split')} < {P_SPLIT} then rtrim(substr(s, 1, (f.place + lo - 2)::int), ' ,') || '. ' || case when {head} = '' then {opened(rest, 'upper')} else {head} || {rest} end else s end")
    pick = f"[{', '.join(repr(c) for c in rules.connectives)}][floor({draw('pick')} * {len(rules.connectives)})::int + 1]"
    step(f"case when {draw('connective')} < {P_CONNECTIVE} and length(s) > 0 and not regexp_matches(s, '^({'|'.join(rules.connectives)})') then {pick} || ' ' || {opened('s', 'lower')} else s end")
    rest = f"regexp_replace(s, '{rules.intro}', '')"
    step(f"case when regexp_matches(s, '{rules.intro}') and length({rest}) > 0 and {draw('reorder')} < {P_INTRO} then {opened(rest, 'upper')} || ', ' || lower(regexp_extract(s, '{rules.intro}', 1)) else s end")
    return ", ".join(steps) + f", edited as (select d.doc_id, case when d.text is not null then coalesce(string_agg(s, '. ' order by pos), '') end as text from {source} d left join e{len(steps) - 1} using (doc_id) group by d.doc_id, d.text)"
