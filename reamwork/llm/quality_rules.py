"""Quality rules: one threshold table compiled into one Spark projection.

Counts of a text (words, characters, symbols, lines, stop words, repeated passages) are column
expressions; :data:`RULES` names ratios of these counts and the range each may have. No user
function runs and nothing is shuffled: a document is judged inside its own row.

The stop-word rule speaks only of texts in the languages whose function words are listed: those whose column ``lang``
names one (``en``, ``en-GB``). Texts of other languages, of none (null) and of tables without such a column are judged by the
other rules, so that no language is thrown out for its words; ``few_stop_words`` says of every text whether it has fewer than the rule asks for.

Defined results: a null or empty text has no words and fails; ties do not arise; repeated rows are
judged each for itself; an empty table gives an empty table; columns of the input other than the
text and ``lang`` do not matter and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, field, first_n, rows_where, unboxed, words

#: The symbols that are counted, the window of repeated passages and the base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of some languages, and their codes.
LANGUAGES = ("en", "fr", "de", "es")
STOP_WORDS = (
    "the be to of and that have with in is it for as on are this by from or was at an a "
    "le la les de des du et en un une que qui est pour dans sur pas au avec ce "
    "der die das und den von zu mit sich ist für auf dem nicht ein eine im des als "
    "el los las y del se por con una su para es al lo como más o no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * top / bottom <= high`` over two counts; a missing bound is open. ``listed``: for languages of the list alone."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None
    listed: bool = False

    def passes(self) -> Column:
        top, bottom, ok = F.col(self.top) * 1000, F.col(self.bottom), F.lit(True)
        if self.low is not None:
            ok = ok & (top >= F.lit(self.low) * bottom)
        if self.high is not None:
            ok = ok & (top <= F.lit(self.high) * bottom)
        return ok


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2_000, high=14_000),
    Rule("symbols per word", "n_symbols", "n_words", high=100),
    Rule("stop words", "n_stop_words", "n_words", low=10, listed=True),
    Rule("lines seen before", "n_dup_lines", "n_lines", high=300),
)


def counts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the counts the rules speak of. Windows are told apart by 64-bit hashes."""
    one = F.lit(1).cast("bigint")
    split = rows.select(
        "*", words(text).alias("words"),
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    hashed = split.select(
        *rows.columns, "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = hashed.withColumn("windows", F.transform(
        first_n(F.size("hashes") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)),
    )).drop("hashes")
    # Only a text with a repeated window pays for the sort.
    ordered = windows.withColumn("ordered", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("windows")
    twice = F.filter("ordered", lambda x, i: (
        F.coalesce(x["h"] == F.get("ordered", i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("ordered", i + 1)["h"], F.lit(False))
    ))
    placed = ordered.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - s, F.lit(WINDOW)))),
        one * 0, lambda total, n: total + n,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, one * 0)).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str = "lang") -> DataFrame:
    """The input boxed as ``row``, its counts, ``base_failed``, ``few_stop_words`` and ``kept``."""
    counted = counts(boxed(df), field(text))
    code = F.lower(F.substring(field(lang).cast("string"), 1, 2)) if lang in df.columns else F.lit(None).cast("string")
    listed = F.coalesce(code.isin(*LANGUAGES), F.lit(False))
    verdict, few = F.lit(True), F.lit(False)
    for rule in rules:
        verdict = verdict & (rule.passes() | ~listed if rule.listed else rule.passes())
        few = few | ~rule.passes() if rule.listed else few
    return counted.withColumns({"base_failed": base_failed(), "few_stop_words": few, "kept": ~base_failed() & verdict})


def quality_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and verdict of every document."""
    return judge(df, text, lang=lang).select(
        field(doc_id).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_stop_words", "n_lines", "few_stop_words",
    )


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return unboxed(rows_where(judge(df, text, lang=lang), F.col("kept")), df.columns)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM parts WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM placed),
twice AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS i FROM windows JOIN twice USING (doc_id, w)),
repeats AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
counted AS (
  SELECT p.doc_id, p.lang, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains(string_split('the be to of and that have with in is it for as on are this by from or was at an a le la les de des du et en un une que qui est pour dans sur pas au avec ce der die das und den von zu mit sich ist für auf dem nicht ein eine im des als el los las y del se por con una su para es al lo como más o no', ' '), lower(w)))) AS n_stop_words,
    len(lines) AS n_lines
  FROM parts p LEFT JOIN repeats r USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND 10 * n_symbols <= n_words
    AND (100 * n_stop_words >= n_words OR lang IS NULL OR lower(lang[1:2]) NOT IN ('en', 'fr', 'de', 'es')) AND 10 * n_dup_lines <= 3 * n_lines AS kept,
  CAST(n_stop_words AS BIGINT) AS n_stop_words, CAST(n_lines AS BIGINT) AS n_lines, 100 * n_stop_words < n_words AS few_stop_words
FROM failed
"""
