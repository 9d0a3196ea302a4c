"""Line-first cleaning with DataFrame functions alone.

Each line is judged by itself: punctuation (runs of odd marks, or a long line without any
punctuation), navigation (a menu word, or items between bars) and boilerplate (licence, copyright
and cookie phrases in a short line).  Lines that fail are taken out; a document goes if they hold
too much of its text, or if it fails the base measures (too few words, too many words in repeated
three-word windows).  All of it is one projection: no shuffle, no grouping.

Defined results: a null or empty text has no words and fails; blank lines never fail; repeated rows
are judged alike; an empty table gives no rows; further columns are carried along untouched.  Words
of repeated windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 40
#: A line fails if it has more odd marks than one in so many words.
WORDS_A_MARK = 5
#: Lines of so many words need some punctuation; only lines of fewer can be boilerplate.
LONG_LINE, SHORT_LINE = 20, 25
WORD = r"[^\x20\x09-\x0D]+"
MARKS = r"[#*$%&<>|]+|[!?][!?]+"
SENTENCE = r"[.,;:!?]|…|。"
MENU = (
    r"^[\x20\x09-\x0D]*(home|menu|log ?in|sign (in|up)|register|search|next( page)?|previous( page)?|back to top"
    r"|share( this)?|read more|skip to (main )?content|contact( us)?|about( us)?)[\x20\x09-\x0D.:!>]*$"
)
BOILERPLATE = (
    r"all rights reserved|copyright|licensed under|released under|terms of (use|service)|privacy policy"
    r"|cookie policy|uses? cookies|subscribe to|javascript (is )?(required|disabled)|powered by"
)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether a line is to go."""
    low = F.lower(line)
    return common.let(
        count_of(line, WORD),
        lambda words: (words > 0) & (
            (count_of(line, MARKS) * WORDS_A_MARK > words)
            | ((words >= LONG_LINE) & ~line.rlike(SENTENCE))
            | ((words < SHORT_LINE) & (low.rlike(MENU) | low.rlike(BOILERPLATE)))
        ),
    )


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice among ``words``."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, n: total + n)

    def repeated(ordered: Column) -> Column:
        same = lambda w, i: (F.get(ordered, i)["h"] == w["h"])
        twice = F.filter(
            ordered,
            lambda w, i: F.coalesce(F.when(i > 0, same(w, i - 1)), F.lit(False)) | F.coalesce(same(w, i + 1), F.lit(False)),
        )
        return common.let(F.sort_array(F.transform(twice, lambda w: w["at"])), covered)

    def of_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, common.let(ordered, repeated)).otherwise(F.lit(0))

    def of_hashes(hashes: Column) -> Column:
        return common.let(
            F.transform(
                F.slice(hashes, F.lit(1), F.size(hashes) - 2),
                lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
            ),
            of_windows,
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        common.let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    )


def measures(text: Column) -> Column:
    """A struct of the base measures, the verdict and the clean text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        with_word = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        kept = F.filter(lines, lambda line: ~line_fails(line))
        return common.let(
            F.struct(with_word.alias("full"), kept.alias("kept")),
            lambda x: F.struct(
                (F.size(x["full"]) - F.size(F.array_distinct(x["full"]))).cast("long").alias("n_dup_lines"),
                F.array_join(x["kept"], "\n").alias("clean"),
                F.char_length(F.array_join(x["kept"], "")).cast("long").alias("clean_chars"),
                F.char_length(F.array_join(lines, "")).cast("long").alias("line_chars"),
            ),
        )

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    return F.struct(
        common.let(words, of_words).alias("words"),
        symbols.cast("long").alias("n_symbols"),
        common.let(F.split(text, "\n", -1), of_lines).alias("lines"),
    )


def judge(docs: DataFrame, name: str = "judged") -> DataFrame:
    """Adds a struct column ``name``: base measures, base_failed, kept, and the text without failed lines."""
    raw = common.fresh_name([*docs.columns, name], "measured")
    measured = docs.withColumn(raw, measures(F.coalesce(F.col("text"), F.lit(""))))
    words, lines = F.col(raw)["words"], F.col(raw)["lines"]
    failed = (words["n_words"] < MIN_WORDS) | (words["n_repeat_words"] * 100 > words["n_words"] * MAX_REPEAT_PERCENT)
    lost = lines["line_chars"] - lines["clean_chars"]
    kept = ~failed & (lost * 100 <= lines["line_chars"] * MAX_LOST_PERCENT)
    return measured.withColumn(
        name,
        F.struct(
            words["n_words"].alias("n_words"), words["word_chars"].alias("word_chars"),
            F.col(raw)["n_symbols"].alias("n_symbols"), lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"),
            lines["clean"].alias("clean"),
        ),
    ).drop(raw)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without the lines that failed."""
    name = common.fresh_name(docs.columns, "judged")
    judged = judge(docs, name)
    columns = [F.col(name)["clean"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return judged.filter(F.col(name)["kept"]).select(columns)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *[F.col("judged")[n].alias(n) for n in BASE])


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, t.i AS i, list_slice(w, t.i, t.i + 2) AS win FROM d, generate_series(1, len(w) - 2) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS n, len(regexp_extract_all(line, '{MARKS}')) AS marks
      FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
f AS (SELECT doc_id, line, n > 0 AND (marks * {WORDS_A_MARK} > n
        OR (n >= {LONG_LINE} AND NOT regexp_matches(line, '{SENTENCE}'))
        OR (n < {SHORT_LINE} AND (regexp_matches(lower(line), '{MENU}') OR regexp_matches(lower(line), '{BOILERPLATE}')))) AS fails, n
      FROM l),
s AS (SELECT doc_id, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (fails), 0) AS lost,
        count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup FROM f GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        n_dup AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, chars, lost
      FROM d JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * chars AS kept FROM b
"""
