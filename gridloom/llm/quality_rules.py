"""Quality rules: a threshold table compiled into one projection, without user functions.

Operator 3.  Every measure is a column expression over the words and lines of the whole
text; ``RULES`` is data, and ``compiled`` turns it into one conjunction.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at from this or an not "
    "le la les de des du un une et en est que qui dans pour sur pas au par avec "
    "der die das und von zu mit den im für ist auf dem nicht ein eine als auch es "
    "el los las del y por con una para se no su al lo"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """Reject a document when ``weight`` times ``measure`` compares to ``limit`` times ``of``."""

    measure: str
    over: bool
    limit: int
    of: str
    weight: int = 100


#: Thresholds in per cent; all arithmetic is on integers, so engines agree exactly.
RULES = (
    Rule("word_chars", False, 200, "n_words"),  # mean word of under 2 letters
    Rule("word_chars", True, 1500, "n_words"),  # mean word of over 15
    Rule("n_symbols", True, 15, "n_words"),
    Rule("n_stop_words", False, 5, "n_words"),
    Rule("n_upper_words", True, 50, "n_words"),
    Rule("n_dup_lines", True, 50, "n_lines"),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside runs of ``window`` words that the text has twice or more.

    Runs are sorted by hash, so equal ones are neighbours; the positions of those with an
    equal neighbour are sorted again and the words they cover are counted: n log n.
    """

    def of_words(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - F.lit(window - 1))
        runs = F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(w, i, window)).alias("h"), i.alias("i"))))

        def of_runs(r: Column) -> Column:
            paired = F.filter(
                F.transform(
                    r,
                    lambda x, k: F.when(
                        (F.coalesce(F.get(r, k - 1)["h"] == x["h"], F.lit(False)))
                        | (F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False))),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return bound(
                F.array_sort(paired),
                lambda p: F.aggregate(
                    F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window)))),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            )

        return F.when(F.size(w) >= window, bound(runs, of_runs)).otherwise(F.lit(0))

    return bound(words, of_words)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of the whole text, as longs; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = " \t\n\x0b\f\r"
    with_word = lambda x: F.length(F.translate(x, spaces, "")) > 0
    base = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACES + "+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), with_word).alias("_lines"),
        F.length(F.translate(text, spaces, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    is_upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)
    return base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_words", is_upper)).cast("long").alias("n_upper_words"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One expression: true where a rule rejects."""
    broken = F.lit(False)
    for r in rules:
        left, right = F.lit(r.weight) * F.col(r.measure), F.lit(r.limit) * F.col(r.of)
        broken = broken | (left > right if r.over else left < right)
    return broken


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Measures and verdict of each row of ``docs`` (doc_id, text).

    One row out per row in, whatever repeats; a null or empty text has no words and fails
    the base check; a null doc_id is carried along; extra columns are ignored unless in
    ``keep``; an empty table gives an empty table.
    """
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    columns = keep or ["doc_id"]
    return measured(docs, columns).select(
        *columns, *BASE, failed.alias("base_failed"), (~failed & ~compiled(rules)).alias("kept"),
        "n_lines", "n_stop_words", "n_upper_words",
    )


def passed(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = quality_rules(docs.select("text", row), rules, ["_row"])
    return judged.where("kept").select("_row.*")


_FUNCTION_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: DuckDB statement for the rows of op3.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT *, coalesce(text, '') AS t FROM documents)
), s AS (
  SELECT r, doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ln
  FROM d
), win AS (
  SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s WHERE len(w) >= {WINDOW})
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r
), m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ln) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_FUNCTION_WORDS}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS BIGINT) AS n_upper_words
  FROM s LEFT JOIN cov USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"{r.weight} * {r.measure} {'>' if r.over else '<'} {r.limit} * {r.of}" for r in RULES)}) AS kept,
  n_lines, n_stop_words, n_upper_words
FROM f
"""
