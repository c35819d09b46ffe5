"""Line-first cleaning, in DataFrame functions only.

Every line is judged alone: too much punctuation, navigation, boilerplate, shouting, or an
earlier line of the same document again. Failing lines are removed; a document that loses too
much of its text is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, words_of

SYMBOLS = "#*$%&|<>"
#: A line fails with more symbols or doubled marks than this share of its characters.
MAX_SYMBOL_SHARE = 0.10
#: A line with so many separators (|, ›, ·, •) is a menu, if it has no more characters than this for each.
MIN_SEPARATORS, ENTRY_CHARS = 3, 40
#: A phrase of site furniture condemns a line of up to so many characters: in longer ones it is a subject of the text.
FURNITURE_CHARS = 160
#: A line of at least three words with more capitals than this share of its characters is shouting.
MAX_CAPITAL_SHARE = 0.5
#: A document that loses more of its word characters than this is rejected.
MAX_LOSS = 0.3
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

# Phrases of site furniture, in lower case.
BOILERPLATE = (
    "accept all cookies", "add to cart", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "follow us on", "forgot your password", "leave a comment", "log in to", "lorem ipsum",
    "newsletter sign", "powered by", "privacy policy", "read more", "share this", "sign up for", "skip to content",
    "subscribe to our", "terms of service", "terms of use", "this site uses cookies", "we use cookies",
)


def _line_chars(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, ""))


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Whether a line, judged alone, is not prose."""
    chars = _line_chars(line)
    marks = _count_of(line, SYMBOLS + "{}[]\\^~_=") + F.regexp_count(line, F.lit(r"[!?]{2,}")) * 2
    separators = _count_of(line, "|›·•")
    menu = (separators >= MIN_SEPARATORS) & (chars <= ENTRY_CHARS * separators)
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    shouting = (capitals > MAX_CAPITAL_SHARE * chars) & (F.length(F.trim(line)) - F.length(F.translate(F.trim(line), " ", "")) >= 2)
    boilerplate = (chars <= FURNITURE_CHARS) & bind(F.lower(line), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    return (marks > MAX_SYMBOL_SHARE * chars) | menu | shouting | boilerplate


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hash. Only texts with a repeat sort their windows.
    """

    def covered(wins: Column) -> Column:
        pairs = F.array_sort(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = bind(pairs, lambda s: F.array_sort(F.filter(F.transform(
            s, lambda e, j: F.when(((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]),
        ), lambda x: x.isNotNull())))
        return bind(starts, lambda t: F.aggregate(
            F.transform(t, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(t, j + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x,
        ))

    def doubled(hashes: Column, width: int) -> Column:
        return bind(hashes, lambda v: F.transform(v, lambda x, i: F.xxhash64(x, F.get(v, i + width))))

    # A window's hash is of its halves' hashes, and so on: n is a power of two.
    windows = F.transform(words, lambda w: F.xxhash64(w))
    for width in (2**k for k in range(n.bit_length() - 1)):
        windows = doubled(windows, width)
    windows = bind(windows, lambda v: F.when(F.size(v) >= n, F.slice(v, 1, F.size(v) - (n - 1))))
    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, clean_text and kept.

    A null text counts as no words: it fails the base rules. Columns of ``docs`` that have one
    of these names are replaced; all others are carried along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    has_word = lambda x: _line_chars(x) > 0
    with_lines = bind(F.filter(lines, has_word), lambda full: F.struct(
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("dup"),
        F.filter(F.array_distinct(full), lambda x: ~line_fails(x)).alias("kept"),
    ))
    words = bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.coalesce(repeated_words(w), F.lit(0)).cast("long").alias("rep")))
    return (
        docs.withColumns({"__l": with_lines, "__w": words})
        .withColumns({
            "n_words": F.col("__w.n"), "word_chars": _line_chars(text).cast("long"), "n_symbols": _count_of(text, SYMBOLS).cast("long"),
            "n_dup_lines": F.col("__l.dup"), "n_repeat_words": F.col("__w.rep"), "clean_text": F.array_join("__l.kept", "\n"),
        })
        .drop("__l", "__w")
        .withColumn("lost_chars", F.col("word_chars") - _line_chars(F.col("clean_text")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= MAX_LOSS * F.col("word_chars")))
    )


#: DuckDB SQL for the rows of op4.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls FROM d
), judged AS (
  SELECT doc_id, len(ls) - len(list_distinct(ls)) AS dup,
    list_filter(list_distinct(ls), lambda x: NOT (
      length(x) - length(translate(x, '{SYMBOLS}{{}}[]\^~_=', '')) + 2 * len(regexp_extract_all(x, '[!?]{{2,}}')) > {MAX_SYMBOL_SHARE}::DOUBLE * length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
      OR (length(x) - length(translate(x, '|›·•', '')) >= {MIN_SEPARATORS} AND length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) <= {ENTRY_CHARS} * (length(x) - length(translate(x, '|›·•', ''))))
      OR (len(regexp_extract_all(x, '\p{{Lu}}')) > {MAX_CAPITAL_SHARE}::DOUBLE * length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
          AND length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) >= 2)
      OR (length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) <= {FURNITURE_CHARS} AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')))) AS kept
  FROM lines
), w AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)
), win AS (
  SELECT doc_id, i, {" || ' ' || ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(WINDOW))} AS t FROM w
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win WHERE t IS NOT NULL) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, dup AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(kept, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))), 0) AS left_chars
  FROM d JOIN judged USING (doc_id) LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (word_chars - left_chars)::BIGINT AS lost_chars,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND word_chars - left_chars <= {MAX_LOSS}::DOUBLE * word_chars AS kept
FROM f
"""
