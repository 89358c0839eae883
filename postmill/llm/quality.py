"""Quality rules, line by line first.

Each line with a word is judged on its own: does it end like a sentence, is it navigation, is it boilerplate? Lines that fail are
removed, and a document that loses too much of its text, counted in characters of its lines, is rejected. All work stays in the document's row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import let, text_of, words_of

MIN_WORDS = 10
MOST_REPEATED = 20  # per cent of words in repeated windows
WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Signs a sentence may end with, alone or before closing quotes and brackets.
SENTENCE_END = r"[.!?:;…。！？][\"'’”»)\]]*[\x20\x09-\x0D]*$"
# Signs that part the entries of a menu or a path.
SEPARATORS = r"[|»›•·>]"
MOST_SEPARATORS = 2
# A line with one separator for so many words is a menu, however it ends.
WORDS_PER_SEPARATOR = 4
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "click here", "sign up for our", "subscribe to our", "lorem ipsum", "skip to content", "powered by",
)
# A line without a sentence end passes as prose from so many words on: cut-off paragraphs, verse, lists of names. A shorter one
# is a menu entry, a heading or a button.
PROSE_WORDS = 8
# Signs that are no prose where they make up more than this share of a line.
MOST_SIGNS = 0.1
# The least share of the characters of a document's lines that must be left.
LEAST_KEPT = 0.5


def n_symbols(text: Column) -> Column:
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text)
    return F.char_length(text) - F.char_length(bare)


def n_dup_lines(lines: Column) -> Column:
    """``lines``: those with a word."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """``words`` has to be a column that is there, not an expression."""
    last = F.size(words) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def covered_words(windows: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window whose hash occurs twice or more. Texts without such a window are settled by one set."""

    def twice(placed: Column) -> Column:
        return F.filter(
            placed, lambda p, k: (p["h"] == F.get(placed, k + 1)["h"]) | ((k > 0) & (p["h"] == F.get(placed, k - 1)["h"]))
        )

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.array_sort(F.transform(let(placed, twice), lambda p: p["i"]))
    # One fold over the sorted starts: words covered so far, and where they end.
    total = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + width - F.greatest(s["end"], i)).alias("n"), (i + width).alias("end")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total)


def line_fails(line: Column) -> Column:
    """True for a line with a word that is a menu, boilerplate, signs rather than prose, or neither a sentence nor long enough."""
    n_words = F.size(words_of(line))
    boiler = F.lower(line).rlike("|".join(BOILERPLATE))
    parts = F.regexp_count(line, F.lit(SEPARATORS))
    menu = (parts > MOST_SEPARATORS) & (parts * WORDS_PER_SEPARATOR >= n_words)
    unended = ~line.rlike(SENTENCE_END)
    signs = n_symbols(line) > MOST_SIGNS * F.char_length(line)
    return boiler | signs | menu | (unended & (n_words < PROSE_WORDS))


def verdict(text: Column) -> Column:
    """All figures of one text as a struct.

    Words, windows and lines are bound within the expression, not as columns before it: a filter on ``kept`` may then be
    pushed into the scan as it is, where columns would be written out again at each of their uses.
    """

    def of_words(words: Column) -> Column:
        return let(window_hashes(words), lambda windows: F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            covered_words(windows).cast("bigint").alias("n_repeat_words"),
        ))

    def judged(f: Column, lines: Column, good: Column) -> Column:
        failed = (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MOST_REPEATED)
        left, whole = F.char_length(F.array_join(good, "")), F.char_length(F.array_join(lines, ""))
        return F.struct(
            f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), n_symbols(text).cast("bigint").alias("n_symbols"),
            n_dup_lines(lines).cast("bigint").alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & (left >= whole * LEAST_KEPT)).alias("kept"), F.array_join(good, "\n").alias("clean_text"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: F.octet_length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    return let(let(words_of(text), of_words), lambda f: let(lines, lambda lines: let(
        F.filter(lines, lambda line: ~line_fails(line)), lambda good: judged(f, lines, good)
    )))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, the base figures, ``base_failed``, ``kept`` and ``clean_text``.

    ``clean_text`` is the text without the lines that fail. Null and empty texts have no word, so they fail the base; a
    repeated row is judged like its first, and no row is compared with another, so ties do not arise. ``keep`` may not name a column
    that a figure has. An empty table gives no rows.
    """
    kept_columns = [F.col(f"`{c}`") for c in keep]
    return docs.select(*kept_columns, verdict(text_of("text")).alias("_verdict")).select(*kept_columns, "_verdict.*")
