"""Line-first quality rules, in DataFrame functions alone.

Every line with a word is judged by the punctuation, navigation and boilerplate
rules; failing lines are removed, and a document that loses more than MAX_LOST of
its words is rejected. A document also has to pass the base limits (enough words,
not mostly repeated three-word windows). Defined results: a null text has no words
and is rejected; repeated rows are judged alike, each on its own; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACE, fresh, guarded, let, set_aside, text_of, without

MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Share of a document's words that line cleaning may remove.
MAX_LOST = 0.5
#: Punctuation rule: marks in a line, as a share of its characters in words.
MAX_MARKS = 0.25
#: ... and words that end in two or more exclamation or question marks.
MAX_SHOUTS = 0.3
#: Navigation rule: separators to a word, from MIN_SEPARATORS on.
MIN_SEPARATORS, MAX_SEPARATORS = 2, 0.2
#: Boilerplate rule: a line of at most so many words that matches BOILERPLATE.
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (\(c\)|©|[0-9]{4})|(cookie|privacy) policy|terms of (use|service)|"
    r"we use cookies|javascript (is|must be)|click here|sign up for|subscribe (to|now)|"
    r"share (this|on) |log ?in (to|or) |back to top|skip to (main )?content"
)
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<>^~=_{}[]\\/@+`!?"
SEPARATORS = "|»›•·"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept")


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _compact(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""

    def covered(windows: Column) -> Column:
        # Equal windows are neighbours once sorted by (hash, position).
        def flagged(ordered: Column) -> Column:
            equal = lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"])
            return F.filter(ordered, lambda x, i: F.coalesce(equal(x, i), F.lit(False)))

        numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        positions = let(numbered, lambda ordered: F.transform(flagged(ordered), lambda x: x["at"]))
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    def counted(words: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        )
        repeated = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
        return F.when(F.size(words) >= 3, let(windows, repeated)).otherwise(0)

    return let(words, counted)


def line_passes(line: Column) -> Column:
    """Whether a line with words passes the three rules."""
    n_words = F.size(words_of(line))
    characters = F.char_length(_compact(line))
    shouts = F.regexp_count(line, F.lit(rf"[!?]{{2,}}(?=[{SPACE}]|\z)"))
    punctuation = (_count(line, MARKS) <= MAX_MARKS * characters) & (shouts <= MAX_SHOUTS * n_words)
    separators = _count(line, SEPARATORS)
    navigation = (separators < MIN_SEPARATORS) | (separators <= MAX_SEPARATORS * n_words)
    boilerplate = (n_words > BOILERPLATE_WORDS) | ~line.rlike(BOILERPLATE)
    return punctuation & navigation & boilerplate


def quality(docs: DataFrame, clean: str = "clean_text") -> DataFrame:
    """docs with the counts, the verdict `kept` and the text of the lines that passed."""
    docs = without(docs, *RESULTS, clean)
    text, words, lines, passed = fresh(docs, "__text", "__words", "__lines", "__passed")
    split = (
        docs.withColumn(text, text_of())
        .withColumn(words, words_of(F.col(text)))
        .withColumn(lines, F.split(text, "\n", -1))
        .withColumn(passed, F.filter(lines, lambda x: ~x.rlike(f"[^{SPACE}]") | line_passes(x)))
        .withColumn(lines, F.transform(F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.xxhash64(x)))
        .withColumn(clean, F.array_join(passed, "\n"))
    )
    number = lambda c: c.cast("long")
    counted = (
        split.withColumn("n_words", number(F.size(words)))
        .withColumn("word_chars", number(F.char_length(_compact(F.col(text)))))
        .withColumn("n_symbols", number(_count(F.col(text), SYMBOLS)))
        .withColumn("n_dup_lines", number(F.size(lines) - F.size(F.array_distinct(lines))))
        .withColumn("n_repeat_words", number(repeated_window_words(F.col(words))))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words")),
        )
        .withColumn("n_kept_words", number(F.size(words_of(F.col(clean)))))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= (1 - MAX_LOST) * F.col("n_words")))
    )
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], clean, *RESULTS)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs and the failing lines removed."""
    renamed, own = set_aside(docs, RESULTS)
    (clean,) = fresh(renamed, "__clean")
    judged = guarded(quality(renamed, clean), F.col("kept"))
    now = {"text": F.col(clean), "n_chars": F.char_length(clean).cast("long")}
    return judged.select(*[now[c].alias(c) if c in now else x for c, x in zip(docs.columns, own)])
