"""Quality rules: distance of a text's histograms from its language's, on built-ins only.

A text has two histograms: how its characters spread over classes, and how often each
common word of its language occurs among its words. The reference of a language is the
sum over all of its documents. A document is compared with it by the Jensen-Shannon
distance of either histogram. A short text has a ragged histogram, so each comparison
needs a minimum length and is left out below it.

Everything is a Spark SQL expression. Texts are read once, into a table of counts; the
references, one row per language, are sums over it and are broadcast after their number
has been checked.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from solvenza.llm.common import BLANKS, written

# Base rules.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
SHARE_REPEATED = (100, 50)  # failed if 100 * repeated words > 50 * words
RUN = 3                     # words of a window

# Distances are square roots of divergences in bits, from 0 to 1.
CHARS_LIMIT, WORDS_LIMIT = 0.24, 0.26
CHARS_GUARD, WORDS_GUARD = 200, 60  # characters, words
FEW_LANGUAGES = 1000        # references that are broadcast

# Frequent function words by language. How frequent is counted.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "mit"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "las"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "it": ("di", "e", "il", "la", "che", "in", "per", "un"),
    "nl": ("de", "het", "een", "van", "en", "in", "is", "dat"),
    "pt": ("de", "a", "o", "que", "e", "do", "da", "em"),
}
COMMON = 8
WORDS = [f"word_{k}" for k in range(COMMON)]

# Classes of characters: those that a pattern counts, then what lengths tell. "wide" is
# the bytes beyond one per character, "blank" what is in no word, "rest" the remainder.
COUNTED = {"digit": "[0-9]", "upper": "[A-Z]", "mark": r"[!-/:-@\[-`{-~]"}
CLASSES = (*COUNTED, "wide", "blank", "rest")


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, lengths, histograms and base counts of every text."""
    told = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("_text"))
    parts = F.split("_text", "[\\x20\\x09-\\x0D]+")
    # Only the first and the last part can be empty.
    told = told.withColumn("_words", F.filter(parts, lambda w: F.octet_length(w) > 0))
    lines = F.filter(F.split("_text", "\n"), lambda s: F.length(F.btrim(s, F.lit(BLANKS))) > 0)
    words = F.col("_words")
    hashes = F.when(F.size(words) >= RUN, F.transform(
        F.slice(words, 1, F.size(words) - (RUN - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, RUN)]),
    ))
    known = F.create_map(*[
        x for lang, common in COMMON_WORDS.items()
        for x in (F.lit(lang), F.array(*map(F.lit, common)))
    ])
    # Each word between two blanks of its own, so that neighbours are both found.
    spaced = F.lower(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    told = told.select(
        "*", lines.alias("_lines"), hashes.alias("_runs"), spaced.alias("_spaced"),
        F.coalesce(known[F.col("lang")], F.array().cast("array<string>")).alias("_common"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
    )

    def occurrences(k: int) -> Column:
        padded = F.concat(F.lit(" "), F.get("_common", F.lit(k)), F.lit(" "))
        gone = F.replace(F.col("_spaced"), padded, F.lit(""))
        n = (F.octet_length("_spaced") - F.octet_length(gone)) / F.octet_length(padded)
        return F.coalesce(n, F.lit(0)).cast("long")

    chars = F.char_length("_text").cast("long")
    return told.select(
        "doc_id", "lang", chars.alias("chars"), F.size("_words").cast("long").alias("n_words"), "word_chars",
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_runs").alias("n_repeat_words"),
        *[F.regexp_count("_text", F.lit(p)).cast("long").alias(n) for n, p in COUNTED.items()],
        (F.octet_length("_text") - chars).alias("wide"), (chars - F.col("word_chars")).alias("blank"),
        *[occurrences(k).alias(n) for k, n in enumerate(WORDS)],
        (F.size("_common") > 0).alias("listed"),
    ).withColumn("rest", F.col("chars") - _total([F.col(n) for n in (*COUNTED, "blank")]))


def repeated_words(runs: str) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes.

    Most texts repeat no window, which distinct hashes show. In the others the windows
    are sorted with their places; those with an equal neighbour cover words, each up to
    the next such window's start.
    """
    hashes = F.col(runs)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A struct holds the sorted array, so that the expression is evaluated once.
    again = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, j: (
        (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
    )))
    places = F.transform(again, lambda s: F.sort_array(F.transform(s, lambda x: x["i"])))
    covered = F.transform(places, lambda s: F.aggregate(
        F.transform(s, lambda x, j: F.least(F.lit(RUN), F.coalesce(F.get(s, j + 1) - x, F.lit(RUN)))),
        F.lit(0), lambda a, b: a + b,
    ))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.get(covered, F.lit(0))).otherwise(F.lit(0)).cast("long")


def references(counts: DataFrame) -> DataFrame:
    """Per language, the sums of both histograms over all documents; NULL is a language."""
    sums = counts.groupBy("lang").agg(*[F.sum(n).alias(f"ref_{n}") for n in (*CLASSES, *WORDS, "n_words")])
    return sums.withColumnRenamed("lang", "ref_lang")


def distance(names: tuple[str, ...]) -> Column:
    """Jensen-Shannon distance of the shares in columns and those in their ``ref_`` columns."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    pairs = [(F.col(n), F.col(f"ref_{n}")) for n in names]
    divergence = _total([(part(x, y) + part(y, x)) / 2 for x, y in pairs])
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base verdict, the two distances and ``kept`` of every document.

    A distance is NULL, and speaks for no rejection, where the text is shorter than its
    guard or, for words, the language has no list. NULL, empty and blank texts have no
    words and fail the base rules; a NULL lang is a language of its own. NULL and repeated
    doc_ids are handed on. Only doc_id, text and lang are read. An empty table gives an
    empty result. Windows are compared by 64-bit hashes within one text.
    """
    counts = written(measured(docs), "quality-counts")
    refs = written(references(counts), "quality-references")
    few = refs.count() <= FEW_LANGUAGES
    told = counts.join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    # Shares are columns of their own before distances are built of them.
    for prefix in ("", "ref_"):
        told = told.withColumn(f"{prefix}_all", F.greatest(_total([F.col(prefix + n) for n in CLASSES]), F.lit(1)))
        told = told.withColumn(f"{prefix}_of", F.greatest(F.col(prefix + "n_words"), F.lit(1)))
        other = F.col(f"{prefix}_of") - _total([F.col(prefix + n) for n in WORDS])
        told = told.withColumn(f"{prefix}other", F.greatest(other, F.lit(0)))
        told = told.withColumns({
            prefix + n: F.col(prefix + n) / F.col(prefix + of)
            for names, of in ((CLASSES, "_all"), ((*WORDS, "other"), "_of")) for n in names
        })
    times, limit = SHARE_REPEATED
    failed = (F.col("n_words") < LEAST_WORDS) | (times * F.col("n_repeat_words") > limit * F.col("n_words"))
    told = told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("chars") >= CHARS_GUARD, distance(CLASSES)).alias("chars_distance"),
        F.when(F.col("listed") & (F.col("n_words") >= WORDS_GUARD), distance((*WORDS, "other")))
        .alias("words_distance"),
    )
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= CHARS_LIMIT) & (
        F.coalesce("words_distance", F.lit(0.0)) <= WORDS_LIMIT
    )
    kept = (~F.col("base_failed") & near).alias("kept")
    return told.select(*told.columns[:7], kept, "chars_distance", "words_distance")
