"""Quality rules: repetition and length, and how far a text's distributions lie from a language's.

All of it is DataFrame functions inside one projection per step: no Python, no shuffle.

- base: counts of words, repeated lines and repeated three-word windows. Windows of a text are hashed
  (64 bits), sorted with their places, and a window is repeated if a neighbour in that order is equal;
  the words they cover are counted from the places in order. n log n in the text's length.
- divergence: the histogram of character classes and that of common words (each word of the language's
  list, and all others) against each language's reference, by Jensen-Shannon distance (base 2).
  The language nearest by the sum of both distances counts, for both thresholds. A text with fewer than ``min_chars`` characters in words or ``min_words`` words
  is not judged by the histogram in question, as short texts lie far from any reference by chance.

Defined results: null texts have no words and fail the base; of languages as near the first in the table counts; rows with an equal doc_id are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read

MIN_WORDS, MAX_REPEATED = 50, 50
MIN_CHARS, MIN_COMMON_WORDS = 200, 80
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.33
#: Shares of lower-case letters, capitals, digits, blanks, common punctuation and other signs in prose.
CLASSES = {
    "en": (0.790, 0.025, 0.004, 0.158, 0.020, 0.003),
    "de": (0.790, 0.050, 0.004, 0.133, 0.020, 0.003),
    "fr": (0.788, 0.024, 0.004, 0.160, 0.021, 0.003),
    "es": (0.792, 0.022, 0.004, 0.160, 0.019, 0.003),
}
#: Shares of common words among all words of prose; the rest is other words.
WORDS = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.025, "a": 0.021, "in": 0.019, "is": 0.011, "that": 0.010, "for": 0.009, "it": 0.009, "was": 0.008, "on": 0.007, "with": 0.007, "as": 0.007, "be": 0.006},
    "de": {"der": 0.034, "die": 0.033, "und": 0.028, "in": 0.018, "den": 0.013, "von": 0.011, "zu": 0.011, "das": 0.010, "mit": 0.009, "ist": 0.009, "sich": 0.008, "des": 0.008, "ein": 0.007, "eine": 0.007, "für": 0.007},
    "fr": {"de": 0.049, "la": 0.028, "le": 0.023, "et": 0.020, "les": 0.018, "des": 0.015, "en": 0.014, "un": 0.011, "du": 0.011, "une": 0.010, "que": 0.009, "est": 0.009, "dans": 0.008, "qui": 0.008, "par": 0.007},
    "es": {"de": 0.060, "la": 0.038, "que": 0.031, "el": 0.028, "en": 0.027, "y": 0.026, "a": 0.019, "los": 0.015, "se": 0.012, "del": 0.011, "las": 0.010, "un": 0.010, "por": 0.009, "con": 0.008, "una": 0.008},
}
SPACE = r"[\x20\x09-\x0D]"


def without(text: Column, signs: str) -> Column:
    """The text less all of these characters (a plain search for each is faster than an expression)."""
    for c in signs:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def distance(p: Column, q: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of a row's array of shares to fixed ones."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log2(b / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, F.array(*map(F.lit, q)), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and both distances (null where a text is too short to be judged)."""
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    at = at.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = sorted({w for one in WORDS.values() for w in one})
    spelt = [form for w in names for form in {w, w.capitalize(), w.upper()}]
    rows = at.withColumn("no_symbols", without(F.col("text"), "#*$%&|<>")).withColumn("no_signs", without(F.col("no_symbols"), "@^_~=+/\\[]{}`")).select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("text").alias("size"),
        (F.length("text") - F.length("no_symbols")).cast("long").alias("n_symbols"), (F.length("text") - F.length("no_signs")).alias("c_sign"),
        (F.length("no_signs") - F.length(without(F.col("no_signs"), ".,;:!?'\"()-"))).alias("c_stop"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("c_upper"), F.length(F.regexp_replace("text", "[^0-9]+", "")).alias("c_digit"),
        lines.alias("lines"), F.transform(F.filter("words", lambda w: w.isin(spelt)), lambda w: F.lower(w)).alias("common"),
        F.transform(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("b"), F.slice("words", F.lit(3), F.greatest(F.size("words") - 2, F.lit(0))).alias("c")), lambda x: F.xxhash64(x)).alias("hashes"),
    )
    # the last two places hold no whole window
    rows = rows.withColumn("hashes", F.slice("hashes", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))).drop("words")
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    sorted_windows = F.sort_array(F.arrays_zip(F.col("hashes").alias("h"), F.sequence(F.lit(0), F.size("hashes") - 1).alias("i")))
    rows = rows.withColumn("windows", F.when(repeats, sorted_windows))
    # an index below 0 or past the end gives null, and null counts as unequal
    twice = F.filter("windows", lambda x, i: (x["h"] == F.get("windows", i - 1)["h"]) | (x["h"] == F.get("windows", i + 1)["h"]))
    rows = rows.withColumn("places", F.sort_array(twice["i"]))
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    counts = F.array(*(F.size("common") - F.size(F.array_remove("common", w)) for w in names))
    c_blank = F.col("size") - F.col("word_chars")
    c_letter = F.greatest(F.col("size") - F.col("c_upper") - F.col("c_digit") - c_blank - F.col("c_stop") - F.col("c_sign"), F.lit(0))
    classes = F.transform(F.array(c_letter, F.col("c_upper"), F.col("c_digit"), c_blank, F.col("c_stop"), F.col("c_sign")), lambda c: c / F.greatest(F.col("size"), F.lit(1)))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), classes.alias("classes"), counts.alias("counts"),
    )

    def words_of(lang: str) -> Column:
        shares = F.transform(F.array(*(F.lit(names.index(w)) for w in WORDS[lang])), lambda i: F.get("counts", i) / F.greatest(F.col("n_words"), F.lit(1)))
        others = 1 - F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x)
        return distance(F.concat(shares, F.array(others)), (*WORDS[lang].values(), 1 - sum(WORDS[lang].values())))

    none = F.lit(None).cast("array<double>")
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("word_chars") >= MIN_CHARS, F.array(*(distance(F.col("classes"), CLASSES[x]) for x in WORDS))).otherwise(none).alias("by_class"),
        F.when(F.col("n_words") >= MIN_COMMON_WORDS, F.array(*(words_of(x) for x in WORDS))).otherwise(none).alias("by_word"),
    )
    both = F.transform(F.array(*map(F.lit, range(len(WORDS)))), lambda i: F.coalesce(F.get("by_class", i), F.lit(0.0)) + F.coalesce(F.get("by_word", i), F.lit(0.0)))
    rows = rows.withColumn("nearest", (F.array_position(both, F.array_min(both)) - 1).cast("int"))
    judged_at_all = F.col("by_class").isNotNull() | F.col("by_word").isNotNull()
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.get("by_class", "nearest").alias("class_distance"), F.get("by_word", "nearest").alias("word_distance"),
        F.when(judged_at_all, F.get(F.array(*map(F.lit, WORDS)), "nearest")).alias("language"),
    )


def judged(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))
