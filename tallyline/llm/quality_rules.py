"""Quality rules from the distance of a document's histograms to those of its language. DataFrame functions only.

Two histograms describe a text: the shares of seven character classes, and the shares of the common words of its language
and of all other words. A language's reference is the mean histogram of its documents, over all documents that are long
enough, so that every document counts once however long it is. A document fails if the Jensen-Shannon distance (base 2,
0 to 1) to the reference is over the limit in either histogram. Short texts say little: below ``min_chars`` characters
the classes, and below ``min_words`` words the common words, aren't judged.

Documents in a language without a list share one reference, and only their character classes are judged. At most one
reference row for each listed language and one for all others exist; these rows are joined by broadcast.

Null texts have no words and no characters. Documents fail before any distance if they have fewer than 50 words or if over
half of their words stand in 3-word windows that occur twice or more in the text. Words in such windows are told apart by
64-bit hashes of the windows of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import written

# Frequent words of four languages.
COMMON_WORDS = {
    "en": (
        "the of and to in a is that for it as was with be by on not he his are this at from or an"
    ).split(),
    "de": (
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus"
    ).split(),
    "fr": (
        "de la le et les des en un du une que est pour qui dans par plus au sur pas ne ce avec il se"
    ).split(),
    "es": (
        "de la que el en y a los se del las un por con no una su para es al lo como más o pero"
    ).split(),
}
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
MIN_CHARS = 600
MIN_COMMON_WORDS = 120
MOST_CLASS_DISTANCE = 0.23
MOST_WORD_DISTANCE = 0.3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MARKS = ".,;:!?()\"\t\n\v\f\r"
SPACE = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"


def left_over(text: Column, pattern: str) -> Column:
    """Characters left when all matches are taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def with_words(frame: DataFrame) -> DataFrame:
    """Adds ``words``, ``n_words`` and the counts of characters, symbols, repeated lines and repeated words."""
    words, windows, ordered, starts = F.col("words"), F.col("windows"), F.col("ordered"), F.col("starts")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def twice(own: Column, number: Column) -> Column:
        before, after = F.get(ordered, number - 1)["value"], F.get(ordered, number + 1)["value"]
        return own["value"].eqNullSafe(before) | own["value"].eqNullSafe(after)

    hashed = F.transform(words, lambda word, place: F.xxhash64(word, F.get(words, place + 1), F.get(words, place + 2)))
    reach = F.transform(starts, lambda start, number: F.least(F.lit(3), F.coalesce(F.get(starts, number + 1) - start, F.lit(3))))
    return (
        frame.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
        .withColumn("n_words", F.size("words"))
        .withColumn("word_chars", F.length(F.array_join("words", "")))
        .withColumn("n_symbols", left_over(F.col("text"), NO_SYMBOL))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")))
        .withColumn("windows", F.slice(hashed, F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0))))
        .withColumn(
            "ordered",
            F.when(
                F.size(F.array_distinct(windows)) < F.size(windows),
                F.sort_array(F.transform(windows, lambda own, place: F.struct(own.alias("value"), place.alias("at")))),
            ),
        )
        .withColumn("starts", F.sort_array(F.filter(ordered, twice)["at"]))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda total, more: total + more), F.lit(0)))
        .drop("lines", "windows", "ordered", "starts")
    )


def with_class_counts(frame: DataFrame) -> DataFrame:
    """Adds ``classes``: characters by class, which are lower-case and other letters, upper case, digits, white space,
    punctuation, symbols and others. Each pattern is a column of its own, so that it is sought once."""
    text = F.col("text")
    frame = frame.withColumns(
        {
            "letters": left_over(text, r"\P{L}+"),
            "upper": left_over(text, r"\P{Lu}+"),
            "digits": left_over(text, "[^0-9]+"),
            "marks": left_over(text, r"[^.,;:!?'\"()\-]+"),
        }
    )
    letters, upper, digits, marks = (F.col(name) for name in ("letters", "upper", "digits", "marks"))
    others = F.col("word_chars") - letters - digits - marks - F.col("n_symbols")
    spaces = F.length("text") - F.col("word_chars")
    counts = F.array(letters - upper, upper, digits, spaces, marks, F.col("n_symbols"), others)
    return frame.withColumn("classes", counts).drop("letters", "upper", "digits", "marks")


def word_counts(text: Column, common: Column) -> Column:
    """How often each common word stands in a text whose words are set apart by two spaces or more."""
    return F.transform(
        common,
        lambda word: (F.octet_length(text) - F.octet_length(F.replace(text, F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))))
        / (F.octet_length(word) + 2),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda sum_, more: sum_ + more)


def described(documents: DataFrame, keep: list[str] | None, lang: str, text: str, min_chars: int, min_words: int) -> DataFrame:
    """Each document as ``row`` with its counts, its language key and both histograms, null where the text is too short."""
    kept = documents.columns if keep is None else keep
    frame = documents.select(
        F.struct(*[F.col(f"`{name}`") for name in kept]).alias("row"),
        F.col(f"`{lang}`").alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    common = F.lit(None).cast("array<string>")
    for name, words in COMMON_WORDS.items():
        common = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(common)
    apart = F.replace(F.translate(F.lower("text"), MARKS, " " * len(MARKS)), F.lit(" "), F.lit("  "))
    listed = F.col("lang").isin(list(COMMON_WORDS))
    frame = (
        with_class_counts(with_words(frame))
        .withColumn("key", F.when(listed, F.col("lang")).otherwise(F.lit("")))
        .withColumn("chars", F.when(F.length("text") >= min_chars, F.col("classes")))
        .withColumn("apart", F.when(listed & (F.col("n_words") >= min_words), F.concat(F.lit(" "), apart, F.lit(" "))))
        .withColumn("common", F.when(F.col("apart").isNotNull(), word_counts(F.col("apart"), common)))
    )
    rest = F.greatest(F.col("n_words") - total(F.col("common")), F.lit(0.0))
    return frame.select(
        "row",
        "key",
        *COUNTS,
        shares(F.transform("chars", lambda count: count.cast("double"))).alias("chars"),
        shares(F.concat("common", F.array(rest))).alias("common"),
    )


def shares(counts: Column) -> Column:
    return F.transform(counts, lambda count: count / total(counts))


def references(described: DataFrame) -> DataFrame:
    """The mean histograms of each language: one row for each listed language, and one for all others."""
    width = 1 + max(map(len, COMMON_WORDS.values()))
    means = lambda name, size: F.array(*[F.avg(F.get(F.col(name), F.lit(n))) for n in range(size)])
    return described.groupBy("key").agg(means("chars", 7).alias("all_chars"), means("common", width).alias("all_common"))


def entropy_term(share: Column) -> Column:
    return F.when(share > 0, share * F.log2(share)).otherwise(0.0)


def distance(own: Column, other: Column) -> Column:
    """Jensen-Shannon distance, base 2; null if either histogram is missing."""
    terms = F.zip_with(
        own,
        F.slice(other, F.lit(1), F.size(own)),
        lambda a, b: (entropy_term(a) + entropy_term(b)) / 2 - entropy_term((a + b) / 2),
    )
    divergence = total(terms)
    return F.sqrt(F.when(divergence < 0, 0.0).otherwise(divergence))


def judge(
    documents: DataFrame,
    keep: list[str] | None = None,
    lang: str = "lang",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_COMMON_WORDS,
    most_class_distance: float = MOST_CLASS_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
) -> DataFrame:
    """Each document as ``row`` with its counts, ``base_failed``, both distances and ``kept``.

    ``keep`` names the columns of ``row``, all by default. The counts and histograms are written with them to the shared
    folder, so that the texts are read once. A distance is null where the text is too short or its language has no list,
    and then isn't judged.
    """
    found = written(described(documents, keep, lang, text, min_chars, min_words), "histograms")
    judged = found.join(F.broadcast(references(found)), "key", "left").withColumns(
        {
            "class_distance": distance(F.col("chars"), F.col("all_chars")),
            "word_distance": distance(F.col("common"), F.col("all_common")),
        }
    )
    n_words, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    far = F.coalesce(F.col("class_distance") > most_class_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > most_word_distance, F.lit(False)
    )
    return judged.select(
        "row",
        *[F.col(name).cast("long").alias(name) for name in COUNTS],
        failed.alias("base_failed"),
        "class_distance",
        "word_distance",
        (~failed & ~far).alias("kept"),
    )
