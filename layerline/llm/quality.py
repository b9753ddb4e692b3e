"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's commonest words are compared with those of the whole
language by Jensen-Shannon distance (base 2, 0 to 1). The references are computed over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from layerline.llm.common import stored, whole_text

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What is neither a lower-case letter nor the plain blank is short; the other classes are counted in it, by the
#: characters that a pattern leaves when all others are removed.
PLAIN = r"[\p{Ll}\x20]+"
CLASSES = (r"\P{Lu}+", r"\P{Nd}+", r"\P{P}+")
#: Lower-case letters, the classes above, white space, and the rest.
N_CLASSES = len(CLASSES) + 3
#: A common word has at most this many characters, which bounds the references that are broadcast.
LONGEST_COMMON = 64
MOST_BROADCAST = 10_000
#: Chance alone takes a text of n words to about sqrt(k / (8 ln 2 n)) from its language over k common words: this many
#: times as far is no sign of another language.
CHANCE = 1.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, computed once: inside the lambda it is a variable and not an expression to repeat."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def window_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of each window: of up to four words at once, then from pairs of shorter windows.

    The array has ``width`` words at least. Past the end there is nothing to add; those windows are sliced off.
    """

    def wider(hashes: Column, span: int) -> Column:
        if span == width:
            return F.slice(hashes, F.lit(1), F.size(words) - width + 1)
        step = min(span, width - span)
        both = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))
        return let(both, lambda found: wider(found, span + step))

    few = min(4, width)
    first = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, few)]))
    return let(first, lambda hashes: wider(hashes, few))


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """How many words lie in windows of that many words that the array holds at least twice."""

    def covered(found: Column) -> Column:
        last = F.size(found) - 1
        twice = F.filter(
            F.transform(
                found,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(found, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(found, i + 1)["h"] == x["h"])), x["at"]
                ),
            ),
            lambda at: at.isNotNull(),
        )
        return let(
            F.sort_array(twice),
            lambda at: F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end")),
                lambda s, x: F.struct(
                    (s["n"] + F.least(F.lit(width), x + width - s["end"])).alias("n"), (x + width).alias("end")
                ),
                lambda s: s["n"],
            ),
        )

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        # Most texts repeat no window, which their number of distinct hashes tells without a sort.
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, covered)).otherwise(0)

    return F.when(F.size(words) > width, let(window_hashes(words, width), counted)).otherwise(0).cast("long")


def entropy_term(p: Column, middle: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares: the root of the divergence."""
    terms = F.zip_with(p, q, lambda a, b: (entropy_term(a, (a + b) / 2) + entropy_term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), lambda n: F.transform(
        c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def class_counts(text: Column, rest: Column, word_chars: Column) -> Column:
    """Characters of each class; ``rest`` is the text without what ``PLAIN`` matches."""

    def size(value: Column) -> Column:
        return F.length(value).cast("long")

    blanks = size(text) - word_chars
    lower = size(text) - size(rest) - (blanks - (size(rest) - size(without(rest, SPACES))))
    counts = [lower, *[size(F.regexp_replace(rest, left, "")) for left in CLASSES], blanks]
    return let(F.array(*counts), lambda c: F.concat(c, F.array(
        F.greatest(size(text) - F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))))


def word_counts(words: Column, common: Column) -> Column:
    """Occurrences of each common word, and of all others."""
    return let(F.filter(words, lambda w: F.array_contains(common, w)), lambda hits: F.concat(
        F.transform(common, lambda c: F.size(F.filter(hits, lambda h: h == c)).cast("long")),
        F.array((F.size(words) - F.size(hits)).cast("long")),
    ))


def common_words(worded: DataFrame, top: int) -> DataFrame:
    """One row per language with words: its ``top`` commonest words and how often each occurs."""
    counted = worded.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = counted.where(F.length("word") <= LONGEST_COMMON).withColumn("rank", rank).where(F.col("rank") <= top)
    found = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return found.select("lang", F.col("top.word").alias("common"), F.col("top.n").alias("times"))


def references(measured: DataFrame, common: DataFrame) -> DataFrame:
    """One row per language: the shares of its character classes, and of its common words and all others.

    ``bare_distance`` is that of a text without any common word, ``n_common`` the number of common words.
    """
    span = range(N_CLASSES)
    sums = measured.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in span], F.sum("n_words").alias("total"))
    times = F.coalesce("times", F.array().cast("array<bigint>"))
    others = let(times, lambda t: F.concat(t, F.array(F.col("total") - F.aggregate(t, F.lit(0).cast("long"), lambda s, n: s + n))))
    known = sums.join(common, "lang", "left").select(
        "lang", shares(F.array(*[f"c{i}" for i in span])).alias("class_reference"), shares(others).alias("word_reference"))
    n_common = F.size("word_reference") - 1
    bare = F.transform("word_reference", lambda _, i: F.when(i == n_common, 1.0).otherwise(0.0))
    return known.withColumns({"bare_distance": js_distance(bare, F.col("word_reference")), "n_common": n_common})


def word_limit(n_words: Column, share: float, most: float) -> Column:
    """The largest distance of a text of that many words: that share of the bare distance, or more by chance, and at most ``most``."""
    chance = CHANCE * F.sqrt(F.col("n_common") / (8 * math.log(2) * F.greatest(n_words, F.lit(1))))
    return F.least(F.lit(most), F.greatest(share * F.col("bare_distance"), chance))


def bounded(table: DataFrame) -> DataFrame:
    """A written table of one bounded row per language: broadcast up to ``MOST_BROADCAST`` rows, joined by size beyond."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 16,
    least_words: int = 100, most_class_distance: float = 0.35, most_word_distance: float = 0.55, most_bare_share: float = 0.85,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance``, one row per row of ``docs``.

    A document that passes the base rules is dropped when it has at least ``least_words`` words and lies farther from
    its language than one of the distances allows. The word distance is also limited to ``most_bare_share`` of the
    distance of a text without any common word of the language, or to what chance makes of so few words. Documents of an unknown (null) language form a language of their own.
    Null texts have no words and fail. An empty table gives no rows.
    """
    text = whole_text(text_col)
    worded = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        text.alias("text"),
        words_of(text).alias("words"),
    )
    common = bounded(stored(common_words(worded, top), "common_words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    measured = stored(
        worded.withColumns({
            "word_chars": F.length(F.array_join("words", "")).cast("long"), "rest": F.regexp_replace("text", PLAIN, ""),
        }).join(common, "lang", "left").select(
            "doc_id",
            "lang",
            F.size("words").cast("long").alias("n_words"),
            "word_chars",
            (F.length("rest") - F.length(without(F.col("rest"), SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.col("words")).alias("n_repeat_words"),
            class_counts(F.col("text"), F.col("rest"), F.col("word_chars")).alias("classes"),
            word_counts(F.col("words"), F.coalesce("common", F.array().cast("array<string>"))).alias("word_counts"),
        ),
        "quality_measures",
    )
    known = bounded(stored(references(measured, common), "quality_references"))
    n_words, n_repeat = F.col("n_words"), F.col("n_repeat_words")
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    close = (F.col("class_distance") <= most_class_distance) & (
        F.col("word_distance") <= word_limit(n_words, most_bare_share, most_word_distance))
    judged = measured.join(known, "lang", "left").withColumns({
        "class_distance": js_distance(shares(F.col("classes")), F.col("class_reference")),
        "word_distance": js_distance(shares(F.col("word_counts")), F.col("word_reference")),
    })
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ((n_words < least_words) | F.coalesce(close, F.lit(True)))).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )
